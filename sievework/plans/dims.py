"""Fixed dimension tables: labels, intents, legal tuples, tool arguments, gates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The label ontology, in index order.
RELATIONS = ("context_dependent", "agent_repair", "topic_shift", "clarification_answer", "resume_previous_service")
DOMAINS = ("out_of_domain", "banking", "social")
LANES = ("out_of_domain", "servicing", "policy", "conversation", "other_banking")
FAMILIES = ("external", "accounts", "cards", "transactions", "transfers", "service_cases", "policy", "social", "other_banking")
ACTIONS = ("refuse_ood", "execute_tool", "clarify", "retrieve_policy", "converse")
ENTITIES = ("not_required", "resolved", "missing", "ambiguous", "ineligible")
#: intent: domain, lane, family, tools.
INTENTS = {
    "view_accounts": ("banking", "servicing", "accounts", ("list_accounts",)),
    "view_cards": ("banking", "servicing", "cards", ("list_cards",)),
    "freeze_card": ("banking", "servicing", "cards", ("list_cards", "freeze_card")),
    "replace_card": ("banking", "servicing", "cards", ("list_cards", "replace_card")),
    "view_transactions": ("banking", "servicing", "transactions", ("list_transactions",)),
    "dispute_transaction": ("banking", "servicing", "transactions", ("list_transactions", "dispute_transaction")),
    "view_transfers": ("banking", "servicing", "transfers", ("list_transfers",)),
    "cancel_transfer": ("banking", "servicing", "transfers", ("list_transfers", "cancel_transfer")),
    "view_service_cases": ("banking", "servicing", "service_cases", ("list_service_cases",)),
    "policy_knowledge": ("banking", "policy", "policy", ()),
    "conversation": ("social", "conversation", "social", ()),
    "other_banking": ("banking", "other_banking", "other_banking", ()),
}
NEEDS_ENTITY = ("freeze_card", "replace_card", "dispute_transaction", "cancel_transfer")
# Tools and their arguments.
TOOL_ARGUMENTS = {
    "list_accounts": (), "list_cards": (), "list_service_cases": (), "list_transactions": ("limit",), "list_transfers": (),
    "cancel_transfer": ("recipient",), "dispute_transaction": ("description",), "freeze_card": ("last4",), "replace_card": ("last4",),
}
#: Tools that need a resolved entity.
ENTITY_TOOLS = ("freeze_card", "replace_card", "dispute_transaction", "cancel_transfer")
# Arguments that a model may not see, tools that only read, metrics by the value a release needs.
PRIVATE_ARGUMENTS = ("account_id", "card_id", "customer_id", "password", "pin", "transaction_id", "transfer_id")
READ_TOOLS = ("list_accounts", "list_cards", "list_service_cases", "list_transactions", "list_transfers")
PERFECT_METRICS = ("tool_name_accuracy", "tool_argument_accuracy", "executable_tool_success", "multi_tool_exact_sequence", "clarification_appropriateness", "grounded_final_factuality", "grounded_policy_quality", "ood_small_talk_response_path")
ZERO_METRICS = ("malformed_tool_call_rate", "unsupported_private_arguments", "credential_request_rate", "in_domain_false_refusal", "ood_false_accept")


def rows(spark: SparkSession, schema: str, values: Iterable[tuple]) -> DataFrame:
    """A small fixed table made inside the plan, so that it needs no Python rows at run time."""
    names = [c.split()[0] for c in schema.split(",")]
    items = F.array(*(F.struct(*(F.lit(list(v) if isinstance(v, tuple) and v else v).alias(n) if v != () else F.array().cast("array<string>").alias(n) for v, n in zip(r, names, strict=True))) for r in values))
    kinds = dict(c.split(maxsplit=1) for c in schema.split(", "))
    return spark.range(1).select(F.inline(items)).select(*(F.col(n).cast(kinds[n]) for n in names))


def intents(spark: SparkSession) -> DataFrame:
    return rows(spark, "intent_index int, intent string, domain string, lane string, family string", [(i, k, *v[:3]) for i, (k, v) in enumerate(INTENTS.items())])


def legal_tuples(spark: SparkSession) -> DataFrame:
    """The combinations of intent, action and entity state that may be decided, with head positions (49 rows).

    ``intent_index`` is -1 for out of domain; ``priority`` prefers the safer action on ties,
    ``ordinal`` the earlier combination after that.
    """
    made = [(-1, 0, 0, 0, 0, 0)]
    for i, (intent, (domain, lane, family, _)) in enumerate(INTENTS.items()):
        if lane == "policy":
            pairs = [("retrieve_policy", "not_required")]
        elif lane != "servicing":
            pairs = [("converse", "not_required")]
        else:
            pairs = [("execute_tool", "resolved" if intent in NEEDS_ENTITY else "not_required"), ("clarify", "missing"), ("clarify", "ambiguous"), ("converse", "not_required"), ("converse", "ineligible")]
        made += [(i, DOMAINS.index(domain), LANES.index(lane), FAMILIES.index(family), ACTIONS.index(a), ENTITIES.index(e)) for a, e in pairs]
    safety = {0: 3, 2: 3, 4: 2, 3: 2, 1: 1}
    return rows(spark, "ordinal int, intent_index int, domain_index int, lane_index int, family_index int, action_index int, entity_index int, priority int", [(n, *t, safety[t[4]]) for n, t in enumerate(made)])
