"""Replay of tool calls over a customer's cards, transactions, transfers and cases.

The state and the calls of a record are columns, and one aggregate folds them: every call
gives an envelope, and what it changes is seen by the next. A failed call changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import let

CARD = "struct<card_id:string,last4:string,name:string,status:string>"
TRANSACTION = "struct<amount_cents:bigint,description:string,disputed:boolean,posted_at:string,status:string,transaction_id:string>"
TRANSFER = "struct<amount_cents:bigint,created_at:string,recipient:string,status:string,transfer_id:string>"
CASE = "struct<case_id:string,case_type:string,created_at:string,status:string,subject:string>"
STATE = f"struct<cards:array<{CARD}>,transactions:array<{TRANSACTION}>,transfers:array<{TRANSFER}>,service_cases:array<{CASE}>>"
CALL = "struct<tool:string,last4:string,transaction_id:string,description:string,transfer_id:string,recipient:string,limit:bigint>"
ENVELOPE = "struct<tool:string,ok:boolean,result:string,code:string,message:string>"
_ACC = STATE[:-1] + f",made:array<{CASE}>,envelopes:array<{ENVELOPE}>>"

# Tools with the arguments that they take, the code of a failed call and its messages, the cases that changes open.
ARGUMENTS = {
    "list_accounts": (), "list_cards": (), "list_service_cases": (), "list_transactions": ("limit",), "list_transfers": (),
    "cancel_transfer": ("recipient", "transfer_id"), "dispute_transaction": ("description", "transaction_id"), "freeze_card": ("last4",), "replace_card": ("last4",),
}
FAILED_CODE = "backend_error"
NO_MATCH = "No matching eligible synthetic banking record was found."
NOT_SUPPORTED = "The requested tool arguments are not supported."
NOT_COMPLETED = "The synthetic banking action could not be completed."
CASES = {"freeze_card": ("stolen_card", "Stolen Card for card ending "), "replace_card": ("replacement_card", "Replacement Card for card ending ")}
GENERATED_AT, LISTED, NEWEST = "generated-timestamp", 5, 10


def _pick(items: Column, eligible: Callable[[Column], Column], key: Callable[[Column], Column]) -> Column:
    """Place (from 0) of the eligible item with the greatest key, the first of equals; null for none."""
    ranked = F.transform(items, lambda x, i: F.when(F.coalesce(eligible(x), F.lit(False)), F.struct(key(x).alias("key"), (-i).alias("i"))))
    return -F.array_max(ranked)["i"]


def _only(items: Column, eligible: Callable[[Column], Column]) -> Column:
    """Place of the single eligible item; null for none or several."""
    found = F.filter(F.transform(items, lambda x, i: F.when(F.coalesce(eligible(x), F.lit(False)), i)), lambda i: i.isNotNull())
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def _set(item: Column, kind: str, **changes: Column) -> Column:
    names = [f.split(":")[0] for f in kind[len("struct<") : -1].split(",")]
    return F.struct(*(changes.get(n, item[n]).alias(n) for n in names))


def _newest(items: Column, at: str, n: int | Column) -> Column:
    """The ``n`` newest items; those of one time stay in their order."""
    ordered = F.transform(F.array_sort(F.transform(items, lambda x, i: F.struct(x[at].alias("at"), (-i).alias("i"), x.alias("x")))), lambda o: o["x"])
    return F.slice(F.reverse(ordered), F.lit(1), n if isinstance(n, Column) else F.lit(n))


def _cases(acc: Column) -> Column:
    return F.concat(acc["made"], _newest(acc["service_cases"], "created_at", 1 << 30))


def _by_name(cards: Column) -> Column:
    return F.transform(F.array_sort(F.transform(cards, lambda c, i: F.struct(c["name"].alias("name"), i.alias("i"), c.alias("c")))), lambda o: o["c"])


def _chosen(acc: Column, call: Column) -> Column:
    """Places of the card, transaction and transfer that the call's selectors mean."""
    four, words, who = call["last4"], F.lower(call["description"]), F.lower(call["recipient"])
    card = F.when(four.isNull(), _pick(acc["cards"], lambda c: F.lit(True), lambda c: c["status"] == "active")).otherwise(_pick(acc["cards"], lambda c: c["last4"] == four, lambda c: F.lit(True)))
    open_debit = lambda t: (t["amount_cents"] < 0) & ~t["disputed"]
    debit = (
        F.when(words.isNotNull(), _only(acc["transactions"], lambda t: open_debit(t) & (F.lower(t["description"]) == words)))
        .when(call["transaction_id"].isNotNull(), _pick(acc["transactions"], lambda t: t["transaction_id"] == call["transaction_id"], lambda t: F.lit(True)))
        .otherwise(_pick(acc["transactions"], open_debit, lambda t: t["posted_at"]))
    )
    pending = lambda t: t["status"] == "pending"
    transfer = (
        F.when(who.isNotNull(), _only(acc["transfers"], lambda t: pending(t) & (F.lower(t["recipient"]) == who)))
        .when(call["transfer_id"].isNotNull(), _pick(acc["transfers"], lambda t: pending(t) & (t["transfer_id"] == call["transfer_id"]), lambda t: F.lit(True)))
        .otherwise(_pick(acc["transfers"], pending, lambda t: t["created_at"]))
    )
    return F.struct(card.alias("card"), debit.alias("debit"), transfer.alias("transfer"))


def _problem(call: Column, at: Column) -> Column:
    """Message of a call that fails, else null."""
    tool = call["tool"]
    given = F.array_compact(F.array(*(F.when(call[a].isNotNull(), F.lit(a)) for a in ("last4", "transaction_id", "description", "transfer_id", "recipient", "limit"))))
    allowed = F.create_map(*(x for t, names in ARGUMENTS.items() for x in (F.lit(t), F.array(*map(F.lit, names)).cast("array<string>"))))
    takes = F.try_element_at(allowed, F.coalesce(tool, F.lit("")))
    both = (tool == "dispute_transaction") & call["description"].isNotNull() & call["transaction_id"].isNotNull() | (tool == "cancel_transfer") & call["recipient"].isNotNull() & call["transfer_id"].isNotNull()
    missing = tool.isin(*CASES) & at["card"].isNull() | (tool == "dispute_transaction") & at["debit"].isNull() | (tool == "cancel_transfer") & at["transfer"].isNull()
    return F.when(takes.isNull() | (F.size(F.array_except(given, takes)) > 0), NOT_SUPPORTED).when(both, NOT_COMPLETED).when(missing, NO_MATCH)


def _lists(acc: Column, limit: Column) -> dict[str, Column]:
    """What each reading tool returns, as JSON."""
    return {
        "list_cards": F.to_json(_by_name(acc["cards"])),
        "list_transactions": F.to_json(_newest(acc["transactions"], "posted_at", F.coalesce(limit, F.lit(LISTED)).cast("int"))),
        "list_transfers": F.to_json(_newest(acc["transfers"], "created_at", 1 << 30)),
        "list_service_cases": F.to_json(_cases(acc)),
    }


def _after(acc: Column, call: Column, at: Column, problem: Column) -> Column:
    tool, good = call["tool"], problem.isNull()
    card_status = F.when(tool == "freeze_card", "frozen").otherwise("replacement_pending")
    on_card, on_debit, on_transfer = good & tool.isin(*CASES), good & (tool == "dispute_transaction"), good & (tool == "cancel_transfer")
    card = _set(F.get(acc["cards"], at["card"]), CARD, status=card_status)
    debit = _set(F.get(acc["transactions"], at["debit"]), TRANSACTION, disputed=F.lit(True))
    transfer = _set(F.get(acc["transfers"], at["transfer"]), TRANSFER, status=F.lit("cancelled"))
    kind = F.when(tool == "freeze_card", CASES["freeze_card"][0]).when(tool == "replace_card", CASES["replace_card"][0]).otherwise("transaction_dispute")
    subject = F.when(tool == "freeze_card", F.concat(F.lit(CASES["freeze_card"][1]), card["last4"])).when(tool == "replace_card", F.concat(F.lit(CASES["replace_card"][1]), card["last4"])).otherwise(F.concat(F.lit("Dispute "), debit["description"], F.lit(" ("), debit["transaction_id"], F.lit(")")))
    number = F.lpad((F.size(acc["made"]) + 1).cast("string"), 3, "0")
    case = F.struct(F.concat(F.lit("generated_case_"), number).alias("case_id"), kind.alias("case_type"), F.lit(GENERATED_AT).alias("created_at"), F.lit("open").alias("status"), subject.alias("subject"))
    rows = _lists(acc, call["limit"])
    result = F.when(on_card, F.to_json(card)).when(on_debit, F.to_json(debit)).when(on_transfer, F.to_json(transfer))
    for name, shown in rows.items():
        result = result.when(good & (tool == name), shown)
    envelope = F.struct(tool.alias("tool"), good.alias("ok"), result.alias("result"), F.when(~good, F.lit(FAILED_CODE)).alias("code"), problem.alias("message"))
    return F.struct(
        F.when(on_card, F.transform(acc["cards"], lambda c, i: F.when(i == at["card"], _set(c, CARD, status=card_status)).otherwise(c))).otherwise(acc["cards"]).alias("cards"),
        F.when(on_debit, F.transform(acc["transactions"], lambda t, i: F.when(i == at["debit"], _set(t, TRANSACTION, disputed=F.lit(True))).otherwise(t))).otherwise(acc["transactions"]).alias("transactions"),
        F.when(on_transfer, F.transform(acc["transfers"], lambda t, i: F.when(i == at["transfer"], _set(t, TRANSFER, status=F.lit("cancelled"))).otherwise(t))).otherwise(acc["transfers"]).alias("transfers"),
        acc["service_cases"].alias("service_cases"),
        F.when(on_card | on_debit, F.concat(acc["made"], F.array(case))).otherwise(acc["made"]).alias("made"),
        F.concat(acc["envelopes"], F.array(envelope)).alias("envelopes"),
    ).cast(_ACC)


def replay(state: Column, calls: Column) -> Column:
    """State (of type STATE) after ordered calls (of type CALL), with the ``made`` cases and the ``envelopes``.

    A card is meant by its number, or without one the first active, else the first; a
    transaction by its id, by the description of the one open debit, or the newest open
    debit; a transfer likewise among those pending. Freezing, replacing and disputing open a
    case. Unknown tools and arguments, both selectors, and no or several matches fail. A
    null list counts as empty.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    lists = {"cards": CARD, "transactions": TRANSACTION, "transfers": TRANSFER, "service_cases": CASE}
    start = F.struct(*(F.coalesce(state[k], none(v)).alias(k) for k, v in lists.items()), none(CASE).alias("made"), none(ENVELOPE).alias("envelopes")).cast(_ACC)
    step = lambda acc, call: let(_chosen(acc, call), lambda at: let(_problem(call, at), lambda problem: _after(acc, call, at, problem)))
    return F.aggregate(F.coalesce(calls, none(CALL)), start, step)


def read_bundle(replayed: Column, tools: Column) -> Column:
    """What several reading tools return of one state: ``results`` by tool, or the ``problem``.

    An empty bundle, and one with a tool that doesn't read, returns nothing; a tool asked for twice answers once.
    """
    known = _lists(replayed, F.lit(None).cast("bigint"))
    wanted = F.coalesce(tools, F.array().cast("array<string>"))
    problem = F.when(F.size(wanted) == 0, "empty_bundle").when(F.size(F.array_except(wanted, F.array(*map(F.lit, known)))) > 0, "not_a_read")
    table = F.create_map(*(x for name, shown in known.items() for x in (F.lit(name), shown)))
    results = let(table, lambda t: F.map_filter(t, lambda k, _: F.array_contains(wanted, k)))
    return F.struct(F.when(problem.isNull(), results).alias("results"), problem.alias("problem"))


def snapshot(replayed: Column) -> Column:
    """Canonical JSON of the state: keys sorted, cards by name, the ten newest transactions, made cases first."""
    return F.to_json(F.struct(_by_name(replayed["cards"]).alias("cards"), _cases(replayed).alias("service_cases"), _newest(replayed["transactions"], "posted_at", NEWEST).alias("transactions"), _newest(replayed["transfers"], "created_at", 1 << 30).alias("transfers")))


def digest(json: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(json, 256))


def state_hash(replayed: Column, calls: Column) -> Column:
    """Digest of the final state; null where there was no call."""
    return F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, digest(snapshot(replayed)))


def events_hash(replayed: Column) -> Column:
    """Digest of the envelopes in order."""
    return digest(F.to_json(replayed["envelopes"]))
