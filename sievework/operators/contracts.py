"""Rules over whole training records: generation contracts, labels, transcripts, messages.

A record has its messages as an array of MESSAGE structs; rules are array expressions, so
that all of a record's violations come from one pass without a shuffle. Only rules between
records (repeats) aggregate, over digests.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.plans import dims

#: ``ok`` and ``parts`` are a tool result's flag and the names of its fields.
MESSAGE = "struct<role:string,content:string,loss:boolean,call_id:string,index:int,tool:string,arguments:map<string,string>,ok:boolean,parts:array<string>>"
CONTRACT = "struct<version:string,mode:string,entity_state:string,tool_names:array<string>>"
# Contract version, modes, families, and texts that an answer of a path must have.
CONTRACT_VERSION = "banking-v6-route-to-generation/v1"
PATH_MARKERS = {"clarification": ("last four digits",), "ood": ("retail banking",), "hard_negative": ("account numbers", "customer ids")}
MODES = ("execute_tool", "clarify", "converse", "retrieve_policy", "refuse_ood")
STATES = ("resolved", "missing", "ambiguous", "not_required")
REGRESSION_PATHS = ("tool_success", "tool_error", "no_tool_banking_faq", "ood", "hard_negative")
FAQ_PATHS = ("no_tool_banking_faq", "retrieval_grounded_policy")
MIN_WORDS = 7


def fired(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that hold, in order; a rule of null doesn't."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))


def is_call(m: Column) -> Column:
    return (m["role"] == "assistant") & m["tool"].isNotNull()


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(values)


def generation_contract(path: Column, family: Column, facts: Column, tools: Column) -> Column:
    """The contract that a record's expected calls, path, family and facts ask for; null for several tools."""
    names = distinct_in_order(tools)
    name = F.get(names, F.lit(0))
    unsure = F.contains(family, F.lit("ambigu")) | F.exists(facts, lambda f: F.contains(f, F.lit("ambiguous")))
    mode = F.when(F.size(names) == 1, "execute_tool").when(path == "clarification", "clarify").when(path == "retrieval_grounded_policy", "retrieve_policy").when(path == "ood", "refuse_ood").otherwise("converse")
    state = F.when(F.size(names) == 1, F.when(name.isin(list(dims.ENTITY_TOOLS)), "resolved").otherwise("not_required")).when(path == "clarification", F.when(unsure, "ambiguous").otherwise("missing")).otherwise("not_required")
    made = F.struct(F.lit(CONTRACT_VERSION).alias("version"), mode.alias("mode"), state.alias("entity_state"), names.alias("tool_names"))
    return F.when(F.size(names) <= 1, made)


def contract_violations(contract: Column, tools: Column) -> Column:
    """Broken rules of a stated contract against the expected calls; none for a record without one."""
    mode, state, own = contract["mode"], contract["entity_state"], contract["tool_names"]
    runs = mode == "execute_tool"
    want = distinct_in_order(tools)
    one = (F.size(own) == 1) & (own == want)
    return F.when(
        contract.isNotNull(),
        fired(
            {
                "contract_version": contract["version"] != CONTRACT_VERSION,
                "contract_decision": ~mode.isin(list(MODES)) | ~state.isin(list(STATES)),
                "contract_tools": own.isNull() | F.exists(own, lambda t: ~t.isin(list(dims.TOOL_ARGUMENTS))),
                "contract_one_tool": runs & ~one,
                "contract_state": runs & one & (state != F.when(F.get(own, F.lit(0)).isin(list(dims.ENTITY_TOOLS)), "resolved").otherwise("not_required")),
                "contract_no_tools": ~runs & ((F.size(own) > 0) | (F.size(want) > 0)),
                "contract_clarify": (mode == "clarify") & ~state.isin("missing", "ambiguous"),
                "contract_other_state": ~runs & (mode != "clarify") & (state != "not_required"),
            }
        ),
    ).otherwise(F.array().cast("array<string>"))


def message_violations(record_id: Column, messages: Column, ordered: Column, requires_tool: Column) -> Column:
    """Broken rules of a record's messages and of what it expects of them."""
    m, prior = messages, lambda i: F.get(messages, i - 1)
    has = lambda rule: F.exists(F.transform(m, rule), lambda b: F.coalesce(b, F.lit(False)))
    calls = F.filter(m, is_call)
    ids = F.transform(calls, lambda c: c["call_id"])
    targets = F.filter(m, lambda x: is_call(x) & F.coalesce(x["loss"], F.lit(False)))
    context = F.filter(m, lambda x: is_call(x) & ~F.coalesce(x["loss"], F.lit(False)))
    named = lambda kind: lambda c, i: c["call_id"] != F.concat(F.lit(kind), record_id, F.lit("_"), i.cast("string"))
    target_ids = F.transform(targets, lambda c: c["call_id"])
    # A result right after its call answers it; one that answers a trained call counts.
    answered = F.filter(F.transform(m, lambda x, i: F.when((x["role"] == "tool") & is_call(prior(i)) & prior(i)["loss"] & (prior(i)["call_id"] == x["call_id"]), x["call_id"])), lambda v: v.isNotNull())
    allowed = F.create_map(*(v for k, a in dims.TOOL_ARGUMENTS.items() for v in (F.lit(k), F.array(*map(F.lit, a)).cast("array<string>"))))
    return fired(
        {
            "invalid_role": has(lambda x: ~x["role"].isin("system", "user", "assistant", "tool")),
            "call_with_content": has(lambda x: is_call(x) & x["content"].isNotNull()),
            "loss_label": has(lambda x: (x["role"] == "assistant") & x["loss"].isNull()),
            "labelled_context": has(lambda x: x["role"].isin("system", "user") & F.coalesce(x["loss"], F.lit(True))),
            "labelled_result": has(lambda x: (x["role"] == "tool") & F.coalesce(x["loss"], F.lit(True))),
            "repeated_call_id": F.size(F.array_distinct(ids)) < F.size(ids),
            "call_index": F.exists(calls, lambda c: F.coalesce(c["index"], F.lit(-1)) != 0),
            "unstable_id": F.exists(F.transform(targets, named("call_")), lambda b: b),
            "unstable_context_id": F.exists(F.transform(context, named("context_")), lambda b: b),
            "unknown_tool": F.exists(calls, lambda c: ~c["tool"].isin(list(dims.TOOL_ARGUMENTS))),
            "extra_arguments": F.exists(calls, lambda c: F.size(F.array_except(F.map_keys(c["arguments"]), F.try_element_at(allowed, c["tool"]))) > 0),
            "envelope": has(lambda x: (x["role"] == "tool") & F.coalesce(F.when(x["ok"], F.array_sort(x["parts"]) != F.array(F.lit("ok"), F.lit("result"))).otherwise(F.array_sort(x["parts"]) != F.array(F.lit("error"), F.lit("ok"))), F.lit(True))),
            "envelope_without_ok": has(lambda x: (x["role"] == "tool") & x["ok"].isNull()),
            "result_correlation": has(lambda x, i: (x["role"] == "tool") & ~F.coalesce(is_call(prior(i)) & (prior(i)["call_id"] == x["call_id"]), F.lit(False)))
            | has(lambda x, i: is_call(x) & ~F.coalesce(F.get(m, i + 1)["role"] == "tool", F.lit(False))),
            "ordered_calls": target_ids != ordered,
            "results_of_calls": answered != target_ids,
            "requires_tool": (F.size(target_ids) > 0) != requires_tool,
        }
    )


def answer_violations(messages: Column, path: Column, citations: Column) -> Column:
    """Broken rules of a record's final answer: its length, loss, words, path markers and citations."""
    said = F.filter(messages, lambda x: (x["role"] == "assistant") & x["tool"].isNull() & x["content"].isNotNull())

    def judged(final: Column) -> Column:
        plain = X.normalize(F.coalesce(final["content"], F.lit("")))
        lacks = lambda marker: ~F.contains(plain, F.lit(marker))
        missing = F.lit(False)
        for p, markers in PATH_MARKERS.items():
            for marker in markers:
                missing = missing | ((path == p) & lacks(marker))
        policy = path == "retrieval_grounded_policy"
        in_context = lambda c: F.exists(F.slice(messages, F.lit(2), F.greatest(F.lit(0), F.size(messages) - 1)), lambda x: (x["role"] == "system") & F.contains(x["content"], c))
        return fired(
            {
                "final_short": F.size(F.filter(F.split(plain, " "), lambda w: w != "")) < MIN_WORDS,
                "final_untrained": ~F.coalesce(final["loss"], F.lit(False)),
                "final_internal_words": F.exists(F.array(*map(F.lit, X.FORBIDDEN_TERMS)), lambda t: F.contains(plain, t)),
                "system_internal_words": F.exists(F.filter(messages, lambda x: x["role"] == "system"), lambda x: F.exists(F.array(*map(F.lit, X.FORBIDDEN_TERMS)), lambda t: F.contains(X.normalize(x["content"]), t))),
                "path_marker": missing,
                "no_citations": policy & (F.size(F.coalesce(citations, F.array().cast("array<string>"))) == 0),
                "citation_not_given": policy & F.exists(citations, lambda c: ~F.contains(final["content"], F.concat(F.lit("[Policy: "), c, F.lit("]")))),
                "citation_not_in_context": policy & F.exists(citations, lambda c: ~in_context(c)),
            }
        )

    return F.when(F.size(said) == 0, F.array(F.lit("no_final"))).otherwise(X.let(F.get(said, F.size(said) - 1), judged))


def repeats(records: DataFrame, key: str, values: Mapping[str, Column]) -> DataFrame:
    """``key, rule`` of records that share a value with another record: counts over digests, joined back by them."""
    out = None
    for rule, value in values.items():
        marked = records.select(F.col(key), F.sha2(value, 256).alias("digest")).where(F.col("digest").isNotNull())
        again = marked.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
        found = marked.join(again, "digest", "left_semi").select(key, F.lit(rule).alias("rule"))
        out = found if out is None else out.unionByName(found)
    return out


def label_violations(intent: Column, labels: Mapping[str, Column], indexes: Mapping[str, Column], tools: Column) -> Column:
    """Broken rules of hierarchical labels: names, indexes and their compatibility with the intent.

    ``labels`` and ``indexes`` have ``domain, lane, family, action, entity``; a null intent
    is out of domain, a null index isn't checked.
    """
    sets = {"domain": dims.DOMAINS, "lane": dims.LANES, "family": dims.FAMILIES, "action": dims.ACTIONS, "entity": dims.ENTITIES}
    want = {d: F.lit(sets[d][0]) for d in ("domain", "lane", "family")}
    compatible = F.array().cast("array<string>")
    for name, (domain, lane, family, own) in dims.INTENTS.items():
        for d, v in (("domain", domain), ("lane", lane), ("family", family)):
            want[d] = F.when(intent == name, F.lit(v)).otherwise(want[d])
        compatible = F.when(intent == name, F.array(*map(F.lit, own)).cast("array<string>")).otherwise(compatible)
    known = intent.isNull() | intent.isin(list(dims.INTENTS))
    action, entity = labels["action"], labels["entity"]
    runs = action == "execute_tool"
    at = lambda d: F.array_position(F.array(*map(F.lit, sets[d])), labels[d]) - 1
    return fired(
        {
            "unknown_intent": ~known,
            **{f"{d}_mismatch": known & (labels[d] != want[d]) for d in ("domain", "lane", "family")},
            **{f"unknown_{d}": ~labels[d].isin(list(sets[d])) for d in ("action", "entity")},
            **{f"{d}_index": indexes[d].isNotNull() & (indexes[d] != at(d)) for d in sets},
            "refusal_in_domain": (action == "refuse_ood") & intent.isNotNull(),
            "out_of_domain_decision": intent.isNull() & ((action != "refuse_ood") | (entity != "not_required")),
            "policy_intent": (action == "retrieve_policy") & ~F.coalesce(intent == "policy_knowledge", F.lit(False)),
            "clarify_state": (action == "clarify") & ~entity.isin("missing", "ambiguous"),
            "tool_lane": runs & known & (want["lane"] != "servicing"),
            "tool_state": runs & entity.isin("missing", "ambiguous", "ineligible"),
            "no_tools": runs & (F.size(tools) == 0),
            "incompatible_tool": runs & known & (F.size(F.array_except(tools, compatible)) > 0),
        }
    )


def transcript_violations(u: Mapping[str, Column]) -> Column:
    """Broken rules of a transcribed utterance: who, when, how sure, reviewed by whom, under which digest."""
    blank = lambda c: F.coalesce(F.trim(u[c]) == "", F.lit(True))
    options = u["alternatives"]
    return fired(
        {
            "confidence": F.coalesce(~u["confidence"].between(0.0, 1.0), F.lit(True)),
            "audio_digest": ~F.coalesce(X.is_digest(u["audio_sha256"]), F.lit(False)),
            "speaker": F.coalesce(X.fold_spaces(u["speaker"]) != "customer", F.lit(True)),
            "interval": ~F.coalesce((u["start_ms"] >= 0) & (u["start_ms"] < u["end_ms"]), F.lit(False)),
            "recording": blank("recording_id"),
            "language": blank("language"),
            "alternative_text": F.exists(options, lambda o: F.coalesce(F.trim(o["text"]) == "", F.lit(True))),
            "alternative_confidence": F.exists(options, lambda o: F.coalesce(~o["confidence"].between(0.0, 1.0), F.lit(True))),
            "alternative_pii": F.exists(options, lambda o: o["text"].rlike("|".join(X.PII.values()))),
            **{f"review_{c}": ~F.coalesce(u[c], F.lit(False)) for c in ("semantic_match", "pii_reviewed", "consent_for_training")},
            "reviewer": blank("reviewer"),
            "license": blank("license"),
        }
    )


def is_read_only(tools: Column) -> Column:
    """Whether there are calls and all of them only read."""
    return (F.size(tools) > 0) & F.forall(tools, lambda t: t.isin(list(dims.READ_TOOLS)))


def unmask_last_answer(messages: Column, when: Column) -> Column:
    """The messages, the last assistant text without loss where ``when`` holds."""
    at = F.coalesce(F.array_max(F.filter(F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & m["content"].isNotNull(), i)), lambda i: i.isNotNull())), F.lit(-1))
    names = [f.split(":")[0] for f in ("role", "content", "loss", "call_id", "index", "tool", "arguments", "ok", "parts")]
    off = lambda m: F.struct(*(F.lit(False).alias(c) if c == "loss" else m[c].alias(c) for c in names))
    return F.when(when, F.transform(messages, lambda m, i: F.when(i == at, off(m)).otherwise(m))).otherwise(messages)


def to_single_target(record_id: Column, messages: Column, request: Column) -> Column:
    """Two trained calls as one: the first becomes context, a user's ``request`` follows its result.

    Ids are made anew (``context_<record>_0``, ``call_<record>_0``), results follow their
    call. Records of another shape are as they are.
    """
    names = ("role", "content", "loss", "call_id", "index", "tool", "arguments", "ok", "parts")
    trained = F.filter(F.transform(messages, lambda m, i: F.when(is_call(m) & m["loss"], F.struct(i.alias("i"), m["call_id"].alias("id")))), lambda s: s.isNotNull())
    first, second = F.get(trained, F.lit(0)), F.get(trained, F.lit(1))
    new_id = lambda m: F.when(m["call_id"] == first["id"], F.concat(F.lit("context_"), record_id, F.lit("_0"))).when(m["call_id"] == second["id"], F.concat(F.lit("call_"), record_id, F.lit("_0"))).otherwise(m["call_id"])
    renamed = F.transform(messages, lambda m, i: F.struct(*((new_id(m) if c == "call_id" else m["loss"] & (i != first["i"]) if c == "loss" else m[c]).alias(c) for c in names)))
    result = F.coalesce(F.array_min(F.filter(F.transform(messages, lambda m, i: F.when((m["role"] == "tool") & (m["call_id"] == first["id"]), i)), lambda i: i.isNotNull())), F.lit(-1))
    asked = F.array(F.struct(F.lit("user").alias("role"), request.alias("content"), F.lit(False).alias("loss"), *(F.lit(None).alias(c) for c in names[3:]))).cast(f"array<{MESSAGE}>")
    whole = F.concat(F.slice(renamed, F.lit(1), result + 1), asked, F.slice(renamed, result + 2, F.size(messages)))
    return F.when((F.size(trained) == 2) & (result >= 0), whole).otherwise(messages)


def record_classes(family: Column, target: Column, path: Column, faq_families: Sequence[str] = ()) -> dict[str, Column]:
    """Flags of the classes that a continuation mix treats apart."""
    return {
        "coreference_positive": (family == "deictic_replace_action") & (target == "replace_card"),
        "coreference_ambiguity": (family == "deictic_replace_ambiguity") & (target == "clarification"),
        "policy_faq": family.isin(list(faq_families)) | path.isin(list(FAQ_PATHS)) if faq_families else path.isin(list(FAQ_PATHS)),
        "tool_outcome": family == "tool_outcome_consistency",
        "regression": path.isin(list(REGRESSION_PATHS)),
    }


def source_kind(label: Column, banking: Sequence[str], talk: Sequence[str]) -> Column:
    """Where a labelled utterance belongs; a banking label goes before a conversational one."""
    return F.when(label.isin(list(banking)), "clinc_supported_banking").when(label.isin(list(talk)), "clinc_conversational_in_domain").when(label == "oos", "clinc_oos").otherwise("clinc_nonbanking")


def held_out_excluded(rows: DataFrame, held_out: DataFrame, text: str = "text", held_text: str = "text") -> DataFrame:
    """Rows whose normalized text is none of the held-out ones; null texts stay."""
    keys = held_out.select(X.normalize(F.col(held_text)).alias("__held")).where("__held IS NOT NULL").distinct()
    return rows.join(keys, X.normalize(F.col(text)) == F.col("__held"), "left_anti")


def count_or_null(value: Column) -> Column:
    """A text as a whole number of zero or more; null for anything else, such as ``true`` or ``-1``."""
    return F.when(F.trim(value).rlike(r"\A\+?\d{1,18}\z"), F.regexp_replace(F.trim(value), r"\A\+", "").cast("bigint"))


def text_or_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def generated_ids(rows: DataFrame, group: str, order: Sequence[str], case_id: str, fixed: Sequence[str]) -> DataFrame:
    """Rows with generated case ids numbered in their order, ``generated_case_001`` on, and ``generated``.

    An id that begins with ``case_`` is generated unless it begins with one of ``fixed``.
    """
    from pyspark.sql.window import Window

    made = F.startswith(case_id, F.lit("case_"))
    for prefix in fixed:
        made = made & ~F.startswith(case_id, F.lit(prefix))
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(made.cast("int")).over(upto)
    return rows.withColumn("generated", F.coalesce(made, F.lit(False))).withColumn(case_id, F.when(F.col("generated"), F.concat(F.lit("generated_case_"), F.lpad(n.cast("string"), 3, "0"))).otherwise(F.col(case_id)))
