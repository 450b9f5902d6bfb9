"""Operators on supervised records: one row per record with its messages as an array.

A message is ``struct<role, content, loss, call_id, tool, arguments>``: an assistant message
with a ``tool`` is a call, a tool message answers the call of its ``call_id``. A record's
messages are few, so rules over them are array expressions and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.plans import dims

MESSAGES = "array<struct<role:string,content:string,loss:boolean,call_id:string,tool:string,arguments:map<string,string>>>"
#: Arguments with their type (``int`` or ``text``), bounds or pattern, and whether they are required.
ARGUMENT_RULES = {
    "list_transactions": {"limit": ("int", 1, 20, False)},
    "cancel_transfer": {"recipient": ("text", r"\S", None, True)},
    "dispute_transaction": {"description": ("text", r"\S", None, True)},
    "freeze_card": {"last4": ("text", r"\A\d{4}\z", None, True)},
    "replace_card": {"last4": ("text", r"\A\d{4}\z", None, True)},
}
IGNORED = -100


def is_call(m: Column) -> Column:
    return (m["role"] == "assistant") & m["tool"].isNotNull()


def first_call(messages: Column) -> Column:
    """One-based position of the first call, 0 for none."""
    return F.array_position(F.transform(messages, is_call), F.lit(True))


def before_first_call(messages: Column) -> Column:
    """The messages before the first call, all of them where there is none."""
    at = first_call(messages)
    return F.when(at == 0, messages).otherwise(F.slice(messages, F.lit(1), F.greatest(F.lit(0), (at - 1).cast("int"))))


def supervised_results(messages: Column) -> Column:
    """Tool messages that answer calls under loss."""
    ids = F.transform(F.filter(messages, lambda m: is_call(m) & m["loss"]), lambda m: m["call_id"])
    return X.let(ids, lambda known: F.filter(messages, lambda m: (m["role"] == "tool") & F.array_contains(known, m["call_id"])))


def last_of(messages: Column, role: str) -> Column:
    """One-based position of the last message of a role without a call, 0 for none."""
    hits = F.filter(F.transform(messages, lambda m, i: F.when((m["role"] == role) & m["tool"].isNull(), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(hits), F.lit(0))


def line(m: Column) -> Column:
    return F.concat_ws("|", m["role"], F.coalesce(m["content"], F.lit("")), F.coalesce(m["call_id"], F.lit("")), F.coalesce(m["tool"], F.lit("")))


def immutable_digest(messages: Column, *more: Column) -> Column:
    """Digest of all that a rewriter may not touch: everything but the last user and the final assistant message."""
    free = F.array(last_of(messages, "user"), last_of(messages, "assistant"))
    lines = X.let(free, lambda f: F.transform(F.filter(messages, lambda m, i: ~F.array_contains(f, i + 1)), line))
    return F.sha2(F.concat_ws("\n", F.array_join(lines, "\n"), *more), 256)


def semantic_digest(messages: Column) -> Column:
    """Digest with the last user message masked: equal for records that differ in its wording alone."""
    lines = X.let(last_of(messages, "user"), lambda at: F.transform(messages, lambda m, i: F.when(i + 1 == at, F.lit("user|*||")).otherwise(line(m))))
    return F.sha2(F.array_join(lines, "\n"), 256)


def violations(records: DataFrame, key: str = "record_id", messages: str = "messages") -> DataFrame:
    """Every broken rule of every record, one row each."""
    m = F.col(messages)
    calls = F.filter(m, is_call)
    after = F.transform(m, lambda x, i: F.when(is_call(x), F.coalesce(F.get(m, i + 1)["role"] == "tool", F.lit(False)) & F.coalesce(F.get(m, i + 1)["call_id"] == x["call_id"], F.lit(False))).otherwise(True))
    answered = F.transform(m, lambda x, i: F.when(x["role"] == "tool", (i > 0) & F.coalesce(F.get(m, i - 1)["call_id"] == x["call_id"], F.lit(False))).otherwise(True))
    final = F.element_at(m, -1)
    plain = X.normalize_ascii(F.coalesce(final["content"], F.lit("")))
    ids = F.transform(calls, lambda c: c["call_id"])
    rules = {
        "no_messages": F.size(m) == 0,
        "final_not_assistant": (F.size(m) > 0) & ((final["role"] != "assistant") | final["tool"].isNotNull()),
        "final_blank": (F.size(m) > 0) & (final["role"] == "assistant") & (plain == ""),
        "final_forbidden_term": F.exists(F.array(*map(F.lit, X.FORBIDDEN_TERMS)), lambda t: F.contains(plain, t)),
        "call_without_result": F.exists(after, lambda ok: ~ok),
        "result_without_call": F.exists(answered, lambda ok: ~ok),
        "repeated_call_id": F.size(F.array_distinct(ids)) < F.size(ids),
        "loss_outside_assistant": F.exists(m, lambda x: x["loss"] & (x["role"] != "assistant")),
        "nothing_under_loss": ~F.exists(m, lambda x: x["loss"]),
        "unknown_tool": F.exists(calls, lambda c: ~c["tool"].isin(list(dims.TOOL_ARGUMENTS))),
    }
    return records.select(key, F.explode(F.array_compact(F.array(*(F.when(F.size(m) == 0, F.lit(k) if k == "no_messages" else F.lit(None)).when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))


def argument_errors(calls: DataFrame, key: str) -> DataFrame:
    """Errors of each call's arguments (``tool, arguments``): unknown, missing, of a wrong type, out of bounds."""
    table = F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(a).alias("name"), F.lit(kind).alias("kind"), F.lit(low if kind == "int" else None).cast("bigint").alias("low"), F.lit(high).cast("bigint").alias("high"), F.lit(low if kind == "text" else None).cast("string").alias("pattern"), F.lit(required).alias("required")) for t, args in ARGUMENT_RULES.items() for a, (kind, low, high, required) in args.items()))
    own = F.filter(table, lambda r: r["tool"] == F.col("tool"))

    def check(r: Column) -> Column:
        value = F.try_element_at("arguments", r["name"])
        number = value.try_cast("bigint")
        return (
            F.when(value.isNull() & r["required"], F.concat(F.lit("missing:"), r["name"]))
            .when(value.isNotNull() & (r["kind"] == "int") & number.isNull(), F.concat(F.lit("type:"), r["name"]))
            .when(value.isNotNull() & (r["kind"] == "int") & ~number.between(r["low"], r["high"]), F.concat(F.lit("bounds:"), r["name"]))
            .when(value.isNotNull() & (r["kind"] == "text") & ~F.regexp_like(value, r["pattern"]), F.concat(F.lit("bounds:"), r["name"]))
        )

    extra = F.transform(F.array_except(F.map_keys("arguments"), F.transform(own, lambda r: r["name"])), lambda k: F.concat(F.lit("unknown:"), k))
    found = F.array_sort(F.concat(F.array_compact(F.transform(own, check)), extra))
    return calls.withColumn("errors", F.array_join(found, ",")).where("errors <> ''").select(key, "tool", "errors")


def strip_private(arguments: Column, allowed: tuple[str, ...] = ("case_id",)) -> Column:
    """The map without keys that end in ``_id``, but for those allowed."""
    return F.map_filter(arguments, lambda k, _: ~F.endswith(k, F.lit("_id")) | k.isin(list(allowed)))


def token_labels(messages: Column) -> Column:
    """A label per white-space token: its position under loss, IGNORED elsewhere."""
    tokens = F.flatten(F.transform(messages, lambda m: F.transform(F.filter(F.split(F.coalesce(m["content"], F.lit("")), r"\s+"), lambda w: w != ""), lambda w: m["loss"])))
    return F.transform(tokens, lambda on, i: F.when(on, i).otherwise(F.lit(IGNORED)))


def overlay_transcripts(utterances: DataFrame, records: DataFrame) -> DataFrame:
    """Records with the user's words replaced by an accepted transcript; all broken rules beside it.

    ``utterances``: ``record_id, transcript, start_ms, end_ms, confidence, reviewed``.
    """
    rules = {
        "unknown_record": F.col("messages").isNull(),
        "blank_transcript": F.trim("transcript") == "",
        "interval": ~((F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("end_ms"))),
        "confidence": ~F.col("confidence").between(0.0, 1.0),
        "not_reviewed": ~F.col("reviewed"),
    }
    joined = utterances.join(records.select("record_id", "messages"), "record_id", "left")
    broken = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    at = last_of(F.col("messages"), "user")
    changed = F.transform("messages", lambda m, i: F.when(i + 1 == at, F.struct(m["role"].alias("role"), F.col("transcript").alias("content"), *(m[c].alias(c) for c in ("loss", "call_id", "tool", "arguments")))).otherwise(m))
    return joined.withColumns({"broken": F.array_join(broken, ","), "overlaid": F.when(F.size(broken) == 0, changed)})


def replay(cards: Column, calls: Column) -> Column:
    """Cards (``last4, status``) after ordered calls (``tool, last4``), and whether each call worked.

    A freeze or replacement changes the first card of its number that is active or frozen,
    without a number the first such card; any other call, or a number that no such card
    has, fails and changes nothing.
    """
    start = F.struct(cards.alias("cards"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc: Column, call: Column) -> Column:
        new = F.when(call["tool"] == "freeze_card", "frozen").when(call["tool"] == "replace_card", "replacement_pending")
        at = F.array_position(F.transform(acc["cards"], lambda c: F.coalesce(c["last4"] == call["last4"], F.lit(True)) & c["status"].isin("active", "frozen")), F.lit(True))
        good = new.isNotNull() & (at > 0)
        after = F.transform(acc["cards"], lambda c, i: F.when(good & (i + 1 == at), F.struct(c["last4"].alias("last4"), new.alias("status"))).otherwise(c))
        return F.struct(after.alias("cards"), F.concat(acc["ok"], F.array(good)).alias("ok"))

    return F.aggregate(calls, start, step)


def stop_reason(passes: Column, max_calls: int = 3) -> Column:
    """Why a trajectory of passes (``calls, parse_error, matched``) ended, from the first pass that ends it."""
    start = F.struct(F.lit(0).alias("calls"), F.lit(None).cast("string").alias("why"))

    def step(acc: Column, p: Column) -> Column:
        total = acc["calls"] + p["calls"]
        why = F.when(p["parse_error"], "parse_error").when(p["calls"] == 0, "final_answer").when(total > max_calls, "max_tool_calls").when(~p["matched"], "unmatched_tool_call")
        return F.when(acc["why"].isNotNull(), acc).otherwise(F.struct(total.alias("calls"), why.alias("why")))

    return F.aggregate(passes, start, step, lambda acc: F.coalesce(acc["why"], F.lit("max_tool_passes")))


def policy_answer_errors(answer: Column, allowed: Column, evidence: Column) -> Column:
    """Errors of a policy answer, in a fixed order.

    It must not be empty or name internal systems, must cite a policy, and only those
    ``allowed``; every quantity outside its citations must be one of the ``evidence``, however
    both write it: with separators, trailing zeros or as a word. Currency and percent signs count.
    """
    blank = F.array().cast("array<string>")
    returned = F.filter(F.coalesce(allowed, blank), lambda c: F.trim(c) != "")

    def told(t: Column) -> Column:
        """Errors of an answer whose text, citations and unproved quantities are known."""
        text, cited, claims = t["text"], t["cited"], t["claims"]
        empty = F.trim(text) == ""
        rules = F.array(
            F.when(empty, "empty"),
            F.when(F.size(returned) == 0, "no_evidence"),
            F.when(F.size(cited) == 0, "no_citation"),
            F.when(F.size(F.array_except(cited, returned)) > 0, "citation_not_allowed"),
            F.when((F.size(cited) > 0) & ~F.arrays_overlap(cited, returned), "nothing_returned_cited"),
            F.when(F.size(claims) > 0, "number_without_evidence"),
        )
        internal = F.transform(F.when(empty, blank).otherwise(X.internal_labels(text)), lambda x: F.concat(F.lit("internal_"), x))
        return F.array_compact(F.concat(F.slice(rules, F.lit(1), F.lit(1)), internal, F.slice(rules, F.lit(2), F.lit(5))))

    def read(text: Column) -> Column:
        claims = F.array_except(X.quantities(F.regexp_replace(text, X.CITATION, "")), X.quantities(F.coalesce(evidence, F.lit(""))))
        return X.let(F.struct(text.alias("text"), X.citations(text).alias("cited"), claims.alias("claims")), told)

    return X.let(F.coalesce(answer, F.lit("")), read)
