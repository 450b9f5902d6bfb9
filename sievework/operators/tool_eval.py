"""Parsing and scoring of tool calls in model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.functions.numbers import ratio_or_null
from sievework.plans import dims

BLOCK = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
#: Longest to shortest: the failures in the order in which they are looked for.
FAILURES = ("malformed tool-call block", "tool call is not valid JSON", "tool call must be a JSON object", "tool call requires a function name", "tool-call arguments must be an object")


def parse(rows: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Rows with ``calls`` (array of name and canonical arguments), ``content`` and ``parse_failure``.

    The first block that is wrong decides the failure, and a failed output has no calls.
    Arguments are one text, ``key=value`` by key, so that calls compare exactly.
    """
    blocks = F.regexp_extract_all(F.col(raw), F.lit(BLOCK), F.lit(1))
    marked = F.contains(raw, F.lit("<tool_call")) | F.contains(raw, F.lit("</tool_call>"))

    def one(value: Column) -> Column:
        name, arguments = F.try_variant_get(value, "$.name", "string"), F.try_variant_get(value, "$.arguments", "variant")
        kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
        fail = (
            F.when(value.isNull(), FAILURES[1])
            .when(~F.startswith(kind(value), F.lit("OBJECT")), FAILURES[2])
            .when((kind(F.try_variant_get(value, "$.name", "variant")) != "STRING") | (F.trim(F.coalesce(name, F.lit(""))) == ""), FAILURES[3])
            .when(arguments.isNotNull() & ~F.startswith(kind(arguments), F.lit("OBJECT")), FAILURES[4])
        )
        pairs = F.map_entries(F.coalesce(F.try_variant_get(value, "$.arguments", "map<string,string>"), F.create_map().cast("map<string,string>")))
        return F.struct(F.trim(name).alias("name"), F.transform(F.array_sort(pairs), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))).alias("arguments"), fail.alias("failure"))

    read = rows.withColumns({"__c": F.transform(F.transform(blocks, lambda b: F.try_parse_json(b)), one), "__m": marked & (F.size(blocks) == 0)})
    failure = F.when(F.col("__m"), FAILURES[0]).otherwise(F.get(F.filter(F.transform("__c", lambda c: c["failure"]), lambda f: f.isNotNull()), F.lit(0)))
    none = F.array().cast("array<struct<name:string,arguments:array<struct<key:string,value:string>>>>")
    good = F.transform("__c", lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"))).cast("array<struct<name:string,arguments:array<struct<key:string,value:string>>>>")
    whole = F.when(failure.isNull(), F.regexp_replace(F.regexp_replace(F.col(raw), BLOCK, ""), r"\A\s+|\s+\z", "")).otherwise(F.col(raw))
    return read.withColumns({"parse_failure": failure, "calls": F.when(failure.isNull(), good).otherwise(none), "content": whole}).drop("__c", "__m")


def call_text(calls: Column) -> Column:
    """Calls as one text, for exact comparison in order."""
    return F.array_join(F.transform(calls, lambda c: F.concat(c["name"], F.lit("("), F.array_join(F.transform(c["arguments"], lambda a: F.concat(a["key"], F.lit("="), F.coalesce(a["value"], F.lit("null")))), ","), F.lit(")"))), ";")


def call_names(calls: Column) -> Column:
    return F.array_join(F.transform(calls, lambda c: c["name"]), ";")


def call_problems(calls: Column) -> Column:
    """Calls of unknown tools or with arguments that are private or that their tool lacks, with their position."""
    allowed = F.create_map(*(x for k, v in dims.TOOL_ARGUMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))

    def one(c: Column, i: Column) -> Column:
        known = F.try_element_at(allowed, c["name"])
        keys = F.transform(c["arguments"], lambda a: a["key"])
        private = F.array_intersect(keys, F.array(*map(F.lit, dims.PRIVATE_ARGUMENTS)))
        extra = F.array_except(F.array_except(keys, F.coalesce(known, F.array().cast("array<string>"))), private)
        reason = F.when(known.isNull(), "unknown_tool").when(F.size(private) > 0, "private_arguments").when(F.size(extra) > 0, "unsupported_arguments")
        return F.struct(i.cast("bigint").alias("position"), c["name"].alias("tool"), reason.alias("reason"), F.array_join(F.array_sort(private), ",").alias("private"), F.array_join(F.array_sort(extra), ",").alias("unsupported"))

    return F.filter(F.transform(calls, one), lambda p: p["reason"].isNotNull())


def manifest_failures(parsed: DataFrame, key: str) -> DataFrame:
    """One row per call that :func:`call_problems` finds."""
    return parsed.select(key, F.inline(call_problems(F.col("calls"))))


def created_at_grounded(held: Column, value: Column) -> Column:
    """Whether folded text names a timestamp's day (ISO or ``month d, yyyy``), its HH:MM and, for one in ``Z``, UTC."""
    moment = F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))
    clock = F.date_format(moment, "HH:mm")
    day = F.contains(held, F.date_format(moment, "yyyy-MM-dd")) | F.contains(held, F.lower(F.date_format(moment, "MMMM d, yyyy")))
    zone = ~F.endswith(value, F.lit("Z")) | F.regexp_like(held, F.concat(F.lit(r"\butc\b|"), clock, F.lit(r"(?::\d{2})?z\b")))
    return F.when(moment.isNull(), F.contains(held, X.fold_spaces(value))).otherwise(day & F.contains(held, clock) & zone)


def grounded(content: Column, required: Column, forbidden: Column) -> Column:
    """Whether the folded content has every required fact and no forbidden one.

    A fact ``key=value`` is judged by its key: counts and limits always hold, a frozen or
    pending-replacement status may be worded otherwise, a missing ``last4`` is asked for as
    the last four digits, a refusal of private data says so and names it, a domain is named
    as banking, a case's creation by day and time; any other must stand in the content.
    """

    def judge(held: Column) -> Column:
        has = lambda t: F.contains(held, F.lit(t) if isinstance(t, str) else t)
        some = lambda *words: F.reduce(F.array(*map(has, words)), F.lit(False), lambda p, q: p | q)

        def fact(f: Column) -> Column:
            key = F.substring_index(f, "=", 1)
            raw = F.substr(f, F.length(key) + 2, F.length(f))
            value = X.fold_spaces(F.replace(raw, F.lit("_"), F.lit(" ")))
            structured = (
                F.when(key.isin("accounts.count", "transactions.limit"), F.lit(True))
                .when(F.endswith(key, F.lit(".status")) & (value == "replacement pending"), has("replacement") & has("pending"))
                .when(F.endswith(key, F.lit(".status")) & (value == "frozen"), some("frozen", "froze"))
                .when(key == "transaction.disputed", (value != "true") | has("disput"))
                .when(key == "missing_field", (value != "last4") | has("last four"))
                .when(key == "error.code", (value != "backend error") | some("could not", "couldn't", "unable", "not able"))
                .when(key == "private_data_refused", (value != "true") | (some("cannot", "can't", "unable", "will not") & some("account number", "customer id")))
                .when(key == "domain", (value != "out of domain") | some("retail banking", "financial services"))
                .when(key == "case.created_at", created_at_grounded(held, raw))
                .otherwise(has(value))
            )
            return F.when(F.contains(f, F.lit("=")), structured).otherwise(has(X.fold_spaces(f)))

        return F.forall(required, fact) & ~F.exists(forbidden, lambda f: has(X.fold_spaces(f)))

    return X.let(X.fold_spaces(content), judge)


def policy_pass(content: Column, failed: Column, n_calls: Column, citations: Column, facts: Column, forbidden: Column) -> Column:
    """An answer from policy: exactly the expected citations, seven words at least, grounded, no call."""
    want = F.array_sort(F.array_distinct(F.filter(citations, lambda c: F.trim(c) != "")))
    long_enough = F.regexp_count(content, F.lit("[A-Za-z0-9]+")) >= 7
    return F.coalesce(~failed & (n_calls == 0) & (F.size(want) > 0) & (X.citations(content) == want) & long_enough & grounded(content, facts, forbidden), F.lit(False))


def clarification_pass(content: Column, failed: Column, n_calls: Column, missing_field: Column) -> Column:
    """A question that names the missing field and asks for no credential; never without a missing field."""
    marker = F.when(missing_field == "last4", "last four").otherwise(X.fold_spaces(missing_field))
    return F.coalesce(~failed & (n_calls == 0) & F.contains(X.fold_spaces(content), marker) & ~X.requests_credentials(content), F.lit(False))


def path_pass(content: Column, failed: Column, n_calls: Column, markers: Column, forbidden: Column) -> Column:
    """An answer off the tools' path: no call, every marker, nothing forbidden."""
    return F.coalesce(~failed & (n_calls == 0) & grounded(content, markers, forbidden), F.lit(False))


def missing_field(facts: Column) -> Column:
    """What the first ``missing_field`` fact names; null without one."""
    first = F.get(F.filter(facts, lambda f: F.startswith(f, F.lit("missing_field="))), F.lit(0))
    return F.substr(first, F.lit(len("missing_field=") + 1))


def counters(rows: DataFrame) -> DataFrame:
    """The fourteen metrics ``name, numerator, denominator, score`` of judged rows, in one aggregation.

    Rows have ``failed, names_ok, args_ok, n_expected, n_calls, n_bad`` (calls beyond the
    manifest), ``executable`` (whether the call may be replayed), ``state_ok``, ``grounded, n_facts,
    path, clarified, faq_ok, policy_ok, path_ok, asks`` (credentials) and ``requires_tool``. Names and
    arguments weigh by expected calls, private arguments by calls made, others by rows.
    """
    c, one = F.col, F.lit(1)
    ran = ~c("failed") & (c("n_bad") == 0) & c("args_ok") & c("state_ok")
    at = lambda *paths: c("path").isin(*paths)
    rules = {
        "tool_name_accuracy": (c("n_expected") > 0, ~c("failed") & c("names_ok"), c("n_expected")),
        "tool_argument_accuracy": (c("n_expected") > 0, ~c("failed") & c("args_ok"), c("n_expected")),
        "executable_tool_success": (c("executable"), ran, one),
        "multi_tool_exact_sequence": (c("n_expected") > 1, ~c("failed") & c("args_ok"), one),
        "clarification_appropriateness": (at("clarification"), c("clarified"), one),
        "grounded_final_factuality": (c("n_facts") > 0, c("grounded") & ~c("failed"), one),
        "malformed_tool_call_rate": (F.lit(True), c("failed"), one),
        "credential_request_rate": (F.lit(True), c("asks"), one),
        "no_tool_faq_quality": (at("faq"), c("faq_ok") & (c("n_calls") == 0) & ~c("failed"), one),
        "grounded_policy_quality": (at("retrieval_grounded_policy"), c("policy_ok"), one),
        "ood_small_talk_response_path": (at("ood", "small_talk"), c("path_ok"), one),
        "in_domain_false_refusal": (c("requires_tool"), (c("n_calls") == 0) & ~c("failed"), one),
        "ood_false_accept": (at("ood"), c("n_calls") > 0, one),
    }
    sums = [F.struct(F.lit(k).alias("name"), F.coalesce(F.sum(F.when(base & ok, w)), F.lit(0)).cast("bigint").alias("numerator"), F.coalesce(F.sum(F.when(base, w)), F.lit(0)).cast("bigint").alias("denominator")) for k, (base, ok, w) in rules.items()]
    sums.append(F.struct(F.lit("unsupported_private_arguments").alias("name"), F.coalesce(F.sum("n_bad"), F.lit(0)).cast("bigint").alias("numerator"), F.coalesce(F.sum("n_calls"), F.lit(0)).cast("bigint").alias("denominator")))
    return rows.agg(F.array(*sums).alias("m")).select(F.inline("m")).withColumn("score", ratio_or_null(c("numerator"), c("denominator")))


def matched_prefix(expected: Column, got: Column) -> Column:
    """How many calls agree from the first on."""
    same = F.zip_with(expected, got, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("bigint")


def with_predictions(records: DataFrame, predictions: DataFrame, key: str = "record_id", raw: str = "raw_output") -> DataFrame:
    """Records with the stored output of a model; one without is empty and ``predicted`` says so.

    A model that runs elsewhere leaves its outputs in a table; a record may have one alone.
    """
    once = predictions.select(key, raw).groupBy(key).agg(F.max(raw).alias(raw), F.count(F.lit(1)).alias("__n"))
    single = once.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("a record has several predictions")).cast("boolean"))).drop("__n")
    return records.join(single, key, "left").withColumns({"predicted": F.col(raw).isNotNull(), raw: F.coalesce(raw, F.lit(""))})
