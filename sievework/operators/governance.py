"""Label derivation, outcome checks and isolation rules of governed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.plans import dims

# Safe error codes by how a backend's message begins; NOT_FOUND is an equality.
ERROR_CODES = (
    ("unsupported tool:", "unsupported_tool"),
    ("unsupported arguments", "invalid_arguments"),
    ("select a transaction by ID or description", "ambiguous_transaction_selector"),
    ("select a transfer by ID or recipient", "ambiguous_transfer_selector"),
    ("expected exactly one matching synthetic", "record_match_count"),
)
NOT_FOUND = "no matching synthetic banking record"


def error_code(message: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for start, code in ERROR_CODES:
        out = out.when(F.startswith(message, F.lit(start)), code)
    return out.when(message == NOT_FOUND, "record_not_found").otherwise("backend_error")


def action_and_entity(intent: Column, path: Column, tools: Column, target: Column, n_entities: Column, explicit: Column) -> Column:
    """Supervised action and entity state of a record as ``struct<action, entity>``.

    The first rule that fits decides: no intent, policy, talk, an explicit state, a
    clarification, a single resolved entity, no tools, else execution.
    """
    def pair(action: str, entity: str | Column) -> Column:
        return F.struct(F.lit(action).alias("action"), (F.lit(entity) if isinstance(entity, str) else entity).alias("entity"))

    needs = F.when(intent.isin(list(dims.NEEDS_ENTITY)), "resolved").otherwise("not_required")
    clarify = (F.lower(F.coalesce(target, F.lit(""))) == "clarification") | (F.lower(F.coalesce(path, F.lit(""))) == "clarification")
    return (
        F.when(intent.isNull(), pair("refuse_ood", "not_required"))
        .when(intent == "policy_knowledge", pair("retrieve_policy", "not_required"))
        .when(intent.isin("conversation", "other_banking"), pair("converse", "not_required"))
        .when(explicit.isin("missing", "ambiguous"), pair("clarify", explicit))
        .when(explicit == "ineligible", pair("converse", "ineligible"))
        .when(clarify, pair("clarify", F.when(n_entities > 1, "ambiguous").otherwise("missing")))
        .when((F.lower(target) == intent) & (n_entities == 1) & F.array_contains(tools, intent), pair("execute_tool", "resolved"))
        .when(F.size(tools) == 0, pair("converse", "not_required"))
        .otherwise(pair("execute_tool", needs))
    )


def group_key(record_id: Column, split_group: Column, *parts: Column) -> Column:
    """The parts that aren't empty, bars between; else the split group, else the record's id."""
    blank = F.lit("")
    joined = F.array_join(F.filter(F.array(*(F.coalesce(p, blank) for p in parts)), lambda p: p != ""), "|")
    return F.coalesce(F.nullif(joined, blank), F.nullif(split_group, blank), record_id)


def tool_succeeded(expected: Column, executed: Column, results: Column) -> Column:
    """Whether some execution of the expected tool has neither an error nor an explicit failure.

    ``results`` are ``struct<error, success>`` by position; a missing one is no success.
    """
    good = F.zip_with(executed, results, lambda name, r: (name == expected) & r.isNotNull() & (F.coalesce(r["error"], F.lit("")) == "") & F.coalesce(r["success"], F.lit(True)))
    return F.exists(good, lambda g: F.coalesce(g, F.lit(False)))


def answer_errors(answer: Column, calls: Column) -> Column:
    """What an answer fails to state of its calls (``struct<tool, ok, value, private_id>``), in order."""
    low = F.lower(answer)
    has = lambda *words: F.reduce(F.array(*(F.contains(low, F.lit(w)) for w in words)), F.lit(False), lambda a, b: a | b)

    def one(c: Column) -> Column:
        exposed = F.when(c["private_id"].isNotNull() & F.contains(low, F.lower(c["private_id"])), F.lit("private_identifier"))
        hidden = F.when(~c["ok"] & ~has("could not", "couldn't", "unable", "not found"), F.concat(c["tool"], F.lit(":failure_hidden")))
        value = F.when(c["ok"] & c["value"].isNotNull() & ~F.contains(answer, c["value"]), F.concat(c["tool"], F.lit(":value_missing")))
        said = (
            F.when(c["tool"] == "freeze_card", has("froze"))
            .when(c["tool"] == "replace_card", has("replacement"))
            .when(c["tool"] == "dispute_transaction", has("dispute"))
            .when(c["tool"] == "cancel_transfer", has("cancelled", "canceled"))
            .otherwise(F.lit(True))
        )
        outcome = F.when(c["ok"] & ~said & F.lit(True), F.concat(c["tool"], F.lit(":outcome_missing")))
        stated = F.when(c["tool"] == "freeze_card", F.when(c["ok"] & ~has("froze", "frozen"), F.concat(c["tool"], F.lit(":outcome_missing")))).otherwise(outcome)
        return F.array_compact(F.array(exposed, hidden, value, stated))

    empty = F.trim(F.coalesce(answer, F.lit(""))) == ""
    return F.when(empty, F.array(F.lit("empty_answer"))).otherwise(F.flatten(F.transform(calls, one)))


def coreference_report(rows: DataFrame) -> DataFrame:
    """Accuracy on positives, ambiguities and pairs of ``pair_id, target, expected, calls, content`` rows.

    A positive must make exactly the expected calls; an ambiguity must make none and ask
    which card. A missing prediction (null calls) fails and counts as a parse failure.
    """
    low = F.lower(F.coalesce("content", F.lit("")))
    asks = (F.col("calls") == "") & F.contains(low, F.lit("which")) & F.contains(low, F.lit("card"))
    passed = F.coalesce(F.when(F.col("target") == "replace_card", F.col("calls") == F.col("expected")).otherwise(asks), F.lit(False))
    pairs = rows.withColumn("passed", passed).groupBy("pair_id").agg(
        F.count_if(F.col("passed") & (F.col("target") == "replace_card")).alias("p"),
        F.count_if(F.col("target") == "replace_card").alias("np"),
        F.count_if(F.col("passed") & (F.col("target") != "replace_card")).alias("a"),
        F.count_if(F.col("target") != "replace_card").alias("na"),
        F.bool_and("passed").alias("both"),
        F.count_if(F.col("calls").isNull()).alias("missing"),
    )
    return pairs.agg(
        F.sum("np").alias("positive_records"),
        F.sum("na").alias("ambiguity_records"),
        (F.sum("p") / F.sum("np")).alias("positive_accuracy"),
        (F.sum("a") / F.sum("na")).alias("ambiguity_accuracy"),
        F.avg(F.col("both").cast("double")).alias("pair_flip_accuracy"),
        F.sum("missing").alias("parse_failures"),
        F.count_if(F.col("np") + F.col("na") != 2).alias("incomplete_pairs"),
    )


def ungoverned_repeats(rows: DataFrame) -> DataFrame:
    """Repeated user texts that aren't governed counterfactuals.

    ``rows``: ``text, pair_id, target, n_cards, split, entity, history``. A text may repeat
    if each of its pairs has two rows, both targets, card counts 1 and 2, one split, one
    entity and one history form, and no two pairs share a history form or an entity.
    """
    keyed = rows.withColumn("key", F.md5(X.normalize_ascii(F.col("text"))))
    one = lambda c: F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))) == 1
    pairs = keyed.groupBy("key", "pair_id").agg(
        F.count(F.lit(1)).alias("n"),
        (
            (F.coalesce(F.first("pair_id"), F.lit("")) != "")
            & (F.count(F.lit(1)) == 2)
            & (F.count_distinct("target") == 2)
            & F.bool_and(F.col("target").isin("replace_card", "clarification"))
            & (F.min("n_cards") == 1)
            & (F.max("n_cards") == 2)
            & one("split")
            & one("entity")
            & one("history")
        ).alias("sound"),
        F.first("history").alias("history"),
        F.first("entity").alias("entity"),
    )
    groups = pairs.groupBy("key").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_pairs"), F.bool_and("sound").alias("sound"), F.count_distinct("history").alias("h"), F.count_distinct("entity").alias("e"))
    fine = F.coalesce(F.col("sound") & (F.col("h") == F.col("n_pairs")) & (F.col("e") == F.col("n_pairs")), F.lit(False))
    return groups.where(F.col("n_rows") > 1).where(~fine).select("key", "n_rows", "n_pairs")


def isolation_breaks(rows: DataFrame, kinds: dict[str, Column], apart: tuple[str, str] = ("shadow", "governed")) -> DataFrame:
    """Values of each kind that rows of both sides (column ``side``) have."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items())))
    pairs = rows.select("side", each.alias("e")).select("side", "e.*").where("value IS NOT NULL AND value <> ''")
    both = pairs.groupBy("kind", "value").agg(F.bool_or(F.col("side") == apart[0]).alias("a"), F.bool_or(F.col("side") == apart[1]).alias("b"))
    return both.where("a AND b").select("kind", "value")


def compatible_tuples(rows: DataFrame, legal: DataFrame) -> DataFrame:
    """Rows whose six label positions are a legal tuple, by a semi-join with the fixed table."""
    keys = ["intent_index", "domain_index", "lane_index", "family_index", "action_index", "entity_index"]
    return rows.join(F.broadcast(legal.select(*keys)), keys, "left_semi")


def exposed_tools(contract: Column) -> Column:
    """Tools a record exposes: its contract's, all for none; an unknown or repeated name is null."""
    public = F.array(*map(F.lit, dims.TOOL_ARGUMENTS))
    ok = (F.size(F.array_except(contract, public)) == 0) & (F.size(F.array_distinct(contract)) == F.size(contract))
    return F.when(contract.isNull(), public).when(ok, contract)


def provenance(settings: DataFrame, run: str, name: str, value: str) -> DataFrame:
    """One fingerprint per run of its settings: the digest of ``name=value`` lines in order of the names."""
    line = F.concat(F.col(name), F.lit("="), F.coalesce(F.col(value).cast("string"), F.lit("null")))
    return settings.groupBy(run).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("fingerprint"), F.count_distinct(name).alias("n_settings"))


def may_resume(stored: DataFrame, wanted: DataFrame, run: str) -> DataFrame:
    """Runs with ``resumes``: whether a stored run was made under the wanted settings; an unknown run may not."""
    told = stored.select(run, F.col("fingerprint").alias("__stored"))
    return wanted.join(told, run, "left").select(run, F.coalesce(F.col("fingerprint") == F.col("__stored"), F.lit(False)).alias("resumes"))
