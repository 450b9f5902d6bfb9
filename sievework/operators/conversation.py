"""Message-sequence operators over rows by turn (``conv_id, turn, role, text``).

They use windows per conversation, so that a conversation's rows meet but are never
collected into one value, except where the result is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import text as X

# Words that mark how a message relates to the dialogue.
DEICTIC = ("it", "that", "this", "those", "them", "one", "again", "there")
REPAIR = ("no", "not", "wrong", "instead", "asked")
CONFIRM = ("yes", "yeah", "yep", "4821", "that", "one")
RESUME = ("continue", "resume", "back", "return")
SHORT = 6
RELATION_FLAGS = ("context_dependent", "agent_repair", "topic_shift", "clarification_answer", "resume_previous_service")


def _has_text(c: str = "text") -> Column:
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))


def last_user(rows: DataFrame) -> DataFrame:
    """The last user message that isn't blank, with its turn."""
    asked = rows.where((F.col("role") == "user") & _has_text())
    return asked.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def final_assistant(rows: DataFrame) -> DataFrame:
    """The last assistant message without a tool call."""
    said = rows.where((F.col("role") == "assistant") & _has_text() & ~F.contains("text", F.lit("<tool_call")))
    return said.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def with_current(rows: DataFrame) -> DataFrame:
    """Rows with ``current_turn``: the turn of the last user message that isn't blank."""
    asked = F.when((F.col("role") == "user") & _has_text(), F.col("turn"))
    return rows.withColumn("current_turn", F.max(asked).over(Window.partitionBy("conv_id")))


def visible_history(rows: DataFrame) -> DataFrame:
    """User and assistant messages, none blank, before the last user message."""
    return with_current(rows).where((F.col("turn") < F.col("current_turn")) & F.col("role").isin("user", "assistant") & _has_text())


def exchanges(rows: DataFrame) -> DataFrame:
    """Complete exchanges of the history: an assistant message right after a user message.

    A later user message replaces one that waits; an assistant message with none waiting
    is left out. ``back`` counts from the newest exchange, 1 first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role")
    paired = visible_history(rows).withColumns({"before": F.lag("role").over(order), "user_text": F.lag("text").over(order), "user_turn": F.lag("turn").over(order)})
    done = paired.where((F.col("role") == "assistant") & (F.col("before") == "user"))
    return done.select("conv_id", "user_turn", "user_text", F.col("turn").alias("assistant_turn"), F.col("text").alias("assistant_text"), F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("back"))


def router_input(rows: DataFrame, keep: int = 3, states: DataFrame | None = None) -> DataFrame:
    """The text a router reads: a state that matters, the current message, then up to ``keep`` exchanges, newest first."""
    lines = F.concat(F.lit("[PREVIOUS_ASSISTANT]\n"), F.col("assistant_text"), F.lit("\n[PREVIOUS_USER]\n"), F.col("user_text"))
    past = exchanges(rows).where(F.col("back") <= keep).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("back", lines.alias("line")))), lambda x: x["line"]), "\n").alias("past"))
    now = last_user(rows).select("conv_id", F.concat(F.lit("[CURRENT_USER]\n"), F.col("text")).alias("now"))
    whole = now.join(past, "conv_id", "left")
    whole = whole.withColumn("header", F.lit(None).cast("string")) if states is None else whole.join(state_header(states), "conv_id", "left")
    return whole.select("conv_id", F.concat_ws("\n", "header", "now", "past").alias("router_text"))


def turn_groups(rows: DataFrame) -> DataFrame:
    """Rows with ``group_no``: a group begins at each user message; rows before the first are dropped."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("group_no", F.sum((F.col("role") == "user").cast("int")).over(order)).where(F.col("group_no") > 0)


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def suffix_budget(rows: DataFrame, budget: int) -> DataFrame:
    """The longest suffix that begins at a user message and fits with the system prefix; it must hold an assistant message."""
    tail = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role")).rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.withColumn("n", token_count(F.col("text")))
    prefix = F.sum(F.when(F.col("role") == "system", F.col("n")).otherwise(0)).over(Window.partitionBy("conv_id"))
    run = sized.withColumn("system_tokens", prefix).where("role <> 'system'").withColumns({"suffix": F.sum("n").over(tail), "trained": F.sum((F.col("role") == "assistant").cast("int")).over(tail)})
    fits = run.where((F.col("role") == "user") & (F.col("suffix") + F.col("system_tokens") <= budget) & (F.col("trained") > 0))
    return fits.groupBy("conv_id").agg(F.min("turn").alias("start_turn"), (F.max("suffix") + F.max("system_tokens")).alias("tokens"))


def greedy_budget(rows: DataFrame, budget: int, pinned: DataFrame | None = None) -> DataFrame:
    """Groups kept within a token budget: the newest and those pinned always, then newest to oldest, skipping any too big.

    A group that doesn't fit is skipped and older ones may still fit, so this is a fold
    over one conversation's groups (a few numbers each), not a running sum. ``pinned`` has
    ``conv_id, group_no`` of groups that must stay, such as a pending service's first exchange;
    with it the result tells ``over_budget`` where what must stay is too much alone.
    """
    groups = turn_groups(rows).groupBy("conv_id", "group_no").agg(F.sum(token_count(F.col("text"))).alias("n"))
    if pinned is None:
        held = groups.withColumn("pin", F.lit(False))
    else:
        held = groups.join(pinned.select("conv_id", F.col("group_no"), F.lit(True).alias("pin")).distinct(), ["conv_id", "group_no"], "left").withColumn("pin", F.coalesce("pin", F.lit(False)))
    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct("group_no", "n", "pin"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def fold(listed: Column) -> Column:
        must = F.filter(listed, lambda g, i: (i == 0) | g["pin"])
        first = F.aggregate(must, start, lambda acc, g: F.struct((acc["used"] + g["n"]).alias("used"), F.concat(acc["kept"], F.array(g["group_no"])).alias("kept")))

        def rest(begun: Column) -> Column:
            step = lambda acc, g: F.when(acc["used"] + g["n"] <= budget, F.struct((acc["used"] + g["n"]).alias("used"), F.concat(acc["kept"], F.array(g["group_no"])).alias("kept"))).otherwise(acc)
            done = F.aggregate(F.filter(listed, lambda g, i: ~((i == 0) | g["pin"])), begun, step)
            return F.struct(done.alias("f"), (begun["used"] > budget).alias("over"))

        return X.let(first, rest)

    folded = held.groupBy("conv_id").agg(newest_first.alias("g")).select("conv_id", fold(F.col("g")).alias("r"))
    out = folded.select("conv_id", F.col("r.f.used").alias("tokens"), F.array_join(F.array_sort("r.f.kept"), ",").alias("groups_kept"), F.col("r.over").alias("over_budget"))
    return out.drop("over_budget") if pinned is None else out


def relations(rows: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Relations of the last user message to its history, as flags, a multi-hot string and an example kind.

    ``states`` has per conversation the dialogue state before that message,
    ``pending_servicing`` (null or empty for none) and ``knowledge_detour_active``, and
    ``topic_shift`` where the row's builder states one. A conversation without a state resumes nothing.
    """
    past = visible_history(rows).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_history"))
    said = last_user(rows).join(past, "conv_id", "left").withColumns({"n_history": F.coalesce("n_history", F.lit(0)), "w": F.array_distinct(X.words(F.col("text")))})
    if states is None:
        said = said.withColumns({"waits": F.lit(False), "shifts": F.lit(False)})
    else:
        waits = F.coalesce(F.col("knowledge_detour_active") & (F.col("pending_servicing") != ""), F.lit(False))
        said = said.join(states.select("conv_id", waits.alias("waits"), F.coalesce("topic_shift", F.lit(False)).alias("shifts")), "conv_id", "left").fillna(False, ["waits", "shifts"])
    any_of = lambda values: F.arrays_overlap("w", F.array(*map(F.lit, values)))
    flagged = said.withColumns(
        {
            "context_dependent": (F.col("n_history") > 0) & ((F.size("w") <= SHORT) | any_of(DEICTIC)),
            "agent_repair": any_of(REPAIR),
            "topic_shift": F.col("shifts"),
            "clarification_answer": (F.col("n_history") > 0) & any_of(CONFIRM) & (F.size("w") <= SHORT),
            "resume_previous_service": F.col("waits") & any_of(RESUME),
        }
    )
    kind = F.when(F.col("agent_repair"), "agent_repair").when(F.col("clarification_answer"), "clarification_answer").when(F.col("context_dependent"), "contextual_followup").when(F.col("n_history") > 0, "visible_multiturn").otherwise("sft_single_turn")
    hot = F.concat(*(F.col(c).cast("int").cast("string") for c in RELATION_FLAGS))
    return flagged.select("conv_id", "n_history", *RELATION_FLAGS, hot.alias("multi_hot"), kind.alias("example_kind"))


def state_header(states: DataFrame) -> DataFrame:
    """``conv_id, header`` of the states that matter: sorted compact JSON of those with a pending service or a detour."""
    made = F.to_json(F.struct(F.col("knowledge_detour_active"), F.col("pending_servicing")), {"ignoreNullFields": "false"})
    matters = F.coalesce(F.col("pending_servicing") != "", F.lit(False)) | F.coalesce(F.col("knowledge_detour_active"), F.lit(False))
    return states.where(matters).select("conv_id", F.concat(F.lit("[PRIOR_DIALOGUE_STATE]\n"), made).alias("header"))


def dual_head_input(rows: DataFrame) -> DataFrame:
    """The text a two-headed router reads: the current message and the user message before it."""
    asked = rows.where((F.col("role") == "user") & _has_text())
    order = Window.partitionBy("conv_id").orderBy("turn")
    seen = asked.withColumn("previous", F.lag("text").over(order)).withColumn("last", F.max("turn").over(Window.partitionBy("conv_id"))).where("turn = last")
    before = F.when(_has_text("previous"), F.concat(F.lit("\n[PREVIOUS_USER]\n"), F.trim("previous"))).otherwise("")
    return seen.select("conv_id", F.concat(F.lit("[CURRENT]\n"), F.trim("text"), before).alias("router_text"))


def intent_of(text: Column) -> Column:
    """Intent by the first keyword rule that fits."""
    t = F.lower(text)
    has = lambda *w: F.coalesce(F.reduce(F.array(*(F.contains(t, F.lit(x)) for x in w)), F.lit(False), lambda a, b: a | b), F.lit(False))
    return (
        F.when(has("freeze", "stolen"), "freeze_card")
        .when(has("replace"), "replace_card")
        .when(has("dispute"), "dispute_transaction")
        .when(has("cancel_transfer") | (has("cancel") & has("transfer")), "cancel_transfer")
        .when(has("case", "address"), "view_service_cases")
        .when(has("faq", "policy", "mortgage"), "policy_knowledge")
        .when(has("card"), "view_cards")
        .when(has("transaction", "purchase"), "view_transactions")
        .when(has("transfer"), "view_transfers")
        .when(has("account", "balance"), "view_accounts")
        .when(has("conversation", "greeting", "hello"), "conversation")
        .otherwise("other_banking")
    )


def collate(rows: DataFrame, batch: int = 8) -> DataFrame:
    """Right-padding of token counts to the longest conversation of each batch of ids."""
    sized = rows.groupBy("conv_id").agg(F.sum(token_count(F.col("text"))).alias("n_tokens"))
    return sized.withColumn("batch_no", F.floor(F.col("conv_id") / batch).cast("bigint")).withColumn("padding", F.max("n_tokens").over(Window.partitionBy("batch_no")) - F.col("n_tokens"))


def padded(rows: DataFrame, tokens: str, labels: str, by: str, pad: int = 0, ignored: int = -100) -> DataFrame:
    """``rows`` right-padded to the longest of their batch ``by``: token ids with ``pad``, labels with ``ignored``, and an ``attention`` mask."""
    longest = F.max(F.size(tokens)).over(Window.partitionBy(by))
    fill = lambda c, value: F.concat(F.col(c), F.array_repeat(F.lit(value).cast("bigint"), F.col("__left")))
    ones = F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), F.col("__left")))
    sized = rows.withColumn("__left", (longest - F.size(tokens)).cast("int")).withColumn("attention", ones)
    return sized.withColumns({tokens: fill(tokens, pad), labels: fill(labels, ignored)}).drop("__left")


def role_violations(rows: DataFrame) -> DataFrame:
    """All rule violations of conversations: one row per conversation and rule."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    seen = rows.withColumns({"before": F.lag("role").over(order), "turn_before": F.lag("turn").over(order)})
    rules = {
        "blank_text": ~_has_text(),
        "unknown_role": ~F.coalesce(F.col("role").isin("system", "user", "assistant", "tool"), F.lit(False)),
        "system_not_first": (F.col("role") == "system") & F.col("before").isNotNull(),
        "assistant_without_user": (F.col("role") == "assistant") & F.coalesce(F.col("before").isin("system"), F.lit(True)),
        "role_repeats": F.col("role") == F.col("before"),
        "turn_gap": F.col("turn") != F.coalesce(F.col("turn_before") + 1, F.lit(0)),
    }
    broken = seen.select("conv_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))
    return broken.groupBy("conv_id", "rule").agg(F.count(F.lit(1)).alias("n"))
