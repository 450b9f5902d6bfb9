"""Expansion of scenarios from a table of templates and tables of slot values.

An index is a mixed-radix number: its last digit is the template, then the realization of a
state, then the state. So rows come from a range and are neither multiplied by joins nor
numbered by windows, and a row's values follow from its own index by division and hashing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as X

#: Realizations of a state; templates that may be broadcast.
REALIZATIONS, BROADCAST_TEMPLATES = 3, 100_000


def pick(values: Column, seed: Column, divisor: int = 1, offset: int = 0) -> Column:
    """The value that a seed chooses from an array: ``(seed div divisor + offset) mod size``; null of an empty one."""
    whole = ((seed - F.pmod(seed, F.lit(divisor))) / F.lit(divisor)).cast("bigint")  # exact up to 53 bits
    at = F.pmod(whole + offset, F.nullif(F.size(values).cast("bigint"), F.lit(0).cast("bigint")))
    return F.get(values, at.cast("int"))


def fill(text: Column, slots: Column) -> Column:
    """``text`` with every ``{name}`` that the map has in its place; other braces stay, and what is filled in isn't read again."""
    pieces = F.split(text, r"\{")

    def one(piece: Column) -> Column:
        name, rest = F.regexp_extract(piece, r"(?s)\A(\w+)\}", 1), F.regexp_extract(piece, r"(?s)\A\w+\}(.*)\z", 1)
        value = F.try_element_at(slots, name)
        return F.when((name != "") & value.isNotNull(), F.concat(value, rest)).otherwise(F.concat(F.lit("{"), piece))

    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 1)), one), ""))


def scenarios(templates: DataFrame, count: int, slots: Mapping[str, tuple[str, int, int]], lists: DataFrame, texts: tuple[str, ...], realizations: int = REALIZATIONS) -> DataFrame:
    """``count`` scenarios from ``templates`` (``template_id, ordinal`` from 0, and ``texts`` with slots in braces).

    ``lists`` is one row of arrays by name; ``slots`` says for each slot its list, and the divisor and
    offset by which the state's seed chooses. Realizations of a state have the same slots, which
    also hold ``state`` and ``realization``. Columns: ``scenario_id, template_id, state_no, realization, split_group, seed``
    and the filled texts. The first scenario of a template has the template's id.
    """
    spark, n = templates.sparkSession, templates.count()
    if n == 0 or count == 0:
        base = spark.range(0)
    else:
        base = spark.range(count)
    occurrence = F.floor(F.col("id") / F.lit(max(1, n)))
    numbered = base.select((F.col("id") % max(1, n)).cast("int").alias("ordinal"), occurrence.alias("occurrence"), F.floor(occurrence / realizations).alias("state_no"), (occurrence % realizations).alias("realization"))
    side = F.broadcast(templates) if n <= BROADCAST_TEMPLATES else templates
    met = numbered.join(side.withColumn("ordinal", F.col("ordinal").cast("int")), "ordinal").crossJoin(F.broadcast(lists))  # one row of lists
    seeded = met.withColumn("seed", X.stable_int(F.concat_ws(":", "template_id", F.col("state_no").cast("string"))))
    values = [x for name, (of, divisor, offset) in slots.items() for x in (F.lit(name), pick(F.col(of), F.col("seed"), divisor, offset))]
    filled = seeded.withColumn("slots", F.create_map(*values, F.lit("state"), F.lpad(F.col("state_no").cast("string"), 4, "0"), F.lit("realization"), F.col("realization").cast("string")))
    state = F.concat(F.col("template_id"), F.lit("_state_"), F.col("slots")["state"])
    scenario = F.when(F.col("occurrence") == 0, F.col("template_id")).otherwise(F.concat(state, F.lit("_realization_"), F.col("realization").cast("string")))
    return filled.select(scenario.alias("scenario_id"), "template_id", "state_no", "realization", state.alias("split_group"), "seed", *(fill(F.col(t), F.col("slots")).alias(t) for t in texts))


def counterfactual_pairs(made: DataFrame, present: str, absent: str) -> DataFrame:
    """Each scenario twice: variant ``a`` with the text ``present``, whose request can be met, and ``b`` with ``absent``, where it can't; ``pair_id`` is theirs."""
    sides = F.array(F.struct(F.lit("a").alias("variant"), F.col(present).alias("evidence")), F.struct(F.lit("b").alias("variant"), F.col(absent).alias("evidence")))
    others = [c for c in made.columns if c not in (present, absent)]
    return made.select(*others, F.concat(F.lit("pair-"), F.substring(F.sha2("scenario_id", 256), 1, 16)).alias("pair_id"), F.explode(sides).alias("s")).select(*others, "pair_id", "s.*")
