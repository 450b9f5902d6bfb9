"""Queries over files that are made of the tables: numbered records, constants of sources, token labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import loss_spans as L
from sievework.plans.registry import norm, query
from sievework.sources import numbered
from sievework.sources.readers import table
from sievework.sources.scratch import fresh_folder, remove_folder, settle


@query("SELECT (row_number() OVER (ORDER BY conv_id, turn, role, text) - 1)::BIGINT AS source_row_id, 'train' AS split, regexp_replace(text, '[\\r\\n]', '', 'g') AS text, role AS label FROM conversations WHERE regexp_replace(text, '[\\r\\n]', '', 'g') <> ''")
def q_csv_row_ids(spark, sf_dir):
    """Messages written as CSV part files with a header each, and read with the positions of their rows."""
    rows = table(spark, sf_dir, "conversations").where(F.regexp_replace("text", r"[\r\n]", "") != "")
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    folder = fresh_folder(spark, "csv")
    ordered.select("text", F.col("role").alias("label")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    out = settle(numbered.labelled_snapshot(spark, {"train": folder}))
    remove_folder(spark, folder)
    return out


def prompts_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python source for each benchmark item: its sentences as constants in a call, beside a short one and a comment."""
    sentences = F.filter(F.split("text", r"[.!?\n]+"), lambda s: F.trim(s) != "")
    rows = table(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    return rows.select("item_id", F.concat(F.lit("NAME = 'short'\n# "), F.regexp_replace("text", r"[\r\n]", " "), F.lit("\nPROMPTS = ask(*"), F.to_json(sentences), F.lit(", n=3)\n")).alias("source"))


_SAID = "SELECT {0}, {1} AS s FROM (SELECT {0}, unnest(string_split_regex(text, '[.!?\\n]+')) AS p FROM {2})"


@query(f"SELECT item_id, literal, count(DISTINCT doc_id) AS n_docs FROM (SELECT DISTINCT item_id, s AS literal FROM ({_SAID.format('item_id', norm('p'), 'benchmark')})) LEFT JOIN ({_SAID.format('doc_id', norm('p'), 'documents')}) ON literal = s WHERE len(string_split(literal, ' ')) >= 3 GROUP BY item_id, literal")
def q_source_literals(spark, sf_dir):
    """Constants of three or more words in sources, with the documents that have one as a sentence."""
    literals = numbered.source_literals(prompts_of_sources(spark, sf_dir))
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[.!?\n]+")).alias("s"))
    sentences = parts.select("doc_id", X.normalize(F.col("s")).alias("literal")).where("literal <> ''").distinct()
    return literals.join(sentences, "literal", "left").groupBy("item_id", "literal").agg(F.count("doc_id").alias("n_docs"))


_PIECE = "[A-Za-z0-9]{1,3}|[^A-Za-z0-9]"


@query(f"""WITH m AS (SELECT conv_id, turn, role, role || ': ' || coalesce(text, '') AS line FROM conversations), p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun FROM m),
 t AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, role, line) AS text FROM m GROUP BY conv_id), k AS (SELECT conv_id, unnest(regexp_extract_all(text, '(?s){_PIECE}')) AS piece, generate_subscripts(regexp_extract_all(text, '(?s){_PIECE}'), 1) AS i FROM t),
 o AS (SELECT *, (sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY i))::BIGINT AS "end" FROM k), s AS (SELECT conv_id, begun + 11 AS a, begun + length(line) AS b FROM p WHERE role = 'assistant' AND turn % 4 <> 3),
 y AS (SELECT o.conv_id, i, piece, "end", EXISTS (SELECT 1 FROM s WHERE s.conv_id = o.conv_id AND s.a <= o."end" - length(o.piece) AND o."end" <= s.b) AS on_loss FROM o)
 SELECT conv_id, count(*) AS n_tokens, count(*) FILTER (on_loss) AS n_trained, sha256(coalesce(string_agg(piece, '' ORDER BY i) FILTER (on_loss), '')) AS trained_sha256, coalesce(sum(i - 1) FILTER (on_loss), 0)::BIGINT AS label_sum FROM y GROUP BY conv_id""")
def q_token_loss(spark, sf_dir):
    """Labels over the tokens of a tokenizer that cuts inside words, with the text under loss read back from the tokens."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"), (F.col("turn") % 4 != 3).alias("loss"))
    messages = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "line", "loss"))).alias("m"))
    made = messages.select("conv_id", L.rendered(F.col("m"), lambda m: m["line"], "assistant: ").alias("r"))
    placed = made.select("conv_id", "r.text", "r.spans", L.offsets(F.col("r.text"), lambda: L.Pieces(_PIECE)).alias("o"))
    told = placed.withColumn("y", L.labels(F.col("o"), F.col("spans")))
    on = F.filter("y", lambda y: y != L.IGNORED)
    text = F.array_join(F.transform("spans", lambda s: F.substr("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), "")
    return told.select("conv_id", F.size("y").cast("bigint").alias("n_tokens"), F.size(on).cast("bigint").alias("n_trained"), F.sha2(text, 256).alias("trained_sha256"), F.coalesce(F.aggregate(on, F.lit(0).cast("bigint"), lambda acc, y: acc + y), F.lit(0)).alias("label_sum"))
