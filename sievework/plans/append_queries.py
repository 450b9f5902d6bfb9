"""Queries of repeatable appends and of the teacher's responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import teacher
from sievework.plans.registry import query
from sievework.sources import appends
from sievework.sources.readers import table
from sievework.sources.scratch import fresh_folder, remove_folder, settle


@query("SELECT o_orderkey, o_totalprice, least(o_orderkey % 3, o_custkey % 3)::BIGINT AS batch FROM orders")
def q_resumable_append(spark, sf_dir):
    """Orders in three overlapping batches, the second written twice as after a restart: each stays in the first that had it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    folder = fresh_folder(spark, "append")
    for batch in (0, 1, 1, 2):
        appends.append_once(orders.where((F.col("o_orderkey") % 3 == batch) | (F.col("o_custkey") % 3 == batch)), folder, "o_orderkey", batch)
    out = settle(appends.appended(spark, folder, orders.schema).select("o_orderkey", "o_totalprice", F.col(appends.BATCH).alias("batch")))
    remove_folder(spark, folder)
    return out


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user and assistant texts of each conversation as requests to a teacher."""
    rows = table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    both = rows.groupBy("conv_id").agg(last("user").alias("user_content"), last("assistant").alias("final_response")).where("user_content IS NOT NULL AND final_response IS NOT NULL")
    shown = both.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("record_id"), "user_content", "final_response")
    return shown.withColumns({"immutable_hash": F.concat(F.lit("sha256:"), F.sha2("record_id", 256)), "allowed_edits": F.array(F.lit("user_content"), F.lit("final_response"))})


_REQUESTS = """(SELECT 'conv-' || conv_id AS record_id, 'sha256:' || sha256('conv-' || conv_id) AS immutable_hash, user_content, final_response FROM (
 SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS user_content, arg_max(text, turn) FILTER (role = 'assistant') AS final_response FROM conversations WHERE trim(text) <> '' GROUP BY conv_id) WHERE user_content IS NOT NULL AND final_response IS NOT NULL)"""
_TRIMMED = "trim({0}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_ONE_LINE = "array_to_string(list_filter(list_transform(regexp_split_to_array({0}, '\\r\\n|\\r|\\n'), lambda x: trim(x)), lambda x: x <> ''), ' ')"
_OPENED = f"""(SELECT record_id, immutable_hash, user_content AS user_before, final_response AS final_before,
 CASE WHEN regexp_matches(lower(u), '^(please|can you|could you)') THEN u ELSE ['Please', 'Can you', 'Could you'][('0x' || substr(md5('7303:' || record_id), 1, 8))::BIGINT % 3 + 1] || ' ' || lower(substr(u, 1, 1)) || substr(u, 2) END AS user_after,
 CASE WHEN regexp_matches(lower(f), '^(done\\.|i checked|here is)') THEN f ELSE 'I checked the banking result. ' || f END AS final_after
 FROM (SELECT *, {_TRIMMED.format("user_content")} AS u, {_TRIMMED.format("final_response")} AS f FROM {_REQUESTS}))"""


@query(f"SELECT record_id, immutable_hash, {_ONE_LINE.format('user_after')} AS user_content, {_ONE_LINE.format('final_after')} AS final_response FROM {_OPENED}")
def q_teacher_dry_run(spark, sf_dir):
    """Responses of the dry-run backend, asked for twice and stored once."""
    folder = fresh_folder(spark, "teacher")
    asked = requests(spark, sf_dir)
    teacher.realize_pending(asked.where("hash(record_id) % 2 = 0"), folder, 0, teacher.DryRun)
    teacher.realize_pending(asked, folder, 1, teacher.DryRun)
    out = settle(appends.appended(spark, folder, teacher.RESPONSE).select(*teacher.FIELDS))
    remove_folder(spark, folder)
    return out


# A careless backend errs by the hash of a record.
_FACTS = f"list_distinct(list_concat(regexp_extract_all({{0}}, '\\d{{{{2,}}}}'), regexp_extract_all(lower({{0}}), '{X.FACT_WORDS}')))"
_CARELESS = f"""(SELECT *, CASE k WHEN 1 THEN regexp_replace({_ONE_LINE.format('final_after')}, '[0-9]', '', 'g') WHEN 2 THEN '' WHEN 3 THEN {_ONE_LINE.format('final_after')} || ' Please send your PIN.' WHEN 4 THEN {_ONE_LINE.format('final_after')} || ' ann@example.org' ELSE {_ONE_LINE.format('final_after')} END AS f,
 {_ONE_LINE.format('user_after')} AS u, CASE k WHEN 5 THEN 'sha256:0' ELSE immutable_hash END AS h FROM (SELECT *, ('0x' || substr(md5(record_id), 1, 6))::BIGINT % 7 AS k FROM {_OPENED}))"""
_PII = " OR ".join(f"regexp_matches(u, '{X.PII[k]}') OR regexp_matches(f, '{X.PII[k]}')" for k in teacher.PRIVATE_VALUES)
_LOST = "len(list_filter({facts}, lambda x: NOT contains(lower({after}), x))) > 0"


@query(f"""SELECT record_id, array_to_string(list_filter([CASE WHEN h <> immutable_hash THEN 'other_hash' END, CASE WHEN u = '' THEN 'blank_user_content' END, CASE WHEN f = '' THEN 'blank_final_response' END,
 CASE WHEN u <> '' AND {_LOST.format(facts=_FACTS.format('user_before'), after='u')} THEN 'lost_facts_user_content' END, CASE WHEN f <> '' AND {_LOST.format(facts=_FACTS.format('final_before'), after='f')} THEN 'lost_facts_final_response' END,
 CASE WHEN regexp_matches(lower(f), '{X.PRIVATE_VERB}') AND regexp_matches(lower(f), '{X.PRIVATE_NOUN}') THEN 'asks_for_private_data' END, CASE WHEN {_PII} THEN 'private_value' END], lambda x: x IS NOT NULL), ',') AS errors FROM {_CARELESS}""")
def q_teacher_errors(spark, sf_dir):
    """What is wrong with the responses of a careless backend: lost digits, blanks, requests for a PIN, an address, another digest."""
    made = teacher.realize(requests(spark, sf_dir), teacher.DryRun)
    k = F.conv(F.substring(F.md5("asked.record_id"), 1, 6), 16, 10).cast("bigint") % 7
    final = F.col("given.final_response")
    changed = F.when(k == 1, F.regexp_replace(final, "[0-9]", "")).when(k == 2, "").when(k == 3, F.concat(final, F.lit(" Please send your PIN."))).when(k == 4, F.concat(final, F.lit(" ann@example.org"))).otherwise(final)
    given = F.struct("given.record_id", F.when(k == 5, "sha256:0").otherwise(F.col("given.immutable_hash")).alias("immutable_hash"), "given.user_content", changed.alias("final_response"))
    return teacher.judged(made.withColumn("given", given)).select("record_id", F.array_join("errors", ",").alias("errors"))
