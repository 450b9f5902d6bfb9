"""Queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import chat, decontam, html_text, language, media, mixing, periodic, repair, sharding, simhash, token_files, url_rules, warc

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t")).select("conv_id", "t.*")
    made = chat.render(chat.canonical_turns(chat.gather_turns(rows.unionByName(extra)), "record"))
    read = made.withColumn("back", chat.parse(F.col("formatted"))).withColumn("trained", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.fit_weights(pages)).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mixing.mixing_counts(_table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), url_rules.rule_frame(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with the faults that the query's contract plants, a null being one blank; ``present`` is false for what it drops."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    told = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return told.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.md5(F.concat("role", F.lit("\n"), "text")).alias("tie"), (F.col("k") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(_table(spark, sf_dir, "conversations"))
    return repair.digests(rows, tie=F.col("tie"), present=F.col("present"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a document, from some place on in the period that the query's contract plants; a null id plants none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not words or h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(_table(spark, sf_dir, "documents").select("doc_id", "text"), prepare=planted)
    # Exact order of length / period: the cross products of two runs are compared.
    first = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"]) | ((b["length"] * a["period"] == a["length"] * b["period"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))))
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(first(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    told = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


_ALL = (op1_sharding, op2_chat, op3_simhash, op4_html_text, op5_language, op6_mixing, op7_url_rules, op8_decontamination, op9_media, op10_warc, op11_repair, op12_token_files, op13_periodic_runs)
QUERIES = {f.__name__: f for f in _ALL}

_NUMBER = "('0x' || substr(md5({0}), 1, {1}))::BIGINT"

_SHARDING = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS shard FROM range({len(sharding.SHARDS)}) t(i)
), walks AS (
  SELECT list({_NUMBER.format("shard || '|offset'", 15)} % {sharding.TABLE_SIZE} ORDER BY i) AS offs,
         list({_NUMBER.format("shard || '|skip'", 15)} % {sharding.TABLE_SIZE - 1} + 1 ORDER BY i) AS skips FROM shards
), fill AS (
  SELECT 0::BIGINT AS t, list_transform(range({sharding.TABLE_SIZE}), lambda x: -1::BIGINT) AS owner
  UNION ALL
  SELECT t + 1, list_transform(range({sharding.TABLE_SIZE}), lambda x: CASE WHEN x = s THEN t % {len(sharding.SHARDS)} ELSE owner[x + 1] END)
  FROM (
    SELECT t, owner, (offs[i + 1] + skips[i + 1] * list_filter(range({sharding.TABLE_SIZE}), lambda j: owner[(offs[i + 1] + skips[i + 1] * j) % {sharding.TABLE_SIZE} + 1] < 0)[1]) % {sharding.TABLE_SIZE} AS s
    FROM (SELECT t, owner, t % {len(sharding.SHARDS)} AS i FROM fill WHERE t < {sharding.TABLE_SIZE}), walks
  )
), slots AS (SELECT unnest(range({sharding.TABLE_SIZE})) AS slot, unnest(owner) AS i FROM fill WHERE t = {sharding.TABLE_SIZE})
SELECT doc_id, d.slot::INTEGER AS slot, shard
FROM (SELECT doc_id, {_NUMBER.format("coalesce(doc_id::VARCHAR, '')", 15)} % {sharding.TABLE_SIZE} AS slot FROM documents) d
JOIN slots ON slots.slot = d.slot JOIN shards ON shards.i = slots.i
"""

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS n FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""

_HASH = "('0x' || substr(md5({0}), 1, 13))::BIGINT"
_BITS = "length(bin(size))"

_MIXING = f"""
WITH docs AS (
  SELECT *, {_BITS} * 8 + CASE WHEN {_BITS} <= 3 THEN size ELSE size >> ({_BITS} - 3) END AS stratum FROM (
    SELECT doc_id, source, coalesce('=' || source, '') AS tag, {_HASH.format("'draw' || coalesce(doc_id::VARCHAR, 'null')")} AS hash,
      coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents)
), listed AS (
  SELECT source, tag, source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT source, tag, sum(size)::BIGINT AS source_size FROM docs GROUP BY source, tag)
), staged AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM listed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, least(cap, coalesce((SELECT arg_min(level, place) FROM staged WHERE level <= cap / weight) * weight, cap)) AS target FROM staged
), rated AS (
  SELECT tag, source_size, target, floor(r) AS base, r - floor(r) AS fraction, {_HASH.format("'offset' || tag")} / 4503599627370496.0::DOUBLE AS start
  FROM (SELECT *, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS r FROM leveled)
), strata AS (
  SELECT tag, stratum, source_size, target, base, floor(fraction * upto + start) - floor(fraction * (upto - n) + start) AS k
  FROM (SELECT *, sum(n) OVER (PARTITION BY tag ORDER BY stratum) AS upto FROM (SELECT tag, stratum, count(*) AS n FROM docs GROUP BY tag, stratum)) JOIN rated USING (tag)
), lasts AS (
  SELECT tag, stratum, any_value(source_size) AS source_size, any_value(target) AS target, any_value(base) AS base, coalesce(max(hash) FILTER (place <= k), -1) AS last
  FROM (SELECT tag, stratum, hash, row_number() OVER (PARTITION BY tag, stratum ORDER BY hash) AS place FROM docs) JOIN strata USING (tag, stratum) GROUP BY tag, stratum
)
SELECT doc_id, size, source_size, target, ((base::BIGINT + (hash <= last)::BIGINT) * size)::BIGINT AS taken FROM docs JOIN lasts USING (tag, stratum)
"""

_URLS = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules AS (
  SELECT * FROM (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
    ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')) t(verdict, rule, h, p)
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
"""

_WORDS = r"coalesce(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

_DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, list_slice(w, i, least(i + 9, len(w))) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
places AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_WARC = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
o AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN o ON p.digest = o.digest AND n >= 100
"""

def _added(of: str, cost: str, edit: str) -> str:
    """A way, eight digits of cost and its audit, longer by an edit; the least of such strings is the cheapest, then least way."""
    return f"lpad((substr({of}, 1, 8)::INTEGER + {cost})::VARCHAR, 8, '0') || substr({of}, 9) || '{edit}'"


_OTHERS = ("b0", "b1", "b3")
_REPAIR = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i))
), told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), keyed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, tab[(xor(c, b) % 256 + 1)::INTEGER])), 4294967295) % 20 AS k FROM told, crc_table
), damaged AS (
  SELECT conv_id, turn, md5(role || chr(10) || text) AS tie, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, copy) AS pos FROM damaged
), judged AS (
  SELECT *, substr(role, 1, 1) AS r, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS follows,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (follows IS NOT NULL AND r || follows NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), coded AS (
  SELECT conv_id, pos, r, fault IN ('b', 'd') AS must, (fault = 't')::INTEGER AS e FROM judged
), walk AS (
  SELECT conv_id, 0::BIGINT AS pos, '00000000' AS b0, NULL::VARCHAR AS b1, '00000002I' AS b2, '00000004II' AS b3 FROM (SELECT DISTINCT conv_id FROM coded)
  UNION ALL
  SELECT conv_id, pos, n0, n1, m2, least(n3, {_added("m2", "2", "I")}) FROM (
    SELECT *, least(n2, {_added("n0", "2", "I")}, {_added("n1", "2", "I")}, {_added("n3", "2", "I")}) AS m2 FROM (
      SELECT w.conv_id, c.pos, {_added("b0", "3", "D")} AS n0,
        least({_added("b1", "3", "D")}, CASE WHEN NOT must AND r = 's' THEN {_added("b0", "e", "K")} END) AS n1,
        least({_added("b2", "3", "D")}, CASE WHEN NOT must THEN least({", ".join(_added(b, "2 + e", "R") for b in _OTHERS)}) END, CASE WHEN NOT must AND r = 'u' THEN least({", ".join(_added(b, "e", "K") for b in _OTHERS)}) END) AS n2,
        least({_added("b3", "3", "D")}, CASE WHEN NOT must THEN {_added("b2", "2 + e", "R")} END, CASE WHEN NOT must AND r = 'a' THEN {_added("b2", "e", "K")} END) AS n3
      FROM walk w JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.pos = w.pos + 1))
), ended AS (
  SELECT c.*, substr(least(b0, b3), 1, 8)::BIGINT AS cost, substr(least(b0, b3), 9) AS audit FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.n
), letters AS (
  SELECT conv_id, j, audit[j] AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM ended)
), steps AS (
  SELECT *, sum((edit <> 'I')::INTEGER) OVER w AS i, sum((edit <> 'D')::INTEGER) OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), kept AS (
  SELECT s.conv_id, o, edit, role, text, max((o = 1 AND edit = 'K' AND r = 's')::INTEGER) OVER (PARTITION BY s.conv_id) AS opened
  FROM steps s LEFT JOIN judged g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.pos = s.i WHERE edit <> 'D'
), fixed AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS body FROM kept GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN fixed f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLE_SQL = {"op1_sharding": _SHARDING, "op2_chat": _CHAT, "op6_mixing": _MIXING, "op7_url_rules": _URLS, "op8_decontamination": _DECONTAMINATION, "op10_warc": _WARC, "op11_repair": _REPAIR}
