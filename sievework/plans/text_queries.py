"""Queries over document texts: normalization, patterns, hashes, deduplication, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import audit, dedup, splits
from sievework.plans.registry import norm, norm_ascii, query
from sievework.sources import sinks
from sievework.sources.readers import table
from sievework.sources.scratch import settle

_PII = {k: v.replace("'", "''") for k, v in X.PII.items()}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, {norm('text')} AS norm, {norm_ascii('text')} AS norm_ascii, sha256({norm('text')}) AS norm_sha256 FROM documents")
def q_norm_docs(spark, sf_dir):
    n = X.normalize(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", n.alias("norm"), X.normalize_ascii(F.col("text")).alias("norm_ascii"), F.sha2(n, 256).alias("norm_sha256"))


_FOLD = "trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_FOLD}) AS folded_sha256, {norm_ascii(_FOLD)} AS transcript_key FROM documents")
def q_transcript_keys(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(X.fold_spaces(F.col("text")), 256).alias("folded_sha256"), X.transcript_key(F.col("text")).alias("transcript_key"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (regexp_matches(text, '{p}')) AS n_docs FROM documents" for k, p in _PII.items()))
def q_pii_counts(spark, sf_dir):
    flags = X.pii_flags(F.col("text"))
    one = docs(spark, sf_dir).agg(F.array(*(F.struct(F.lit(k).alias("kind"), F.count_if(c).alias("n_docs")) for k, c in flags.items())).alias("m"))
    return one.select(F.inline("m"))


@query("SELECT source, count(*) AS n_docs, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS n_{k}" for k, p in _PII.items()) + " FROM documents GROUP BY source")
def q_pii_by_source(spark, sf_dir):
    flags = X.pii_flags(F.col("text"))
    return docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *(F.count_if(c).alias(f"n_{k}") for k, c in flags.items()))


@query(f"SELECT doc_id, regexp_matches(text, '{X.PRIVATE_NUMBER}') AS private_number, len(regexp_extract_all(text, '\\d{{2,}}')) AS n_numbers FROM documents WHERE regexp_matches(text, '\\d')")
def q_private_numbers(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).where(t.rlike(r"\d")).select("doc_id", t.rlike(X.PRIVATE_NUMBER).alias("private_number"), F.regexp_count(t, F.lit(r"\d{2,}")).cast("bigint").alias("n_numbers"))


def _unicode_bounds(pattern: str) -> str:
    """The pattern with word bounds that know all letters, which DuckDB's own don't; they open and close in turn."""
    first, *rest = pattern.split(r"\b")
    return first + "".join((r"(?:^|[^\p{L}\p{N}_])" if i % 2 == 0 else r"(?:$|[^\p{L}\p{N}_])") + part for i, part in enumerate(rest))


_LABEL_CASES = ", ".join(f"CASE WHEN regexp_matches(t, '{_unicode_bounds(p)}') THEN '{k}' END" for k, p in X.INTERNAL_LANGUAGE.items())


_SENTENCES = (
    "Your order is open. Please provide your account number.",
    "Do not share your password with anyone. Your card is frozen.",
    "The demo router called a tool result from the back-end model.",
    "We need your PIN to continue! Your transfer is pending, ref 4411.",
    "Never tell us your one-time verification code; what is your customer ID?",
    "Fee is $1,250.00 or 3.50% for twelve months [Policy: fees.card.v2] [Policy: fees.card.v1]",
    "Test data on the GPU. Send the security code.",
)


def _messages(spark, sf_dir) -> DataFrame:
    """Whole documents, each with one more sentence, so that every pattern occurs."""
    more = F.element_at(F.array(*map(F.lit, _SENTENCES)), (F.col("doc_id") % len(_SENTENCES) + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", F.concat(F.col("text"), F.lit("\n"), more).alias("t"))


_MESSAGES = f"(SELECT doc_id, text || chr(10) || {list(_SENTENCES)}[doc_id % {len(_SENTENCES)} + 1] AS t FROM documents)"


@query(f"SELECT doc_id, array_to_string(list_filter([{_LABEL_CASES}], lambda x: x IS NOT NULL), ',') AS labels, array_to_string(list_filter({list(X.FORBIDDEN_TERMS)}, lambda w: contains({norm_ascii('t')}, w)), ',') AS terms FROM {_MESSAGES}")
def q_internal_language_flags(spark, sf_dir):
    return _messages(spark, sf_dir).select("doc_id", F.array_join(X.internal_labels(F.col("t")), ",").alias("labels"), F.array_join(X.forbidden_terms(F.col("t")), ",").alias("terms"))


_REQ, _PRO = X.CREDENTIAL_REQUEST.replace("'", "''"), X.PROHIBITION.replace("'", "''")


@query(f"""SELECT doc_id, len(list_filter(list_transform(string_split_regex(lower(t), '[.!?;\\n]'), lambda c: regexp_replace(c, '{_PRO}(?:{_REQ})', ' ', 'g')), lambda c: regexp_matches(c, '{_REQ}'))) > 0 AS requests_credentials,
 regexp_matches(lower(t), '{X.PRIVATE_VERB}') AND regexp_matches(lower(t), '{X.PRIVATE_NOUN}') AS requests_private FROM {_MESSAGES}""")
def q_credential_requests(spark, sf_dir):
    return _messages(spark, sf_dir).select("doc_id", X.requests_credentials(F.col("t")).alias("requests_credentials"), X.requests_private_data(F.col("t")).alias("requests_private"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\[Policy:\\s*([^\\]\\s]+)\\s*\\]', 1))), ',') AS citations FROM {_MESSAGES} WHERE contains(t, '[Policy')")
def q_citations(spark, sf_dir):
    return _messages(spark, sf_dir).where(F.contains("t", F.lit("[Policy"))).select("doc_id", F.array_join(X.citations(F.col("t")), ",").alias("citations"))


@query()
def q_quantities(spark, sf_dir):
    """Its pattern looks behind, which DuckDB's expressions cannot; tests hold it against Python."""
    return _messages(spark, sf_dir).select("doc_id", F.array_join(X.quantities(F.col("t")), ",").alias("quantities"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(t, '\\d{{2,}}'), regexp_extract_all(lower(t), '{X.FACT_WORDS}')))), ',') AS facts FROM {_MESSAGES}")
def q_fact_literals(spark, sf_dir):
    return _messages(spark, sf_dir).select("doc_id", F.array_join(X.fact_literals(F.col("t")), ",").alias("facts"))


@query("""SELECT doc_id, sha256('7404' || chr(0) || source || chr(0) || doc_id::VARCHAR) AS rank_hex, ('0x' || substr(sha256(text), 1, 12))::BIGINT AS stable_int,
 ('0x' || substr(sha256(text), 1, 12))::BIGINT % 7 AS pick, (1000 + (doc_id + 3 * 997) % 9000)::VARCHAR AS last4, substr(sha256(text || chr(10) || '0' || chr(10) || source), 1, 16) AS call_id FROM documents""")
def q_stable_hashes(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", X.stable_rank(F.lit(7404), F.col("source"), F.col("doc_id")).alias("rank_hex"), X.stable_int(t).alias("stable_int"), F.pmod(X.stable_int(t), F.lit(7)).alias("pick"), X.last_four(F.col("doc_id"), F.lit(3)).alias("last4"), X.call_id(t, F.lit(0), F.col("source")).alias("call_id"))


@query("""SELECT text_key, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, md5(""" + norm("text") + """) AS text_key FROM documents) GROUP BY text_key HAVING count(*) > 1""")
def q_exact_dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(docs(spark, sf_dir), X.normalize(F.col("text")), "doc_id")


_SPLIT = """(SELECT d.*, CASE WHEN r <= round_even(n * 0.15, 0) THEN 'validation' WHEN r <= round_even(n * 0.15, 0) + round_even(n * 0.15, 0) THEN 'test' ELSE 'train' END AS split
 FROM documents d JOIN (SELECT source AS g, row_number() OVER (ORDER BY sha256('711' || chr(10) || coalesce(source, '')), source IS NULL) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) ON source IS NOT DISTINCT FROM g)"""


def split_docs(spark, sf_dir) -> DataFrame:
    return splits.group_split(docs(spark, sf_dir), "source")


@query(f"SELECT source, split, count(*) AS n_docs FROM {_SPLIT} GROUP BY source, split")
def q_split_hash_groups(spark, sf_dir):
    return split_docs(spark, sf_dir).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_docs"))


_PRIO = "CASE split WHEN 'test' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END"


@query(f"SELECT doc_id, split FROM (SELECT doc_id, split, min({_PRIO}) OVER (PARTITION BY md5({norm('text')})) AS best, {_PRIO} AS p FROM {_SPLIT}) WHERE p = best")
def q_priority_dedup_v1(spark, sf_dir):
    return dedup.drop_seen_in_better_split(split_docs(spark, sf_dir), X.normalize(F.col("text")), "split").select("doc_id", "split")


@query(f"SELECT doc_id, split FROM (SELECT doc_id, split, row_number() OVER (PARTITION BY md5({norm('text')}) ORDER BY {_PRIO}, doc_id) AS r FROM {_SPLIT}) WHERE r = 1")
def q_priority_dedup_v2(spark, sf_dir):
    return dedup.first_of_each(split_docs(spark, sf_dir), X.normalize(F.col("text")), "split", "doc_id").select("doc_id", "split")


@query(f"SELECT split, lang, source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM {_SPLIT} GROUP BY GROUPING SETS ((split), (split, lang), (split, source))")
def q_split_dim_counts(spark, sf_dir):
    s, lang, source = F.col("split"), F.col("lang"), F.col("source")
    return split_docs(spark, sf_dir).groupingSets([[s], [s, lang], [s, source]], s, lang, source).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query(f"""SELECT kind, key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM (
 SELECT 'text' AS kind, md5({norm('text')}) AS key, split FROM {_SPLIT} UNION ALL SELECT 'n_chars', n_chars::VARCHAR, split FROM {_SPLIT} UNION ALL SELECT 'lang', lang, split FROM {_SPLIT}
 ) GROUP BY kind, key HAVING count(DISTINCT split) > 1""")
def q_group_leakage(spark, sf_dir):
    keys = {"text": F.md5(X.normalize(F.col("text"))), "n_chars": F.col("n_chars"), "lang": F.col("lang")}
    return audit.leakage(split_docs(spark, sf_dir), keys)


@query(f"SELECT text_key, arg_min(source, doc_id) AS first_owner, count(DISTINCT source) AS n_owners FROM (SELECT md5({norm('text')}) AS text_key, source, doc_id FROM documents) GROUP BY text_key HAVING count(DISTINCT source) > 1")
def q_first_owner_conflict(spark, sf_dir):
    return audit.owner_conflicts(docs(spark, sf_dir).select(F.md5(X.normalize(F.col("text"))).alias("text_key"), "source", "doc_id"), "text_key", "source", "doc_id")


@query(f"SELECT n_chars, count(DISTINCT md5({norm('text')})) AS n_values FROM documents GROUP BY n_chars HAVING count(DISTINCT md5({norm('text')})) > 1")
def q_conflicting_values(spark, sf_dir):
    """The conflict rule with the character count as the id: counts that stand for several texts."""
    return dedup.conflicts(docs(spark, sf_dir), "n_chars", F.md5(X.normalize(F.col("text"))))


@query(f"""WITH r AS (SELECT d.doc_id, d.source AS label, row_number() OVER (PARTITION BY d.source ORDER BY sha256('7101' || chr(0) || d.source || chr(0) || d.doc_id::VARCHAR || chr(0) || d.text), d.doc_id) AS r, count(*) OVER (PARTITION BY d.source) AS n
 FROM documents d JOIN labels l USING (doc_id)) SELECT doc_id, label, CASE WHEN r <= greatest(1, round_even(n * 0.15, 0)) THEN 'validation' ELSE 'train' END AS split FROM r""")
def q_stratified_holdout(spark, sf_dir):
    labelled = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").withColumnRenamed("source", "label")
    return splits.stratified_holdout(labelled, "label", "doc_id", "text")


@query("SELECT doc_id, source, coalesce(lag(doc_id) OVER w, last_value(doc_id) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def q_prev_pair_wrap(spark, sf_dir):
    return splits.previous_with_wrap(docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", "doc_id").select("doc_id", "source", "previous")


_LANGS = ("de", "en", "es", "fr")


@query(f"""WITH b AS (SELECT item_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(item_id::VARCHAR)) - 1 AS j, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT item_id, {list(_LANGS)}[item_id % 4 + 1] AS lang FROM benchmark)), d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) - 1 AS i FROM documents)
 SELECT doc_id, item_id FROM d JOIN b ON d.lang = b.lang AND d.i % b.n = b.j""")
def q_round_robin(spark, sf_dir):
    """Documents of every language take the items of their language in turn."""
    left = splits.numbered(docs(spark, sf_dir).select("doc_id", "lang"), "lang", F.sha2(F.col("doc_id").cast("string"), 256), "i")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.get(F.array(*map(F.lit, _LANGS)), (F.col("item_id") % 4).cast("int")).alias("lang"))
    right = splits.numbered(items, "lang", F.sha2(F.col("item_id").cast("string"), 256), "j")
    return splits.round_robin(left, right, "lang").select("doc_id", "item_id")


@query("""WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) - 1 AS i FROM documents WHERE lang <> 'en'), m AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) - 1 AS i FROM documents WHERE lang = 'en')
 SELECT n.doc_id AS current_id, m.doc_id AS prior_id, source FROM n JOIN m USING (source, i)""")
def q_zip_shift(spark, sf_dir):
    d, order = docs(spark, sf_dir).select("doc_id", "source", "lang"), F.sha2(F.col("doc_id").cast("string"), 256)
    a = splits.numbered(d.where("lang <> 'en'"), "source", order, "i").select("source", "i", F.col("doc_id").alias("current_id"))
    b = splits.numbered(d.where("lang = 'en'"), "source", order, "i").select("source", "i", F.col("doc_id").alias("prior_id"))
    return a.join(b, ["source", "i"]).select("current_id", "prior_id", "source")


@query("SELECT doc_id, n // 3 AS semantic_seed, n % 3 AS realization FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS n FROM documents)")
def q_occurrence_seeds(spark, sf_dir):
    keyed = docs(spark, sf_dir).select("doc_id", F.concat_ws("|", "source", "lang").alias("k"))
    return splits.occurrence_seeds(keyed, "k", "doc_id").select("doc_id", "semantic_seed", "realization")


@query("SELECT doc_id, unnest(range(CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 4 ELSE 2 END)) AS copy FROM labels")
def q_weighted_replicate(spark, sf_dir):
    times = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 4).otherwise(2)
    return splits.replicate(table(spark, sf_dir, "labels"), times).select("doc_id", F.col("copy").cast("bigint").alias("copy"))


_SENT = lambda t, k: f"(SELECT DISTINCT {k}, s FROM (SELECT {k}, {norm('p')} AS s FROM (SELECT {k}, unnest(string_split_regex(text, '[.!?\\n]+')) AS p FROM {t})) WHERE len(string_split(s, ' ')) >= 4)"


@query(f"SELECT doc_id, item_id, count(*) AS n_sentences FROM {_SENT('documents', 'doc_id')} JOIN {_SENT('benchmark', 'item_id')} USING (s) GROUP BY doc_id, item_id")
def q_contam_sentences(spark, sf_dir):
    return audit.sentence_matches(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_GRAM = lambda t, k, n: f"(SELECT DISTINCT {k}, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {k}, string_split({norm('text')}, ' ') AS w FROM {t}) WHERE len(w) >= {n}))"


@query(f"SELECT doc_id, item_id, count(*) AS n_shared FROM {_GRAM('documents', 'doc_id', 8)} JOIN {_GRAM('benchmark', 'item_id', 8)} USING (g) GROUP BY doc_id, item_id")
def q_contam_ngram8(spark, sf_dir):
    return audit.ngram_matches(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_FACTS = f"(SELECT DISTINCT item_id, f FROM (SELECT item_id, {norm('p')} AS f FROM (SELECT item_id, unnest(string_split_regex(text, '[.!?\\n]+')) AS p FROM benchmark)) WHERE len(string_split(f, ' ')) >= 3)"


@query(f"SELECT DISTINCT doc_id, item_id AS fact_id FROM (SELECT doc_id, ' ' || {norm('text')} || ' ' AS t FROM documents) JOIN {_FACTS} ON contains(t, ' ' || f || ' ')")
def q_contam_substring(spark, sf_dir):
    """Sentences of three words or more of the items, sought in whole documents."""
    parts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fact_id"), F.explode(F.split("text", r"[.!?\n]+")).alias("fact"))
    return audit.facts_in_texts(parts.where(F.size(X.words(F.col("fact"))) >= 3).distinct(), docs(spark, sf_dir))


def _prompts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Held-out items as queries, users' messages as the texts they may be close to; documents would be no prompts."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), X.normalize(F.col("text")).alias("text"))
    t = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("tid"), X.normalize(F.col("text")).alias("text"))
    return q, t


_TRI = lambda t, k: f"(SELECT {k}, text, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g FROM (SELECT {k}, text, '  ' || text || '  ' AS p FROM {t}))"


@query(f"""WITH b AS (SELECT item_id AS qid, {norm('text')} AS text FROM benchmark), d AS (SELECT conv_id || ':' || turn AS tid, {norm('text')} AS text FROM conversations WHERE role = 'user'),
 q AS {_TRI('b', 'qid')}, t AS {_TRI('d', 'tid')}, c AS (SELECT qid, tid, count(*) AS common FROM (SELECT qid, unnest(g) AS g FROM q) JOIN (SELECT tid, unnest(g) AS g FROM t) USING (g) GROUP BY qid, tid)
 SELECT qid, tid, dice, rank FROM (SELECT qid, tid, 2.0::DOUBLE * common / (len(q.g) + len(t.g)) AS dice, row_number() OVER (PARTITION BY qid ORDER BY 2.0::DOUBLE * common / (len(q.g) + len(t.g)) DESC, t.text, tid)::INTEGER AS rank FROM c JOIN q USING (qid) JOIN t USING (tid)) WHERE rank <= 32""")
def q_trigram_dice_top(spark, sf_dir):
    return audit.dice_shortlist(*_prompts(spark, sf_dir)).drop("text")


@query()
def q_nearest_prompt_ratio(spark, sf_dir):
    """The best matching-block ratio of each item's shortlist; SQL has no such function."""
    q, t = _prompts(spark, sf_dir)
    # A shortlist is few rows that cost some milliseconds each: they are dealt to all cores.
    short = audit.dice_shortlist(q, t).withColumnRenamed("text", "tt").join(q.withColumnRenamed("text", "qt"), "qid")
    scored = short.repartition(4 * spark.sparkContext.defaultParallelism).withColumn("ratio", dedup.ratio(F.col("qt"), F.col("tt"), False))
    best = scored.groupBy("qid").agg(F.max_by(F.struct("tid", "ratio"), F.struct("ratio", (-F.col("rank")).alias("r"))).alias("b"))
    return best.select("qid", "b.tid", F.round("b.ratio", 9).alias("ratio"), (F.col("b.ratio") >= audit.CEILING).alias("too_close"))


@query()
def q_fuzzy_dups(spark, sf_dir):
    """Blocked matching-block pairs of whole texts within a source; SQL has no such ratio."""
    return dedup.fuzzy_pairs(docs(spark, sf_dir).select("doc_id", "source", "text"), "doc_id", "text", "source").select("a", "b", F.round("ratio", 9).alias("ratio"))


@query("""SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS lang) l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = s.source AND d.lang = l.lang)""")
def q_required_coverage(spark, sf_dir):
    d = docs(spark, sf_dir).select("source", "lang").distinct()
    needed = d.select("source").distinct().withColumn("lang", F.explode(F.array(*map(F.lit, ("en", "de", "fr", "es", "it")))))
    return needed.join(d, ["source", "lang"], "left_anti")


@query(f"""WITH s AS {_SPLIT}, e AS (SELECT split, to_json({{'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source}})::VARCHAR AS line FROM s),
 h AS (SELECT split, octet_length(encode(line)) + 1 AS n, sha256(line) AS h FROM e)
 SELECT split, count(*) AS record_count, sum(n)::BIGINT AS bytes, sha256(concat_ws(':', count(*)::VARCHAR, {", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT)::VARCHAR" for i in range(4))})) AS fingerprint FROM h GROUP BY split""")
def q_split_manifest(spark, sf_dir):
    return sinks.manifest(split_docs(spark, sf_dir).select("doc_id", "lang", "n_chars", "source", "split"), "split", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_resume_pending(spark, sf_dir):
    return sinks.pending(docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT coalesce(doc_id, vec_id) AS id, CASE WHEN vec_id IS NULL THEN 'missing' ELSE 'extra' END AS status FROM labels FULL OUTER JOIN embeddings ON doc_id = vec_id WHERE doc_id IS NULL OR vec_id IS NULL")
def q_rescore_coverage(spark, sf_dir):
    """Ids asked for (labels) against ids answered (vectors), both ways."""
    want = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("w"))
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("h"))
    joined = want.join(have, "id", "full_outer").where("w IS NULL OR h IS NULL")
    return joined.select("id", F.when(F.col("h").isNull(), "missing").otherwise("extra").alias("status"))


_FORMS = "list_distinct([v, " + norm_ascii("v") + ", replace(v, ',', ''), replace(replace(v, ',', ''), '.', '')])"


@query(f"SELECT c_custkey, array_to_string(list_sort({_FORMS}), '|') AS forms FROM (SELECT c_custkey, format('{{:,.2f}}', abs(c_acctbal)) AS v FROM customer)")
def q_fact_forms(spark, sf_dir):
    v = F.format_number(F.abs(F.col("c_acctbal")).cast("decimal(18,2)"), 2)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(X.fact_forms(v)), "|").alias("forms"))


@query("""SELECT doc_id, ['Hello,', 'Good day,', 'Hi there,'][doc_id % 3 + 1] || ' ' || lang || ' ' || ['thanks', 'please confirm'][(doc_id // 3) % 2 + 1] || CASE source WHEN 'src0' THEN ' (now)' ELSE '' END AS line FROM documents""")
def q_template_realization(spark, sf_dir):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))
    i = F.col("doc_id")
    line = F.concat(pick(("Hello,", "Good day,", "Hi there,"), i), F.lit(" "), F.col("lang"), F.lit(" "), pick(("thanks", "please confirm"), F.floor(i / 3)), F.when(F.col("source") == "src0", " (now)").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", line.alias("line"))


@query(f"""WITH s AS {_SPLIT}, k AS (SELECT *, row_number() OVER (PARTITION BY md5({norm('text')}) ORDER BY {_PRIO}, doc_id) AS r, """ + " OR ".join(f"regexp_matches(text, '{p}')" for p in _PII.values()) + """ AS pii FROM s)
 SELECT split, count(*) AS n_docs, count(*) FILTER (pii) AS n_pii, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT source) AS n_sources FROM k WHERE r = 1 GROUP BY split""")
def q_governed_corpus_report(spark, sf_dir):
    """Normalize, flag personal data, split by hashed group, deduplicate by split priority, count."""
    flagged = split_docs(spark, sf_dir).withColumn("pii", _any(X.pii_flags(F.col("text"))))
    kept = dedup.first_of_each(flagged, X.normalize(F.col("text")), "split", "doc_id")
    return kept.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("pii").alias("n_pii"), F.sum("n_chars").alias("n_chars"), F.count_distinct("source").alias("n_sources"))


def _any(flags: dict[str, Column]) -> Column:
    out = F.lit(False)
    for c in flags.values():
        out = out | c
    return out


@query("""WITH p AS (SELECT l_orderkey AS pair_id, CASE l_linenumber WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS variant, l_orderkey::VARCHAR AS prompt, l_partkey AS result, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS forbidden FROM lineitem),
 g AS (SELECT pair_id, count(*) AS n, string_agg(DISTINCT variant, ',' ORDER BY variant) AS variants, count(DISTINCT prompt) AS prompts, count(DISTINCT result) AS results, bool_and(forbidden <> result) AS apart FROM p GROUP BY pair_id)
 SELECT pair_id, unnest(list_filter([CASE WHEN n <> 2 THEN 'not_two_rows' END, CASE WHEN variants <> 'a,b' THEN 'variants_not_a_b' END, CASE WHEN prompts <> 1 THEN 'prompts_differ' END, CASE WHEN results <> 2 THEN 'results_equal' END, CASE WHEN NOT apart THEN 'own_fact_forbidden' END], lambda x: x IS NOT NULL)) AS rule FROM g""")
def q_pair_invariants(spark, sf_dir):
    from pyspark.sql.window import Window

    lead = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.when(F.col("l_linenumber") == 1, "a").when(F.col("l_linenumber") == 2, "b").otherwise("c").alias("variant"), F.col("l_orderkey").cast("string").alias("prompt"), F.col("l_partkey").alias("result"), lead.alias("forbidden"))
    return audit.pair_invariants(rows)


_SHARES = {
    "exact": f"SELECT count(*) FROM (SELECT DISTINCT {norm('text')} AS t FROM documents) JOIN (SELECT DISTINCT {norm('text')} AS t FROM benchmark) USING (t)",
    "sentences": f"SELECT count(*) FROM (SELECT DISTINCT doc_id, item_id FROM {_SENT('documents', 'doc_id')} JOIN {_SENT('benchmark', 'item_id')} USING (s))",
    "eight_words": f"SELECT count(*) FROM (SELECT DISTINCT doc_id, item_id FROM {_GRAM('documents', 'doc_id', 8)} JOIN {_GRAM('benchmark', 'item_id', 8)} USING (g))",
    "facts": f"SELECT count(*) FROM (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, ' ' || {norm('text')} || ' ' AS t FROM documents) JOIN {_FACTS} ON contains(t, ' ' || f || ' '))",
    "ids": "SELECT count(*) FROM documents JOIN benchmark ON doc_id = item_id",
    "prompts": f"SELECT count(*) FROM (SELECT DISTINCT {norm('text')} AS t FROM conversations WHERE role = 'user') JOIN (SELECT DISTINCT {norm('text')} AS t FROM benchmark) USING (t)",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS gate, ({v}) AS n_overlaps, ({v}) = 0 AS passed" for k, v in _SHARES.items()))
def q_contamination_report(spark, sf_dir):
    """All gates between benchmark items and the other texts in one report."""
    d, items = docs(spark, sf_dir), table(spark, sf_dir, "benchmark")
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    keys = lambda df: df.select(X.normalize(F.col("text")).alias("t"))
    asked = audit.small(settle(keys(items).distinct()))
    parts = items.select(F.col("item_id").alias("fact_id"), F.explode(F.split("text", r"[.!?\n]+")).alias("fact"))
    return audit.contamination_report(
        {
            "exact": keys(d).join(asked, "t", "left_semi").distinct(),  # other texts end where they are read
            "sentences": audit.sentence_matches(d, items),
            "eight_words": audit.ngram_matches(d, items),
            "facts": audit.facts_in_texts(parts.where(F.size(X.words(F.col("fact"))) >= 3).distinct(), d),
            "ids": d.select("doc_id").join(items, F.col("doc_id") == F.col("item_id")),
            "prompts": keys(said).join(asked, "t", "left_semi").distinct(),
        }
    )
