"""Sharding, chat formatting, mixing and URL rules."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import chat, mixing, sharding, url_rules
from sievework.llm._common import connected_components


# Sharding


def test_table_is_fair_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill_table(names, 2053)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    smaller = sharding.fill_table(names[:-1], 2053)
    moved = sum(a != b for a, b in zip(table, smaller, strict=True) if a != 9)
    assert moved < 0.25 * 2053  # most slots of the shards that stay don't move
    assert table == sharding.fill_table(names, 2053)


@pytest.mark.parametrize("names,size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2), (["a"], 1)])
def test_table_rejects(names, size):
    with pytest.raises(ValueError):
        sharding.fill_table(names, size)


def test_place_rows(spark):
    rows = spark.createDataFrame([(1, "x", 9), (1, "x", 9), (None, "y", 8), (2, None, 7)], "doc_id bigint, shard string, __n int")
    got = sharding.place(rows, "doc_id").collect()
    table = sharding.fill_table(sharding.SHARDS)
    slot = lambda k: int(hashlib.md5(k.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
    assert len(got) == 4
    for r in got:
        s = slot("" if r.doc_id is None else str(r.doc_id))
        assert (r.slot, r.shard) == (s, sharding.SHARDS[table[s]])
    assert sharding.place(rows.limit(0), "doc_id").count() == 0
    assert "Exchange hash" not in sharding.place(rows, "doc_id")._jdf.queryExecution().toString()


# Chat formatting


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a|b", "\\"]), st.text(alphabet=st.sampled_from(list("\\|<>tuenrd/ \n#é😀")), max_size=24)), max_size=5), min_size=1, max_size=6))
def test_render_reads_back(spark, talks):
    df = spark.createDataFrame([(i, [(r, t) for r, t in talk]) for i, talk in enumerate(talks)], "i int, turns " + chat.TURNS_TYPE)
    made = chat.render(df)
    for r in made.select("i", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect():
        assert [(t.role, t.text) for t in r.back] == talks[r.i]
        assert r.m == "".join(t for role, t in talks[r.i] if role == "assistant")
        assert all("<|" not in r.formatted[s.start : s.end] for s in r.loss_spans)


def test_layouts(spark):
    lines = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "b"}, {"from": "gpt", "value": "c"}], "id": 7},
        {"prompt": "p", "response": "r", "system": "s"},
        {"prompt": "p", "completion": "r"},
        {"instruction": "do", "input": "this", "output": "o"},
        {"instruction": "do", "output": "o"},
        {"qa": {"question": "q", "answer": "a"}},
        {"prompt": "alone"},
        {"other": 1},
        {"messages": []},
    ]
    parsed = spark.read.json(spark.sparkContext.parallelize([json.dumps(x | {"n": i}) for i, x in enumerate(lines)]))
    df = parsed.select("n", F.struct(*[c for c in parsed.columns if c != "n"]).alias("record"), F.lit("mine").alias("layout"))
    got = {r.n: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df, "record").collect()}
    assert got == {
        0: ("messages", [("user", "a"), ("assistant", "")]),
        1: ("conversations", [("user", "b"), ("assistant", "c")]),
        2: ("prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        3: ("prompt_completion", [("user", "p"), ("assistant", "r")]),
        4: ("instruction", [("user", "do\n\nthis"), ("assistant", "o")]),
        5: ("instruction", [("user", "do"), ("assistant", "o")]),
        6: ("question_answer", [("user", "q"), ("assistant", "a")]),
        7: (None, None),
        8: (None, None),
        9: ("messages", []),
    }
    assert chat.render(chat.canonical_turns(df, "record")).where("turns IS NULL AND formatted IS NULL").count() == 2


def test_gather_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, None, None), (1, 1, "user", "b"), (None, None, "user", "z")], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.canonical_turns(chat.gather_turns(rows), "record").collect()}
    assert got == {1: [("", ""), ("user", "b"), ("user", "b")], None: [("user", "z")]}
    assert chat.gather_turns(rows.limit(0)).count() == 0


# Mixing


def targets_by_steps(sizes):
    """Weights 3, 1, 2 in turn over 150 % of all, capped at twice the size, the excess shared again."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing_targets_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice((1, 5, 40)), rng.choice(["a", "a", "a", "b", "c", "d", None, "é"])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "empty"), (None, "x y", "b"), (5, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copies", F.lit(3)).withColumn("id", F.lit("?"))
    got = mixing.mixing_counts(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_steps(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in sizes:  # one document's rounding, and what sizes of one stratum differ by
        assert abs(taken[s] - want[s]) <= max(45, 0.03 * want[s]), s
    again = mixing.mixing_counts(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert Counter(r.doc_id for r in mixed.where("copies = 3 AND id = '?'").collect()) == Counter({k: n for k, n in Counter(r.doc_id for r in got for _ in range(r.copies)).items() if n})
    assert mixing.mixing_counts(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_each_document_has_its_fraction_as_probability(spark):
    """Over many sources of few documents, each size is copied as often as its source's rate says."""
    made = spark.range(3000).select((F.col("id") * 7).alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 3 == 0, 100).when(F.col("id") % 3 == 1, 30).otherwise(29).cast("int")).alias("text"), F.floor(F.col("id") / 3).cast("string").alias("source"))
    found = mixing.mixing_counts(made, weights=(1.0,), share=5 / 6)
    means = {r["size"]: r["mean"] for r in found.groupBy("size").agg(F.mean("copies").alias("mean")).collect()}
    assert set(means) == {100, 30, 29} and all(abs(m - 5 / 6) < 0.04 for m in means.values()), means
    total = found.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"))
    assert total.where("abs(taken - target) > 100 * 5.0 / 6 + 30").count() == 0


def test_large_strata_find_their_last_hash(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    found = {r.source: r for r in mixing.mixing_counts(df).groupBy("source").agg(F.sum("copies").alias("n"), F.first("target").alias("target")).collect()}
    assert all(abs(r.n * 3 - r.target) <= 3 for r in found.values())


def test_mixing_salted_join(spark, monkeypatch):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    usual = sorted(map(tuple, mixing.mixing_counts(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_PLAN", 1)
    assert sorted(map(tuple, mixing.mixing_counts(df).collect())) == usual


# URL rules


def test_components_like_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200, 200 + i) for i in range(1, 40)] + [(i, i + 1) for i in range(300, 330)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_url_verdicts(spark):
    page = lambda to: f'<head><link href="{to}" rel=canonical></head>'
    rows = [
        (1, "http://A.Example.COM/en/1?q#f", None),
        (2, "https://example.com/en/77", ""),
        (3, "https://notexample.com/en/7", ""),
        (4, "http://x.net/de/8", ""),
        (5, "http://example.net/de/80", ""),
        (6, "http://free.info/a", page("http://b.com/en/2")),
        (7, "http://free.info/b", page("/a")),
        (8, "http://free.info/c", page("http://free.info/d")),
        (9, "http://free.info/e", '<meta http-equiv="refresh" content="0; url=http://example.com/en/7">'),
        (10, "http://free.info/e2", page("http://free.info/e") + '<meta http-equiv=refresh content="1;url=//b.com/en/9">'),
        (11, None, None),
        (12, "no scheme", ""),
        (13, "http://org", ""),
        (14, "http://org/es/?x", ""),
        (15, "http://free.info/b", ""),
        (16, "http://free.info/b#top", ""),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("host", F.lit("?"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, url_rules.rule_frame(spark)).collect()}
    assert got == {
        1: ("a.example.com", "/en/1", "com/en/", "block"),
        2: ("example.com", "/en/77", "example.com/en/7", "allow"),
        3: ("notexample.com", "/en/7", "com/en/", "block"),
        4: ("x.net", "/de/8", "net/de/", "allow"),
        5: ("example.net", "/de/80", "example.net/de/8", "block"),
        6: ("free.info", "/a", None, "block"),
        7: ("free.info", "/b", None, "block"),
        8: ("free.info", "/c", None, "allow"),
        9: ("free.info", "/e", None, "allow"),
        10: ("free.info", "/e2", None, "allow"),
        11: ("", "", None, "allow"),
        12: ("", "", None, "allow"),
        13: ("org", "", None, "allow"),
        14: ("org", "/es/", "org/es/", "block"),
        15: ("free.info", "/b", None, "block"),
        16: ("free.info", "/b", None, "block"),
    }
    assert url_rules.judge(df.limit(0), url_rules.rule_frame(spark)).count() == 0


LINKED = [
    ("http://free.info/a/b?x=1", '<link rel="canonical" href="http://site.info/p?x=1&amp;y=2">'),
    ("http://site.info/p?x=1&y=2", '<link rel=canonical href=http://b.com/en/2>'),
    ("http://free.info/docs/page", '<link href="?a=1" rel="canonical nofollow">'),
    ("http://free.info/docs/page?a=1", "<meta http-equiv='Refresh' content='0; URL=\"../x\"'>"),
    ("http://free.info/x", '<link rel="canonical" href="//c.org/es/./7/../8">'),
    ("http://free.info/deep/er/", "<link rel=canonical href=../../y/.><link rel='canonical' href='http://free.info/z'>"),
    ("http://free.info/y/", ""),
    ("http://free.info/z", '<meta content="3;url=http://a.net/de/1" http-equiv=refresh>'),
    ("http://free.info/commented", '<!-- <link rel=canonical href="http://b.com/en/2"> --><script>"<link rel=canonical href=http://b.com/en/2>"</script>'),
    ("http://free.info/based", '<base href="http://Other.info/dir/"><link data-href="http://b.com/en/1" rel="canonical" href="in">'),
    ("http://other.info/dir/in", '<link rel="canonical" href="http://b.com/en/&#x34;&#50;">'),
    ("http://free.info/mail", '<link rel="canonical" href="mailto:someone"><link rel=canonical href="#top"><link rel="notcanonical" href="http://b.com/en/2">'),
    ("http://free.info/both", "<link rel=canonical href=http://b.com/en/99><meta http-equiv=refresh content='0;url=http://x.net/de/2'>"),
    (None, '<link rel="canonical" href="http://b.com/en/2">'),
    ("http://free.info/quoted", """<link title='a > b' rel="canonical" href='/based'>"""),
]


def test_stated_links_like_a_url_library(spark):
    """Verdicts against union-find over links that Python's HTML and URL libraries find."""
    from html.parser import HTMLParser
    from urllib.parse import urldefrag, urljoin, urlsplit

    class Links(HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.base, self.found = "", []
            self.feed(page)

        def handle_starttag(self, tag, attrs):
            get = {k: v or "" for k, v in attrs}
            if tag == "base":
                self.base = self.base or get.get("href", "")
            elif tag == "link" and "canonical" in get.get("rel", "").lower().split():
                self.found.append(get.get("href", ""))
            elif tag == "meta" and get.get("http-equiv", "").lower() == "refresh":
                self.found.append(get["content"].split("=", 1)[1].strip("'\" "))

    def node(u):
        parts = urlsplit(urljoin(u, urldefrag(u)[0]))
        return f"{parts.scheme}://{parts.netloc.lower()}{urlsplit(urljoin(u, parts.path or '/')).path}" + (f"?{parts.query}" if parts.query else "")

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, page in LINKED:
        read = Links(page)
        for to in read.found:
            full = urljoin(urljoin(u, read.base), to) if u else ""
            if full.startswith("http") and node(full) != node(u):
                parent[find(node(u))] = find(node(full))

    def rule(u):
        host, path = urlsplit(u).netloc.lower(), urlsplit(u).path
        fits = [(len(r), v) for v, r in url_rules.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return max(fits)[1] if fits else None

    spoken = {}
    for x in list(parent):
        spoken.setdefault(find(x), set()).add(rule(x))
    want = {}
    for i, (u, _) in enumerate(LINKED):
        heard = spoken.get(find(node(u)), set()) if u else set()
        want[i] = (u and rule(u)) or ("allow" if "allow" in heard else "block" if "block" in heard else "allow")
    df = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(LINKED)], "page_id int, url string, html string").withColumns({"rule": F.lit("mine"), "to": F.lit(1)})
    got = {r.page_id: r.verdict for r in url_rules.judge(df, url_rules.rule_frame(spark)).collect()}
    assert got == want and list(got.values()).count("block") >= 8
    assert [want[i] for i in (5, 6, 7, 8, 12)] == ["allow"] * 5


def test_known_redirects_and_large_rule_tables(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://a.info/x", "")], "page_id int, url string, html string")
    edges = spark.createDataFrame([("http://a.info/x", "http://c.org/es/1"), (None, "http://a.info/x")], "from_url string, to_url string")
    assert url_rules.judge(df, url_rules.rule_frame(spark), edges).first().verdict == "block"
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 1)
    assert url_rules.judge(df, url_rules.rule_frame(spark), edges).first().verdict == "block"


def test_links_in_rare_forms(spark):
    """Forms of HTML by which a page tells that its alias is blocked."""
    target = "http://b.org/es/x"
    forms = {
        "refresh without url=": f'<meta http-equiv=refresh content="0; {target}">',
        "refresh with a comma": f'<meta http-equiv="Refresh" content="5,{target}">',
        "refresh with url and quotes": f"<meta http-equiv=refresh content=\"0;URL='{target}'\">",
        "an apostrophe in a bare value": f"<link title=it's rel=canonical href={target}>",
        "an apostrophe in a quoted one": f'<link title="it\'s > that" rel=canonical href="{target}">',
        "line ends around": f'<link rel=canonical href="\n {target}\t\n">',
        "line ends within": '<link rel=canonical href="http://b.org/es\n/x">',
        "named references": '<link rel=canonical href="http&colon;&sol;&sol;b&period;org&sol;es&#47;x">',
        "a default port": '<link rel=canonical href="HTTP://B.org:80/es/x">',
        "a bare value with a quote at its end": f"<link rel=canonical data-x=5' href={target}>",
    }
    no_link = {
        "in a frame": f'<iframe><link rel=canonical href="{target}"></iframe>',
        "a number alone": '<meta http-equiv=refresh content="30">',
        "in a comment": f'<!-- <link rel=canonical href="{target}"> -->',
    }
    pages = [(i, f"http://n{i}.site/p", markup) for i, markup in enumerate([*forms.values(), *no_link.values()])]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {r.page_id: r.verdict for r in url_rules.judge(df, url_rules.rule_frame(spark)).collect()}
    for i, name in enumerate([*forms, *no_link]):
        assert got[i] == ("block" if name in forms else "allow"), name
    ports = spark.createDataFrame([("https://a.b:443/x",), ("https://a.b:80/x",), ("http://a.b:80",), ("http://a.b:8080/",)], "u string")
    assert [r[0] for r in ports.select(url_rules.node_of(F.col("u"))).collect()] == ["https://a.b/x", "https://a.b:80/x", "http://a.b/", "http://a.b:8080/"]
