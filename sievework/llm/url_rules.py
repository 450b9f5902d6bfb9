"""URL block lists with redirect equivalence (operator 7).

Rules name a host, its subdomains included, and a path prefix; the longest rule that
fits a URL decides. URLs that redirects or canonical links connect are aliases: where no
rule of its own fits, a URL is blocked if a rule blocks any alias, unless a rule allows one.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm._common import connected_components, settle

#: Rows of the rule table up to which it is broadcast.
BROADCAST_RULES = 100_000
#: (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Named character references of one code point below U+0100, as HTML lists them.
NAMED_REFERENCES = {k[:-1]: v for k, v in html5.items() if k.endswith(";") and len(v) == 1 and ord(v) < 256}
#: Ports that a scheme means unless another is told.
DEFAULT_PORTS = (("http", ":80"), ("https", ":443"), ("ws", ":80"), ("wss", ":443"), ("ftp", ":21"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; a path that ends in one ends in a slash."""
    steps = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))

    def walk(acc: Column, step: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))
        return F.when(step == "..", up).when(step == ".", acc).otherwise(F.concat(acc, F.array(step)))

    kept = F.aggregate(steps, F.array().cast("array<string>"), walk)
    whole = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.concat(F.lit("/"), F.array_join(whole, "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """The URL as a node: scheme and host in lower case, no default port, dot segments or fragment; a slash for an empty path."""
    path = without_dots(path_of(url))
    scheme, host = F.translate(F.regexp_extract(url, r"(?s)\A(.*?)://", 1), _UPPER, _LOWER), host_of(url)
    for name, port in DEFAULT_PORTS:
        host = F.when((scheme == name) & F.endswith(host_of(url), F.lit(port)), F.regexp_replace(host_of(url), rf"{port}\z", "")).otherwise(host)
    return F.concat(
        scheme,
        F.lit("://"),
        host,
        F.when(path == "", "/").otherwise(path),
        F.regexp_extract(url, r"(?s)\A[^#]*?(\?[^#]*)", 1),
    )


def rule_frame(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Rules as rows ``rule, verdict, rule_host, rule_path``."""
    items = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for v, r in rules))
    rows = spark.range(1).select(F.inline(items))
    return rows.select("rule", "verdict", F.translate(F.regexp_extract("rule", r"\A([^/]*)", 1), _UPPER, _LOWER).alias("rule_host"), F.regexp_extract("rule", r"\A[^/]*(.*)", 1).alias("rule_path"))


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each distinct ``url``: ``url, rule, verdict``; no row where none fits.

    A URL meets the rules of its host and of each parent domain by an equi-join on that
    host. Among rules of one length, allow goes before block.
    """
    labels = F.split(F.col("host"), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    split = urls.select("url").where(F.col("url").isNotNull()).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    at = split.select("url", "path", F.explode(parents).alias("rule_host"))
    side = F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules
    rank = F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("a"), F.col("rule"))
    return (
        at.join(side, "rule_host")
        .where(F.startswith("path", F.col("rule_path")))
        .groupBy("url")
        .agg(F.max_by(F.struct("rule", "verdict"), rank).alias("r"))
        .select("url", "r.*")
    )


def _tags(page: Column, name: str) -> Column:
    """Tags of a name; quotes hold a value together only where one begins it."""
    return F.regexp_extract_all(page, F.lit(rf"""(?is)<{name}\b(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+|["'])*+>"""), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, character references decoded; empty where there is none."""
    quoted = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)""", 1)
    return F.trim(unescape_references(F.regexp_replace(quoted, r"""(?s)\A(["'])(.*)\1\z""", "$2")))


def unescape_references(text: Column) -> Column:
    """Numeric character references and NAMED_REFERENCES, decoded once."""
    named = F.create_map(*(F.lit(x) for item in NAMED_REFERENCES.items() for x in item))

    def one(piece: Column) -> Column:
        body, rest = F.regexp_extract(piece, r"(?s)\A([^;]*);", 1), F.regexp_extract(piece, r"(?s)\A[^;]*;(.*)", 1)
        number = F.when(body.rlike(r"\A#[xX][0-9A-Fa-f]{1,6}\z"), F.conv(F.substr(body, F.lit(3)), 16, 10)).when(body.rlike(r"\A#[0-9]{1,7}\z"), F.substr(body, F.lit(2))).cast("int")
        legal = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.when(legal, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.coalesce(F.concat(F.coalesce(char, F.try_element_at(named, body)), rest), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    return F.when(F.contains(text, F.lit("&")), F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), one), ""))).otherwise(text)


def resolve(to: Column, base: Column) -> Column:
    """The absolute URL that ``to`` means on a page at ``base``; null for other schemes and for the page itself.

    Controls and blanks around it, and tabs and line ends within, don't belong to it.
    """
    to = F.regexp_replace(F.regexp_replace(to, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    scheme, site = F.regexp_extract(base, r"(?s)\A(.*?)://", 1), F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*)", 1)
    path = path_of(base)
    folder = F.regexp_extract(path, r"(?s)\A(.*/)", 1)
    return (
        F.when(to.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:") | (to == "") | F.startswith(to, F.lit("#")), F.lit(None).cast("string"))
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(site, to))
        .when(F.startswith(to, F.lit("?")), F.concat(site, F.when(path == "", "/").otherwise(path), to))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), to))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Alias edges ``from_url, to_url`` that pages state: all their canonical links and refresh redirects.

    Comments and the content of scripts, styles, templates, text areas, titles and frames state nothing. References
    are decoded and relative targets resolved against the page's URL, or its base element.
    """
    said = pages.where(F.col(html).rlike("(?i)canonical|refresh") & F.col(url).contains("://"))
    bare = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|iframe|noembed|noframes|xmp)\b.*?(?:</\1\s*>|\z)", " ")
    page = said.select(F.col(url).alias("from_url"), bare.alias("page"))
    based = page.withColumn("based", F.transform(_tags(F.col("page"), "base"), lambda t: _attribute(t, "href")))
    at = F.coalesce(resolve(F.get(F.filter("based", lambda h: h != ""), F.lit(0)), F.col("from_url")), F.col("from_url"))
    words = lambda tag: F.split(F.lower(_attribute(tag, "rel")), r"\s+")
    canonical = F.transform(F.filter(_tags(F.col("page"), "link"), lambda t: F.array_contains(words(t), "canonical")), lambda t: _attribute(t, "href"))
    fresh = F.transform(
        F.filter(_tags(F.col("page"), "meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"),
        lambda t: F.trim(F.regexp_replace(F.regexp_extract(_attribute(t, "content"), r"(?is)\A(?:.*?\burl\s*=|\s*[0-9.]+\s*[;,\s](?!.*\burl\s*=))\s*(.*)", 1), r"""(?s)\A(["'])(.*?)(?:\1.*)?\z""", "$2")),
    )
    found = based.select("from_url", at.alias("at"), F.explode(F.array_distinct(F.concat(canonical, fresh))).alias("to"))
    return found.select("from_url", resolve(F.col("to"), F.col("at")).alias("to_url")).where("to_url IS NOT NULL")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    ``edges`` (``from_url, to_url``) are redirects known beside those that pages state. A
    URL with no rule takes ``allow`` if a rule allows an alias, else ``block`` if a rule
    blocks one, else ``allow``. Null URLs and those without ``://`` have empty host and
    path, no rule, and are allowed. Rows stay as they are, repeated ones included.
    """
    stated = page_links(pages, url, html)
    if edges is not None:
        stated = stated.unionByName(edges.select("from_url", "to_url").where("from_url LIKE '%://%' AND to_url LIKE '%://%'"))
    links = settle(stated.distinct())
    listed = pages.select(F.col(url).alias("url"))
    ends = links.select(F.explode(F.array("from_url", "to_url")).alias("url"))
    ruled = settle(apply_rules(listed.unionByName(ends), rules))
    kept = pages.drop("host", "path", "rule", "verdict", "alias_verdict")
    # Null URLs meet nothing; they are spread by their page, as one key they would all go to one task.
    key = F.coalesce(F.col(url), F.concat(F.lit("null "), F.pmod(F.xxhash64(html), F.lit(1 << 12)).cast("string")))
    out = kept.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "__key": key}).join(ruled.select(F.col("url").alias("__key"), "rule", "verdict"), "__key", "left")
    if links.limit(1).count():
        roots = settle(connected_components(links.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))))
        marked = roots.join(ruled.select(node_of(F.col("url")).alias("node"), F.col("verdict").alias("v")), "node")
        spoken = marked.groupBy("root").agg(F.min("v").alias("alias_verdict"))  # 'allow' sorts before 'block'
        passed = settle(roots.join(spoken, "root").select(F.col("node").alias("__node"), "alias_verdict"))
        out = out.withColumn("__node", F.coalesce(node_of(F.col(url)), "__key")).join(passed, "__node", "left").drop("__node")
    else:
        out = out.withColumn("alias_verdict", F.lit(None).cast("string"))
    return out.withColumn("verdict", F.coalesce("verdict", "alias_verdict", F.lit("allow"))).select(*kept.columns, "host", "path", "rule", "verdict", "alias_verdict")
