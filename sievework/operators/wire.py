"""The strict wire form of tool calls: parsing, numbering, schema checks, private keys.

Outputs are parsed by column expressions over variants, so that those of any length are read
in the scan's own stage. The first rule that an output breaks names its failure. Values of any
depth are walked once, as JSON in Arrow batches: variants are copied anew at every level.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as X

BLOCK = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
CALLS = "array<struct<id:string,index:bigint,name:string,arguments:string>>"
MAX_CALLS = 3


#: A rule of an argument: its JSON types, least and greatest number, allowed texts, whether it is required.
Rule = tuple[Sequence[str], float | None, float | None, Sequence[str] | None, bool]


def kind_of(value: Column) -> Column:
    """JSON type of a variant: object, array, string, integer, number, boolean or null; null for none."""
    shown = F.schema_of_variant(value)
    return (
        F.when(shown.startswith("OBJECT"), "object").when(shown.startswith("ARRAY"), "array").when(shown == "STRING", "string")
        .when(shown == "BIGINT", "integer").when(shown == "BOOLEAN", "boolean").when(shown == "VOID", "null").when(value.isNotNull(), "number")
    )


def at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def canonical_arguments(value: Column) -> Column:
    """An object's items as ``key=value`` in order of the keys, values as compact JSON."""
    items = F.map_entries(F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return F.array_join(F.array_sort(F.transform(items, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.to_json(e["value"]), F.lit("null"))))), ",")


def _call(value: Column, position: Column, schemas: Mapping | None) -> Column:
    """One call of a JSON value, with its failure."""
    name, arguments, index = at(value, "$.name", "string"), at(value, "$.arguments"), at(value, "$.index")
    failure = (
        F.when(value.isNull(), "invalid_json")
        .when(kind_of(value) != "object", "not_an_object")
        .when(F.coalesce(kind_of(at(value, "$.name")), F.lit("")) != "string", "no_name")
        .when(F.trim(name) == "", "no_name")
        .when(F.coalesce(kind_of(arguments), F.lit("")) != "object", "arguments_not_an_object")
        .when(F.coalesce(kind_of(index), F.lit("null")).isin("null", "integer") == F.lit(False), "index_not_an_integer")
    )
    if schemas is not None:
        failure = F.coalesce(failure, F.get(schema_errors(F.trim(name), arguments, schemas), F.lit(0)))
    given = F.when(kind_of(at(value, "$.id")) == "string", F.nullif(F.trim(at(value, "$.id", "string")), F.lit("")))
    return F.struct(given.alias("id"), F.coalesce(at(value, "$.index", "bigint"), position.cast("bigint")).alias("index"), F.trim(name).alias("name"), canonical_arguments(arguments).alias("arguments"), failure.alias("failure"))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def strict_parse(rows: DataFrame, raw: str = "raw_output", max_calls: int = MAX_CALLS, schemas: Mapping[str, Mapping[str, Rule]] | None = None) -> DataFrame:
    """Rows with ``failure``, ``calls`` and ``content``.

    Blocks may have no prose outside them (between them it may stand); a bare object may
    hold a list ``tool_calls`` (anything else under that name fails), one call, or ``content``;
    any other text is content. With ``schemas`` a call's tool must be one of them, and its
    arguments must keep its rules; the first error of :func:`schema_errors` is the failure. More
    than ``max_calls`` calls, indexes other than 0, 1, ... and repeated ids are failures.
    A failed output has no calls and no content; a null output is empty.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    blocks = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))
    outside = F.concat(F.regexp_extract(text, r"(?s)\A(.*?)<tool_call>\s*.*?\s*</tool_call>", 1), F.regexp_extract(text, r"(?s)\A.*</tool_call>(.*)\z", 1))
    bare = F.try_parse_json(text)
    listed = at(bare, "$.tool_calls", "array<variant>")
    call = lambda v, i: _call(v, i, schemas)
    calls = F.when(F.size(blocks) > 0, F.transform(F.transform(blocks, lambda b: F.try_parse_json(b)), call)).when(
        F.startswith(text, F.lit("{")), F.when(at(bare, "$.tool_calls").isNotNull(), F.transform(listed, call)).when(at(bare, "$.name").isNotNull() & at(bare, "$.arguments").isNotNull(), F.array(call(bare, F.lit(0))))
    )
    made = F.coalesce(calls, F.array().cast("array<struct<id:string,index:bigint,name:string,arguments:string,failure:string>>"))
    read = rows.withColumns({"__t": text, "__b": F.size(blocks) > 0, "__o": F.trim(outside), "__v": bare, "__c": made})
    c, is_bare = F.col("__c"), ~F.col("__b") & F.startswith("__t", F.lit("{"))
    ids = F.filter(F.transform(c, lambda x: x["id"]), lambda i: i.isNotNull())
    failure = (
        F.when(F.col("__t") == "", "empty")
        .when(F.col("__b") & (F.col("__o") != ""), "prose_outside_blocks")
        .when(~F.col("__b") & (F.contains("__t", F.lit("<tool_call")) | F.contains("__t", F.lit("</tool_call>"))), "malformed_block")
        .when(is_bare & F.col("__v").isNull(), "invalid_json")
        .when(is_bare & (kind_of(at(F.col("__v"), "$.tool_calls")) != "array"), "tool_calls_not_a_list")
        .when(_first(F.transform(c, lambda x: x["failure"])).isNotNull(), _first(F.transform(c, lambda x: x["failure"])))
        .when(is_bare & (F.size(c) == 0) & at(F.col("__v"), "$.tool_calls").isNull() & at(F.col("__v"), "$.content").isNull(), "neither_calls_nor_content")
        .when(F.size(c) > max_calls, "too_many_calls")
        .when(F.exists(c, lambda x: x["index"].isNull()) | (F.array_join(F.transform(c, lambda x: x["index"].cast("string")), ",") != F.array_join(F.transform(c, lambda x, i: i.cast("string")), ",")), "index_order")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_id")
    )
    content = F.when(is_bare, at(F.col("__v"), "$.content", "string")).when(~F.col("__b"), F.col("__t"))
    good = F.transform(c, lambda x: F.struct(x["id"], x["index"], x["name"], x["arguments"])).cast(CALLS)
    out = read.withColumn("failure", failure)
    return out.withColumns({"calls": F.when(F.col("failure").isNull(), good).otherwise(F.array().cast(CALLS)), "content": F.when(F.col("failure").isNull(), content)}).drop("__t", "__b", "__o", "__v", "__c")


def schema_errors(tool: Column, arguments: Column, schemas: Mapping[str, Mapping[str, Rule]]) -> Column:
    """Sorted errors ``rule:argument`` of a variant of arguments under its tool's schema.

    An integer is a number too; a boolean is neither. Only numbers meet bounds and only
    texts meet lists. Arguments without a rule are extra; an unknown tool is one error.
    """
    rule_type = "array<struct<name:string,types:array<string>,low:double,high:double,listed:array<string>,required:boolean>>"

    def rules(schema: Mapping[str, Rule]) -> Column:
        rows = [F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, t)).alias("types"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"), (F.array(*map(F.lit, e)) if e else F.lit(None).cast("array<string>")).alias("listed"), F.lit(r).alias("required")) for n, (t, low, high, e, r) in schema.items()]
        return (F.array(*rows) if rows else F.array()).cast(rule_type)

    table = F.create_map(*(x for k, v in schemas.items() for x in (F.lit(k), rules(v))))
    items = F.coalesce(F.try_variant_get(arguments, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))

    def judged(own: Column) -> Column:
        def check(r: Column) -> Column:
            value = F.try_element_at(items, r["name"])
            kind, number = kind_of(value), F.try_variant_get(value, "$", "double")
            fits = F.array_contains(r["types"], kind) | ((kind == "integer") & F.array_contains(r["types"], "number"))
            numeric = kind.isin("integer", "number")
            name = r["name"]
            return (
                F.when(~F.map_contains_key(items, name), F.when(r["required"], F.concat(F.lit("missing:"), name)))
                .when(~fits, F.concat(F.lit("type:"), name))
                .when(numeric & (number < r["low"]), F.concat(F.lit("minimum:"), name))
                .when(numeric & (number > r["high"]), F.concat(F.lit("maximum:"), name))
                .when((kind == "string") & r["listed"].isNotNull() & ~F.array_contains(r["listed"], F.try_variant_get(value, "$", "string")), F.concat(F.lit("enum:"), name))
            )

        extra = F.transform(F.array_except(F.map_keys(items), F.transform(own, lambda r: r["name"])), lambda k: F.concat(F.lit("extra:"), k))
        return F.array_sort(F.concat(F.array_compact(F.transform(own, check)), extra))

    return F.coalesce(X.let(F.try_element_at(table, tool), judged), F.array(F.lit("unknown_tool")))


#: Levels that the functions over nested values look through unless told; a value that is deeper stops the query.
DEPTH = 4


def depth(value: Column) -> Column:
    """How deep objects and lists are nested in a variant: 0 for a scalar. Read from the brackets of its JSON."""
    shown = F.regexp_replace(F.to_json(value), r'"(?:[^"\\]|\\.)*+"|[^\[\]{}"]++', "")
    opened = F.transform(F.split(shown, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda acc, d: F.struct((acc["now"] + d).alias("now"), F.greatest(acc["most"], acc["now"] + d).alias("most"))
    return F.coalesce(F.aggregate(opened, zero, step, lambda acc: acc["most"]), F.lit(0))


def deepest(rows: DataFrame, value: str) -> int:
    """The greatest depth of a column, by one pass over it: the ``depth`` to give to the functions below."""
    return rows.agg(F.max(depth(F.col(value))).alias("d")).first()["d"] or 0


def canonical_json(value: Column) -> Column:
    """JSON without spaces, with keys sorted at every level; whole numbers are shown without a fraction."""
    return F.to_json(value)


def record_hash(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(value), 256))


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _items(value: Column) -> Column:
    """The items of an object, and those of a list with null keys; null for a scalar."""
    named = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(named, listed)


def without_private(value: Column, public: Sequence[str] = (), depth: int = DEPTH) -> Column:
    """A variant without the items of its objects, at any level, whose key ends in ``_id``, but for those public.

    A value nested deeper than ``depth`` stops the query.
    """
    hidden = lambda k: F.endswith(k, F.lit("_id")) & ~(k.isin(list(public)) if public else F.lit(False))

    def strip(v: Column, left: int) -> Column:
        if left == 0:
            return F.when(_items(v).isNotNull(), F.parse_json(F.raise_error(F.lit("a value is nested deeper than told; see wire.deepest")).cast("string"))).otherwise(v)
        kept = F.filter(_items(v), lambda e: ~F.coalesce(hidden(e["key"]), F.lit(False)))
        done = F.transform(kept, lambda e: F.struct(e["key"].alias("key"), strip(e["value"], left - 1).alias("value")))
        rebuilt = lambda d: F.when(d.isNull(), v).when(_is_object(v), F.to_variant_object(F.map_from_entries(d))).otherwise(F.to_variant_object(F.transform(d, lambda e: e["value"])))
        return X.let(done, rebuilt)

    return strip(value, depth)


def _gathered(value: Column, levels: int, own: Callable[[Column, Column], Column]) -> Column:
    """The texts that ``own(key, value)`` finds (an array) at each item of a variant, in all levels; an item of a list has its list's key."""
    none = F.array().cast("array<string>")

    def gather(key: Column, v: Column, left: int) -> Column:
        if left == 0:
            return F.when(_items(v).isNotNull(), F.array(F.raise_error(F.lit("a value is nested deeper than told; see wire.deepest")).cast("string"))).otherwise(own(key, v))
        below = F.transform(_items(v), lambda e: gather(F.coalesce(e["key"], key), e["value"], left - 1))
        return F.coalesce(F.flatten(below), own(key, v))

    return F.coalesce(F.when(value.isNotNull(), gather(F.lit(""), value, levels)), none)


def private_values(value: Column, depth: int = DEPTH) -> Column:
    """Distinct texts at keys that end in ``_id``, at any level, sorted; a value nested deeper than ``depth`` stops the query."""
    none = F.array().cast("array<string>")
    found = _gathered(value, depth, lambda key, v: F.when(F.endswith(key, F.lit("_id")) & (kind_of(v) == "string"), F.array(F.try_variant_get(v, "$", "string"))).otherwise(none))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: t != "")))


def _forms(key: Column, v: Column) -> Column:
    """A scalar's normalized text, and for a whole number at a ``*_cents`` key its amounts; empty for a null, an object or a list."""
    none = F.array().cast("array<string>")
    cents = F.abs(F.try_variant_get(v, "$", "bigint"))
    whole, part = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    amounts = F.array(F.concat(whole.cast("string"), F.lit("."), part), F.concat(F.format_number(whole, 0), F.lit("."), part))
    one = F.concat(F.array(X.normalize(F.try_variant_get(v, "$", "string"))), F.when(F.endswith(key, F.lit("_cents")) & (kind_of(v) == "integer"), amounts).otherwise(none))
    return F.when(kind_of(v).isin("string", "integer", "number", "boolean"), one).otherwise(none)


def scalars(value: Column, depth: int = DEPTH) -> Column:
    """All scalars of a variant as normalized texts, whole numbers at ``*_cents`` keys as amounts too, sorted; a value nested deeper than ``depth`` stops the query."""
    return F.array_sort(F.array_distinct(_gathered(value, depth, _forms)))


class _Number(str):
    """A number as its JSON shows it."""


def _shown(v: object) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_shown(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_shown, v)) + "]"
    return v if isinstance(v, _Number) else json.dumps(v, ensure_ascii=False)


def _loaded(text: str) -> object:
    sys.setrecursionlimit(1 << 16)  # Spark reads JSON of a thousand levels
    return json.loads(text, parse_float=_Number, parse_int=_Number)


def parted(text: str, public: frozenset[str]) -> tuple[str, list[str], int]:
    """A JSON text without its private items, the texts at private keys, sorted, and the depth."""
    ids = set()

    def strip(key: str, v: object) -> tuple[object, int]:
        if isinstance(v, dict):
            done = [(k, *strip(k, x)) for k, x in v.items()]
            return {k: x for k, x, _ in done if not k.endswith("_id") or k in public}, 1 + max((n for _, _, n in done), default=0)
        if isinstance(v, list):
            done = [strip(key, x) for x in v]
            return [x for x, _ in done], 1 + max((n for _, n in done), default=0)
        if v and type(v) is str and key.endswith("_id"):
            ids.add(v)
        return v, 0

    bare, levels = strip("", _loaded(text))
    return _shown(bare), sorted(ids), levels


def scalar_texts(text: str) -> tuple[list[str], list[str]]:
    """All scalars of a JSON text but nulls, as texts, and whole numbers at ``*_cents`` keys as amounts in two forms."""
    plain, amounts, left = [], [], [("", _loaded(text))]
    while left:
        key, v = left.pop()
        if isinstance(v, dict):
            left.extend(v.items())
        elif isinstance(v, list):
            left.extend((key, x) for x in v)
        elif v is not None:
            plain.append(v if isinstance(v, str) else "true" if v else "false")
            if isinstance(v, _Number) and key.endswith("_cents") and v.lstrip("-").isdigit() and -(1 << 63) <= int(v) < 1 << 63:
                whole, part = divmod(abs(int(v)), 100)
                amounts += (f"{whole}.{part:02}", f"{whole:,}.{part:02}")
    return plain, amounts


def _apart(value: Column, public: Sequence[str] = ()) -> Column:
    """``bare`` (JSON without the private items), ``ids`` and ``depth`` of a variant, whatever its depth; null for null."""
    kept = frozenset(public)

    @F.arrow_udf("struct<bare:string,ids:array<string>,depth:int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = [parted(t.as_py(), kept) if t.is_valid else (None, None, None) for t in batch]
            fields = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.list_(pa.string()), pa.int32()))]
            yield pa.StructArray.from_arrays(fields, names=["bare", "ids", "depth"])

    return of(F.to_json(value))


def _scalar_forms(value: Column) -> Column:
    """The normalized texts (``plain``, not normalized yet) and ``amounts`` of a variant's scalars, whatever its depth."""

    @F.arrow_udf("struct<plain:array<string>,amounts:array<string>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = [scalar_texts(t.as_py()) if t.is_valid else ([], []) for t in batch]
            fields = [pa.array([m[i] for m in made], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.StructArray.from_arrays(fields, names=["plain", "amounts"])

    return of(F.to_json(value))


def with_private_apart(rows: DataFrame, value: str, public: Sequence[str] = (), depth: str | None = None) -> DataFrame:
    """``rows`` with ``value`` without its private items, and ``private_ids``, their texts: at whatever depth the column has.

    A value is walked once; ``depth`` names a column for its depth.
    """
    others = [c for c in rows.columns if c not in (value, "private_ids", depth)]
    read = rows.select(*others, _apart(F.col(value), public).alias("__r"))
    ids = F.coalesce("__r.ids", F.array().cast("array<string>"))
    told = {value: F.parse_json("__r.bare"), "private_ids": ids} | ({depth: F.coalesce("__r.depth", F.lit(0))} if depth else {})
    return read.withColumns(told).drop("__r")


def scalar_sets(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``facts`` in place of the variant ``value``: the distinct forms of all its scalars, at any depth."""
    others = [c for c in rows.columns if c != value]
    read = rows.select(*others, _scalar_forms(F.col(value)).alias("__r"))
    facts = F.concat(F.transform("__r.plain", X.normalize), "__r.amounts")
    return read.select(*others, F.array_distinct(facts).alias("facts"))


def scalar_rows(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with a ``fact`` in place of the variant ``value``: one row for each form of each of its scalars, at any depth.

    Each level is one explode in the same stage, where scalars stay as they are; as many
    follow as the deepest value has levels, so no level is lost and no expression nests.
    """
    others = [c for c in rows.columns if c != value]
    item = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    spread = rows.select(*others, item(F.lit(""), F.col(value)).alias("__item"))
    for _ in range(deepest(rows, value)):
        below = F.transform(_items(F.col("__item.value")), lambda e: item(F.coalesce(e["key"], F.col("__item.key")), e["value"]))
        spread = spread.select(*others, F.explode(F.coalesce(below, F.array("__item"))).alias("__item"))
    return spread.select(*others, F.explode(_forms(F.col("__item.key"), F.col("__item.value"))).alias("fact"))
