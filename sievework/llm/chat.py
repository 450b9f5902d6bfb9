r"""Chat formatting by schema fingerprints (operator 2).

Records come in many layouts (lists of messages, prompt and response, instruction and
input). The nested field paths that hold a value in a record are hashed; the fingerprint
selects a declarative mapping to canonical turns ``array<struct<role, text>>``. Turns
are rendered with control strings around them and a loss mask over assistant texts.

Control strings all begin with ``<|``. Inside roles and texts ``\`` becomes ``\\`` and
``<|`` becomes ``<\|``, so no text can imitate a control string, and dropping one ``\``
before each escaped character restores it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
TURNS_TYPE = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping from field paths to turns.

    Either ``turns`` names an array of structs with ``role_field`` and ``text_field``, or
    ``parts`` lists (role, paths): the texts at these paths, blank line between, are one
    turn of that role, left out where all are null. ``required`` and ``optional`` are the
    paths that a record of this layout has and may have; an array's items are ``name[]``.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: str | None = None
    role_field: str = "role"
    text_field: str = "content"
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


#: Layouts known by default. Roles are renamed only where a layout says so.
LAYOUTS = (
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), turns="messages"),
    Layout("conversations", ("conversations[]",), ("conversations[].from", "conversations[].value"), turns="conversations", role_field="from", text_field="value", roles={"human": "user", "gpt": "assistant", "bot": "assistant"}),
    Layout("prompt_response", ("prompt", "response"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question_answer", ("qa.question", "qa.answer"), (), parts=(("user", ("qa.question",)), ("assistant", ("qa.answer",)))),
)


def _has(schema: T.DataType, path: str) -> bool:
    for step in path.split("."):
        name = step.removesuffix("[]")
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return False
        schema = schema[name].dataType
        if step.endswith("[]"):
            if not isinstance(schema, T.ArrayType):
                return False
            schema = schema.elementType
    return True


def _present(record: Column, path: str) -> Column:
    """Whether the path holds a value, in any item where it goes through an array."""
    head, array, rest = path.partition("[]")
    here = record
    for step in head.split("."):
        here = here[step]
    if not array:
        return here.isNotNull()
    if not rest:
        return here.isNotNull()
    return F.coalesce(F.exists(here, lambda item: _present(item, rest[1:])), F.lit(False))


def _digest(paths: Sequence[str]) -> str:
    return "\n".join(sorted(paths))


def fingerprint(df: DataFrame, record: str, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the sorted paths, of those any layout names, that hold a value in the record."""
    schema = df.schema[record].dataType
    known = sorted({p for x in layouts for p in (*x.required, *x.optional) if _has(schema, p)})
    found = F.array_compact(F.array(*(F.when(_present(F.col(record), p), F.lit(p)) for p in known))) if known else F.array().cast("array<string>")
    return F.md5(F.array_join(found, "\n"))


def _fits(layout: Layout) -> Column:
    """The fingerprints of a layout: its required paths with each choice of optional ones."""
    return F.array(*(F.md5(F.lit(_digest([*layout.required, *extra]))) for n in range(len(layout.optional) + 1) for extra in combinations(layout.optional, n)))


def _turns(record: Column, schema: T.DataType, layout: Layout) -> Column:
    def at(path: str) -> Column:
        here = record
        if not _has(schema, path):
            return F.lit(None).cast("string")
        for step in path.split("."):
            here = here[step]
        return here.cast("string")

    def role(name: Column) -> Column:
        out = F.coalesce(name, F.lit(""))
        for old, new in layout.roles.items():
            out = F.when(name == old, F.lit(new)).otherwise(out)
        return out

    if layout.turns:
        items = schema[layout.turns].dataType.elementType.names
        get = lambda item, name: item[name].cast("string") if name in items else F.lit(None).cast("string")
        made = F.transform(record[layout.turns], lambda m: F.struct(role(get(m, layout.role_field)).alias("role"), F.coalesce(get(m, layout.text_field), F.lit("")).alias("text")))
    else:
        parts = []
        for name, paths in layout.parts:
            texts = F.array_compact(F.array(*map(at, paths)))
            parts.append(F.when(F.size(texts) > 0, F.struct(F.lit(name).alias("role"), F.array_join(texts, "\n\n").alias("text"))))
        made = F.array_compact(F.array(*parts))
    return made.cast(TURNS_TYPE)


def canonical_turns(df: DataFrame, record: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``df`` with ``schema_fingerprint``, ``layout`` and ``turns`` for the struct column ``record``.

    A record that fits no layout (a null record among them) keeps its row, with null layout
    and turns. Null texts and roles become empty; a list without items gives no turns.
    Fields that no layout names don't count, nor does the order of fields. Columns of
    ``df`` with the new names are replaced.
    """
    schema = df.schema[record].dataType
    usable = [x for x in layouts if all(_has(schema, p) for p in x.required)]
    mark = F.col("schema_fingerprint")
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS_TYPE)
    for x in usable[::-1]:
        hit = F.array_contains(_fits(x), mark)
        name, turns = F.when(hit, F.lit(x.name)).otherwise(name), F.when(hit, _turns(F.col(record), schema, x)).otherwise(turns)
    return df.withColumn("schema_fingerprint", fingerprint(df, record, layouts)).withColumns({"layout": name, "turns": turns})


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(df: DataFrame, turns: str = "turns", trained_role: str = "assistant") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans``.

    ``loss_spans`` are [start, end) code points of ``formatted`` that hold the escaped
    text of each turn of ``trained_role``, in order. Null turns give null for both, no
    turns the empty string and no spans. Columns with the new names are replaced.
    """
    made = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(TURN), escape(F.coalesce(t["role"], F.lit(""))), F.lit(TEXT)).alias("head"),
            escape(F.coalesce(t["text"], F.lit(""))).alias("body"),
            (F.coalesce(t["role"], F.lit("")) == trained_role).alias("trained"),
        ),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    whole = df.withColumn("__made", made)
    return whole.withColumns(
        {
            "formatted": F.array_join(F.transform("__made", lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""),
            "loss_spans": F.aggregate("__made", start, step, lambda acc: acc["spans"]),
        }
    ).drop("__made")


def parse(formatted: Column) -> Column:
    """The turns, unescaped, that a rendered text holds; the exact inverse of :func:`render`."""
    split = F.split(formatted, r"<\|turn\|>")
    pieces = F.slice(split, F.lit(2), F.size(split) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, TEXT, 1)
        skip = F.length(head) + len(TEXT)
        return F.struct(unescape(head).alias("role"), unescape(F.substr(piece, skip + 1, F.length(piece) - skip - len(END))).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def gather_turns(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one record ``messages`` per key, ordered by turn, then role and text.

    A conversation is one value of the result, so its turns meet in one row by need.
    Rows with a null key are one conversation; repeated rows stay.
    """
    item = F.struct(F.col(order), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy(key).agg(F.struct(ordered.alias("messages")).alias("record"))
