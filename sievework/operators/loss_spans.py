"""Labels of tokens under loss: spans of characters laid over the tokens of any tokenizer.

Texts are rendered from messages with the places where each begins and ends, so that no
prefix is encoded anew; a span must begin and end where a token does, else the loss would
cover a part of what it must not.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import let

IGNORED = -100
# What ends an assistant's span in a rendered text; the nearest counts, and it belongs to the span.
END_MARKERS = ("<|im_end|>", "<|end_of_role|>", "\nuser:", "\ntool ")
SPAN = "struct<start:bigint,end:bigint>"
#: Places after which those found so far are handed on: 8 MB.
PLACES = 1 << 19


def rendered(messages: Column, line: Callable[[Column], Column], prompt: str, separator: str = "\n") -> Column:
    """Text of an array of messages (``role, loss``, and what ``line`` shows), with the ``spans`` of its trained assistant messages.

    A message's span begins after ``prompt``, which its line must begin with, and ends with its
    line. A null ``loss`` trains.
    """
    zero = F.struct(F.lit("").alias("text"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        def add(shown: Column) -> Column:
            glued = F.when(acc["text"] == "", shown).otherwise(F.concat(acc["text"], F.lit(separator), shown))
            begin = F.when(acc["text"] == "", F.lit(0)).otherwise(F.length(acc["text"]) + len(separator)).cast("bigint")
            span = F.struct((begin + len(prompt)).alias("start"), (begin + F.length(shown)).cast("bigint").alias("end"))
            trained = (m["role"] == "assistant") & F.coalesce(m["loss"], F.lit(True)) & F.startswith(shown, F.lit(prompt))
            return F.struct(glued.alias("text"), F.when(trained, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return let(line(m), add)

    return F.aggregate(messages, zero, step)


def span_end(text: Column, start: Column) -> Column:
    """Where a span that begins at ``start`` ends: after the nearest of END_MARKERS; null where none follows."""
    found = F.array(*(F.struct(F.call_function("locate", F.lit(m), text, (start + 1).cast("int")).alias("at"), F.lit(len(m)).alias("n")) for m in END_MARKERS))
    nearest = F.array_min(F.filter(found, lambda x: x["at"] > 0))
    return (nearest["at"] - 1 + nearest["n"]).cast("bigint")


class Pieces:
    """A tokenizer that cuts a text into the matches of a pattern."""

    def __init__(self, pattern: str):
        self.pattern = re.compile(pattern)

    def __call__(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text)]


def offsets(text: Column, tokenizer: Callable[[], Callable[[str], list[tuple[int, int]]]]) -> Column:
    """Places (array of SPAN, in code points) of a text's tokens; ``tokenizer`` makes, once in a task, what gives them. Null texts have none.

    Places leave as flat numbers once there are PLACES of them, so that a task holds those of some texts, not of a batch.
    """

    @F.arrow_udf(f"array<{SPAN}>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return placed(batches, tokenizer())

    return of(text)


def placed(batches: Iterator[pa.Array], cut: Callable[[str], list[tuple[int, int]]]) -> Iterator[pa.Array]:
    """A list of places for each text of ``batches``, in pieces that end once they hold PLACES of them."""
    for batch in batches:
        flat, ends = array("q"), [0]
        for t in batch:
            for place in cut(t.as_py()) if t.is_valid else ():
                flat.extend(place)
            ends.append(len(flat) // 2)
            if ends[-1] >= PLACES:
                yield _place_lists(flat, ends)
                flat, ends = array("q"), [0]
        if len(ends) > 1:
            yield _place_lists(flat, ends)


def _place_lists(flat: array, ends: list[int]) -> pa.Array:
    both = np.frombuffer(flat, dtype=np.int64).reshape(-1, 2)
    places = pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)


def labels(places: Column, spans: Column) -> Column:
    """For each token its number in the text where one of the few ``spans`` holds it, IGNORED elsewhere.

    A span that ends or begins within a token stops the query: its loss can't be told from what is beside it.
    """

    def label(o: Column, i: Column) -> Column:
        inside = F.exists(spans, lambda s: (s["start"] <= o["start"]) & (o["end"] <= s["end"]))
        meets = F.exists(spans, lambda s: (s["start"] < o["end"]) & (o["start"] < s["end"]))
        return F.when(inside, i).when(meets, F.raise_error(F.lit("a span ends within a token")).cast("int")).otherwise(F.lit(IGNORED))

    return F.transform(places, label)
