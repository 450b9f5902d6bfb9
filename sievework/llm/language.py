"""Language identification by compression (operator 5).

Each language has a zstandard raw-content dictionary of its own text. A text is cut into
blocks, each block is compressed with every dictionary, and the language whose total is
smallest wins. The relative gap to the second is the margin; narrow margins are rejected.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Labelled rows per language that a dictionary is made of, at most; bytes of a dictionary
#: and of a piece of text in it. These bound the fit alone: texts are judged whole.
ROWS, DICT_BYTES, PIECE = 64, 1 << 15, 1 << 10
BLOCK = 2048
#: Below this margin a prediction is rejected. On held-out rows (sf0.1) it rejects 0.4 % of
#: languages that were learned and 86 to 95 % of one that was left out of the fit.
MIN_MARGIN = 0.02
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")
#: Ends every dictionary and begins every block: zstandard stores a block that gains too
#: little as it is, and would tell nothing about short texts; this gain is alike for all.
_LEAD = bytes(range(33, 65)) * 2


def normal(text: str | None) -> bytes:
    return " ".join(_WORDS.findall((text or "").lower())).encode("utf-8", "replace")


def _compressor(content: bytes, fine: bool = False) -> zstandard.ZstdCompressor:
    """``fine`` finds shorter matches, at more cost."""
    params = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=15, hash_log=15, search_log=4, min_match=3 if fine else 4, target_length=64, strategy=zstandard.STRATEGY_BTULTRA if fine else zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    made = zstandard.ZstdCompressionDict(content + _LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=made)


class Classifier:
    """Holds one compressor per language; made once per task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.models = [(k, _compressor(dictionaries[k])) for k in sorted(dictionaries)]
        self.fine = [(k, _compressor(dictionaries[k], True)) for k in sorted(dictionaries)]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, margin. No letter or no model: ``und``, 0, 0.

        Texts that tie, such as those of a few short words, are told by their distinct
        words, each compressed on its own with shorter matches.
        """
        body = normal(text)
        if not body or not self.models or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        blocks = [_LEAD + b" " + body[i : i + BLOCK] for i in range(0, len(body), BLOCK)]
        sizes = self._sizes(self.models, blocks)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        if sizes[0][0] == sizes[1][0]:
            sizes = self._sizes(self.fine, [_LEAD + b" " + w + b" " for w in dict.fromkeys(body.split())])
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], 1.0 / (1.0 + math.exp(-40.0 * margin)), margin

    @staticmethod
    def _sizes(models: list, blocks: list[bytes]) -> list[tuple[int, str]]:
        return sorted((sum(len(c.compress(b)) for b in blocks), k) for k, c in models)


def held_out(id_col: Column) -> Column:
    """Rows that no fit may see: crc32 of the id's digits leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", rows: int = ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary for every label, from at most ``rows`` distinct labelled rows of each.

    The rows are those of a label with the smallest hashes; nulls, rows held out and
    labels ``und`` don't count, and rows that repeat count once. Whole texts are cut into
    pieces, and the pieces with the smallest hashes fill the dictionary, so that any part
    of a long text may be in it. ``dict_bytes`` (and a piece at most) a label reach the
    driver, however many rows there are. No usable row gives no dictionary.
    """
    usable = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & (F.col(label) != UNKNOWN))
    hashed = usable.select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(id_col, text).alias("h"))
    first = Window.partitionBy("label").orderBy("h")
    # The first of each of 64 parts, then of the label: a label of a third of all rows stays spread.
    parts = hashed.select("label", "h", F.pmod("h", F.lit(64)).alias("part")).distinct()
    spread = parts.withColumn("n", F.row_number().over(Window.partitionBy("label", "part").orderBy("h"))).where(F.col("n") <= rows)
    chosen = spread.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows).select("label", "h")
    sample = hashed.join(F.broadcast(chosen), ["label", "h"], "left_semi").dropDuplicates(["label", "h"]).select("label", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, whole in zip(batch.column(0), batch.column(1), strict=True):
                body = normal(whole.as_py())
                pieces = [body[i : i + PIECE] for i in range(0, len(body), PIECE)]
                columns = [pa.array([name.as_py()] * len(pieces), pa.string()), pa.array(pieces, pa.binary()), pa.array([hashlib.md5(x).digest() for x in pieces], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "piece", "h"])

    pieces = sample.mapInArrow(cut, "label string, piece binary, h binary").dropDuplicates(["label", "h"])
    so_far = F.sum(F.length("piece") + 1).over(first.rowsBetween(Window.unboundedPreceding, -1))
    kept = pieces.withColumn("so_far", F.coalesce(so_far, F.lit(0))).where(F.col("so_far") < dict_bytes)
    made: dict[str, bytearray] = {}
    for r in kept.select("label", "h", "piece").orderBy("label", "h").collect():  # at most dict_bytes and a piece a label
        made.setdefault(r["label"], bytearray()).extend(b" " + bytes(r["piece"]))
    return {k: bytes(v) for k, v in made.items() if v.strip()}


def predictions(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out`` of ``lang_pred``, ``score`` and ``margin``.

    Each row is judged by its whole text alone, without a shuffle. A null text and one
    without a letter give ``und``, 0 and 0; repeated rows are judged alike; a column named
    ``out`` is replaced.
    """
    made = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])

    @F.pandas_udf(made)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(dictionaries)
        for batch in batches:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang_pred", "score", "margin"])

    return docs.withColumn(out, of(F.col(text)))


def is_accepted(found: Column, min_margin: float = MIN_MARGIN) -> Column:
    return (found["lang_pred"] != UNKNOWN) & (found["margin"] >= min_margin)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``margin`` and ``accepted``.

    ``accepted`` is false for ``und`` (a null text, or no letter in it) and for margins
    below ``min_margin``. Columns with the new names are replaced; no rows give no rows.
    """
    whole = docs.drop("lang_pred", "score", "margin", "accepted")
    found = F.col("__language")
    return predictions(whole, dictionaries, text, "__language").select(*whole.columns, "__language.*", is_accepted(found, min_margin).alias("accepted"))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is told by the margin, all columns as they were.

    Null texts and those without a letter go.
    """
    return predictions(docs, dictionaries, text, "__language").where(is_accepted(F.col("__language"), min_margin)).select(*docs.columns)
