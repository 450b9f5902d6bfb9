"""Rewriting of records by a teacher: a backend per partition, retries, and checks of every response.

A backend turns request rows into response rows; it may be a model that a task loads once.
Responses are judged by column rules: a response must carry its request's id and digest,
keep its facts, and ask for or hold nothing private.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.sources.appends import append_once, appended

FIELDS = ("record_id", "immutable_hash", "user_content", "final_response")
RESPONSE = "record_id string, immutable_hash string, user_content string, final_response string"
# How a dry run opens its texts, and the openings that it leaves as they are.
ASKING = ("Please", "Can you", "Could you")
ASKED = ("please", "can you", "could you")
ANSWERED = ("done.", "i checked", "here is")
CHECKED = "I checked the banking result. "
#: Values that a response must not hold.
PRIVATE_VALUES = ("email", "ssn")


class Backend(Protocol):
    def realize(self, rows: Sequence[dict[str, str]]) -> list[dict[str, str]]:
        """One response for each request, in their order."""


class DryRun:
    """A backend without a model: opens texts in one of three ways, chosen by the hash of the seed and the record."""

    def __init__(self, seed: int = 7303):
        self.seed = seed

    def realize(self, rows: Sequence[dict[str, str]]) -> list[dict[str, str]]:
        return [self._one(r) for r in rows]

    def _one(self, row: dict[str, str]) -> dict[str, str]:
        user, final = row["user_content"].strip(), row["final_response"].strip()
        if not user.lower().startswith(ASKED):
            chosen = int(hashlib.md5(f"{self.seed}:{row['record_id']}".encode()).hexdigest()[:8], 16) % len(ASKING)
            user = f"{ASKING[chosen]} {user[:1].lower()}{user[1:]}"
        if not final.lower().startswith(ANSWERED):
            final = CHECKED + final
        return {**row, "user_content": user, "final_response": final}


def request_errors() -> Column:
    """What is wrong with a request: blank fields, a digest that is none, other edits allowed than the two."""
    rules = {f"blank_{c}": F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in FIELDS if c != "immutable_hash"}
    rules["bad_immutable_hash"] = ~F.coalesce(F.col("immutable_hash").rlike(r"\Asha256:[0-9a-f]{64}\z"), F.lit(False))
    rules["other_edits"] = ~F.coalesce(F.col("allowed_edits") == F.array(F.lit("user_content"), F.lit("final_response")), F.lit(False))
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))


def response_errors(asked: str = "asked", given: str = "given") -> Column:
    """All that is wrong with a response struct beside its request struct, in a fixed order."""
    a, g = F.col(asked), F.col(given)
    text = {c: X.one_line(F.coalesce(g[c], F.lit(""))) for c in ("user_content", "final_response")}
    rules = {
        "no_response": g.isNull(),
        "other_record": g["record_id"] != a["record_id"],
        "other_hash": ~(g["immutable_hash"].eqNullSafe(a["immutable_hash"])),
        **{f"blank_{c}": t == "" for c, t in text.items()},
        **{f"lost_facts_{c}": (t != "") & (F.size(X.lost_facts(a[c], t)) > 0) for c, t in text.items()},
        "asks_for_private_data": X.requests_private_data(text["final_response"]),
        "private_value": F.lit(False),
    }
    for t in text.values():
        for flag in X.pii_flags(t, PRIVATE_VALUES).values():
            rules["private_value"] |= flag
    absent = g.isNull()
    return F.array_compact(F.array(*(F.when(c if k == "no_response" else ~absent & c, F.lit(k)) for k, c in rules.items())))


def realize(requests: DataFrame, backend: Callable[[], Backend], batch_size: int = 64, retries: int = 2) -> DataFrame:
    """Each request's response as structs ``asked`` and ``given`` with a ``failure``.

    ``backend`` is called once in a task, where its first rows come. A batch that raises or
    has another number of rows is tried again, then row by row, so that one bad row costs
    no other; a row that fails alone has a null ``given`` and the error's text.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: list[Backend] = []

        def attempt(rows: list[dict]) -> tuple[list[dict] | None, str]:
            failure = ""
            for _ in range(retries + 1):
                try:
                    if not model:
                        model.append(backend())
                    made = model[0].realize(rows)
                    if len(made) == len(rows):
                        return made, ""
                    failure = f"{len(made)} responses to {len(rows)} requests"
                except Exception as e:  # noqa: BLE001  whatever a backend raises is its row's failure
                    failure = f"{type(e).__name__}: {e}"
            return None, failure

        for batch in batches:
            rows = batch.to_dict("records")
            for at in range(0, len(rows), batch_size):
                some = rows[at : at + batch_size]
                made, failure = attempt(some)
                parts = [(some, made, failure)] if made is not None or len(some) == 1 else [([r], *attempt([r])) for r in some]
                for asked, given, why in parts:
                    found = given or [None] * len(asked)
                    yield pd.DataFrame([{**{c: r[c] for c in FIELDS}, **{f"given_{c}": None if g is None else g.get(c) for c in FIELDS}, "failure": why or None} for r, g in zip(asked, found, strict=True)])

    kinds = f"{RESPONSE}, {', '.join(f'given_{c} string' for c in FIELDS)}, failure string"
    flat = requests.select(*FIELDS).mapInPandas(ask, kinds)
    given = F.struct(*(F.col(f"given_{c}").alias(c) for c in FIELDS))
    return flat.select(F.struct(*FIELDS).alias("asked"), F.when(F.col("failure").isNull(), given).alias("given"), "failure")


def judged(realized: DataFrame) -> DataFrame:
    """Responses as rows of FIELDS with their ``errors`` and ``failure``; texts of good ones on one line."""
    g = F.col("given")
    found = realized.withColumn("errors", response_errors())
    return found.select(F.col("asked.record_id").alias("record_id"), F.col("asked.immutable_hash").alias("immutable_hash"), X.one_line(g["user_content"]).alias("user_content"), X.one_line(g["final_response"]).alias("final_response"), "errors", "failure")


def realize_pending(requests: DataFrame, path: str, batch: int, backend: Callable[[], Backend], **options) -> dict[str, int]:
    """Realize the requests that ``path`` has no response for and append the good ones: how many of each.

    A request that is wrong stops all with ValueError, as does a response that was stored for
    another digest. Responses that are wrong aren't stored, and are asked for again next time.
    """
    spark = requests.sparkSession
    bad = requests.withColumn("errors", request_errors()).where(F.size("errors") > 0).select("record_id", "errors").first()
    if bad is not None:
        raise ValueError(f"request {bad['record_id']}: {', '.join(bad['errors'])}")
    done = appended(spark, path, RESPONSE, before=batch)
    stale = requests.alias("r").join(done.alias("d"), "record_id").where("r.immutable_hash <> d.immutable_hash").first()
    if stale is not None:
        raise ValueError(f"response {stale['record_id']} belongs to another request")
    open_rows = requests.join(done.select("record_id"), "record_id", "left_anti")
    good = judged(realize(open_rows, backend, **options)).where((F.size("errors") == 0) & F.col("failure").isNull()).select(*FIELDS)
    return {"requests": requests.count(), "already": requests.join(done.select("record_id"), "record_id", "left_semi").count(), "written": append_once(good, path, "record_id", batch)}
