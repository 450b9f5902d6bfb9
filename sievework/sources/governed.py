"""Reads that a manifest governs: training splits, gates for evaluation alone, policy corpora."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.sources.readers import file_digests, json_lines

# What a manifest for evaluation alone says, and the use that a shadow gate allows.
EVALUATION_CONTRACT = "banking-counterfactual-eval-manifest/v1"
SHADOW_GATE, SHADOW_USE = "coreference-shadow", ["post-selection-evaluation-once"]


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A manifest as a mapping; one file of a few kilobytes."""
    found = spark.read.option("wholetext", True).text(path).first()
    made = json.loads(found["value"]) if found else None
    if not isinstance(made, dict):
        raise ValueError(f"not a manifest object: {path}")
    return made


def _within(root: str, path: str) -> str:
    if path.startswith("/") or ".." in path.split("/") or "://" in path:
        raise ValueError(f"not a relative path: {path}")
    return f"{root.rstrip('/')}/{path}"


def split_paths(manifest: dict, split: str) -> list[str]:
    """Paths of a split: its entry in ``splits``, else all included entries of that name in ``tool_sft``."""
    splits = manifest.get("splits") or {}
    if split in splits:
        entry = splits[split]
        return [entry["path"] if isinstance(entry, dict) else entry]
    if "tool_sft" in manifest:
        return [e["path"] for e in manifest["tool_sft"] if e.get("name") == split and e.get("included", True)]
    raise ValueError(f"the manifest declares no split {split!r}")


def _all(spark: SparkSession, root: str, paths: Iterable[str], schema: str | T.StructType) -> DataFrame:
    found = [_within(root, p) for p in paths]
    if not found:
        raise ValueError("the split lists no file")
    return json_lines(spark, found, schema)


def training_rows(spark: SparkSession, root: str, manifest: str, split: str, schema: str | T.StructType, trainable: str = "trainable") -> DataFrame:
    """Rows of a split that may be trained on.

    Refused are manifests for evaluation alone, empty splits, and splits with any row whose
    ``trainable`` is false; a null there is no objection.
    """
    said = read_manifest(spark, manifest)
    if said.get("training_allowed") is False or said.get("contract") == EVALUATION_CONTRACT:
        raise ValueError("the manifest is for evaluation alone")
    rows = _all(spark, root, split_paths(said, split), schema)
    if not rows.limit(1).count():
        raise ValueError(f"split {split!r} is empty")
    if rows.where(~F.col(trainable)).limit(1).count():
        raise ValueError(f"split {split!r} has rows for evaluation alone")
    return rows


def with_shadow_gate(spark: SparkSession, root: str, manifest: str, test: DataFrame, schema: str | T.StructType, gate: str = SHADOW_GATE, trainable: str = "trainable") -> DataFrame:
    """``test`` and the rows of the manifest's one shadow gate.

    There must be exactly one gate of the name, not trainable, for its one use, with the
    digest and number of rows that the manifest states, and none of its rows trainable.
    """
    entries = [e for e in read_manifest(spark, manifest).get("behavioral_gates", []) if isinstance(e, dict) and e.get("name") == gate]
    if len(entries) != 1:
        raise ValueError(f"the manifest must have one gate {gate!r}")
    entry = entries[0]
    if entry.get("trainable") is not False or entry.get("allowed_use") != SHADOW_USE:
        raise ValueError("the gate's use policy is not valid")
    at = _within(root, entry["path"])
    found = file_digests(spark, at).first()
    rows = json_lines(spark, at, schema)
    if found is None or found["sha256"] != entry["sha256"].removeprefix("sha256:") or rows.count() != int(entry["record_count"]):
        raise ValueError("the gate differs from its manifest")
    if rows.where(F.coalesce(F.col(trainable), F.lit(True))).limit(1).count():
        raise ValueError("the gate's rows must not be trainable")
    return test.unionByName(rows)


def policy_corpus(spark: SparkSession, path: str, schema: str = "chunk_id string, title string, text string, effective_from string, effective_to string") -> DataFrame:
    """Passages of one JSON corpus ``{schema_version, corpus_revision, chunks}``, with its revision.

    The revision must be the digest of the canonical JSON of version and chunks, and
    chunk ids must be unique. A corpus of policies is one file that a person maintains.
    """
    import hashlib

    said = read_manifest(spark, path)
    if set(said) != {"schema_version", "corpus_revision", "chunks"} or said["schema_version"] != 1 or not isinstance(said["chunks"], list) or not said["chunks"]:
        raise ValueError("a policy corpus has schema_version 1, corpus_revision and chunks")
    bare = [{k: v for k, v in c.items() if k != "corpus_revision"} for c in said["chunks"]]
    canonical = json.dumps({"schema_version": 1, "chunks": bare}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    if said["corpus_revision"] != f"sha256:{hashlib.sha256(canonical.encode()).hexdigest()}":
        raise ValueError("the corpus differs from its revision")
    if len({c["chunk_id"] for c in bare}) != len(bare):
        raise ValueError("chunk ids must be unique")
    rows = spark.read.option("multiLine", True).schema(f"corpus_revision string, chunks array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>").json(path)
    return rows.select("corpus_revision", F.inline("chunks"))
