"""Scenarios from templates against Python."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sievework.operators import expand as X

TEMPLATES = [("freeze", 0, "Freeze {card} of {who}"), ("ask", 1, "{who}: {who} {nobody} {}{")]
LISTS = {"cards": ["Gold {who}", "Blue"], "names": ["Ann", "Bob", "Cy"], "none": []}
SLOTS = {"card": ("cards", 1, 0), "who": ("names", 7, 2), "empty": ("none", 1, 0)}


def expected(count):
    out = []
    for i in range(count):
        name, _, text = TEMPLATES[i % 2]
        occurrence = i // 2
        state, realization = divmod(occurrence, 3)
        seed = int(hashlib.sha256(f"{name}:{state}".encode()).hexdigest()[:12], 16)
        who, card = LISTS["names"][(seed // 7 + 2) % 3], LISTS["cards"][seed % 2]
        shown = f"Freeze {card} of {who}" if name == "freeze" else f"{who}: {who} {{nobody}} {{}}{{"
        scenario = name if occurrence == 0 else f"{name}_state_{state:04d}_realization_{realization}"
        out.append((scenario, name, state, realization, f"{name}_state_{state:04d}", seed, shown))
    return sorted(out)


def frames(spark):
    lists = spark.createDataFrame([tuple(LISTS.values())], ", ".join(f"{k} array<string>" for k in LISTS))
    return spark.createDataFrame(TEMPLATES, "template_id string, ordinal int, text string"), lists


def test_scenarios_like_python(spark):
    templates, lists = frames(spark)
    for count in (0, 1, 23):
        assert sorted(tuple(r) for r in X.scenarios(templates, count, SLOTS, lists, ("text",)).collect()) == expected(count)
    assert X.scenarios(templates.limit(0), 5, SLOTS, lists, ("text",)).collect() == []


def test_pairs(spark):
    templates, lists = frames(spark)
    made = X.scenarios(templates, 10, SLOTS, lists, ("text",)).withColumns({"yes": F.lit("there"), "no": F.lit(None).cast("string")})
    rows = X.counterfactual_pairs(made, "yes", "no").collect()
    assert len(rows) == 20 and len({r.pair_id for r in rows}) == 10
    assert {(r.variant, r.evidence) for r in rows} == {("a", "there"), ("b", None)}
