"""Broken answers and completed quotes."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestor import catalog
from attestor.operators import repair
from attestor.plans import repairs
from attestor.session import table

SF = "/root/testdata/sf0.001"


def test_well_formed_is_read_as_it_is():
    rng = random.Random(13)

    def value(depth: int):
        kind = rng.randrange(6 if depth else 4)
        if kind == 0:
            return "".join(rng.choice('ab ,:{}[]"\\\n\té\U0001f600') for _ in range(rng.randrange(8)))
        if kind < 4:
            return rng.choice([None, True, False, 0, -3, 2.5, 1e9])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 4 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}

    plain = 0
    for _ in range(600):
        v = {f"k{i}": value(3) for i in range(rng.randrange(4))}
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        plain += '\\"' not in text
        assert repair.loose("x " + text + " y") == v
    assert plain > 100


@pytest.mark.parametrize(("text", "found"), [
    ('{"a": "x "y" z", "b": 1}', {"a": 'x "y" z', "b": 1}), ('{"a": "C:\\Program Files\\d"}', {"a": "C:\\Program Files\\d"}), ('{"a": "line\nbreak"}', {"a": "line\nbreak"}), ('{"a": 1, "b": {"c": 2}, "d": "cu', {"a": 1, "b": {"c": 2}}),
    ('{"a": {"b": 1, "c": "cut', {"a": {"b": 1}}), ('{"a": [1, 2, {"b": 3}, {"c": "x', {"a": [1, 2, {"b": 3}]}), ('{"a": 1,, "b": 2,}', {"a": 1, "b": 2}), ("nothing", None), (None, None), ("{", {}), ('{"a" 1}', {}), ('{"a": "one, "two", three"}', {"a": 'one, "two", three'}),
])
def test_broken(text, found):
    assert repair.loose(text) == found


def test_advice(spark):
    rows = spark.createDataFrame(list(enumerate(repairs.ANSWERS)), "n int, raw string").select("n", repair.advice(F.col("raw")).alias("a")).collect()
    got = {r["n"]: tuple(sorted((k, v["remediation"], v["actionable"]) for k, v in (r["a"] or {}).items())) for r in rows}
    assert got == {i: tuple(sorted(x)) for i, x in enumerate(repairs._READ)}
    query = catalog.queries()["hlp27_salvaged_json"](spark, SF).collect()
    keys = [r["o_orderkey"] for r in table(spark, SF, "orders").collect()]
    assert Counter((r["o_orderkey"], r["nth"], r["remediation"], r["actionable"]) for r in query) == Counter((k, *x) for k in keys for x in repairs._READ[k % len(repairs.ANSWERS)])


TEXT = "Intro here.\n\nThe  Clock is\nsynchronised “daily”, i.e. each night at 3.5 past. Then it rests!\n\nNo end to this paragraph\n\nlast words"


@pytest.mark.parametrize(("quote", "found"), [
    ('the clock IS synchronised "daily"', "The  Clock is\nsynchronised “daily”, i.e. each night at 3.5 past."), ("THEN IT RESTS", "Then it rests!"), ("then it rests!", "Then it rests!"), ("no end to", "No end to this paragraph"),
    ("last words", "last words"), ("clock", "clock"), ("not in the text", "not in the text"), (" padded but absent ", "padded but absent"), (None, None), ("", ""),
])
def test_completed(quote, found):
    assert repair.completed(quote, TEXT) == found


def test_completed_is_cut():
    text = "start of it " + "word " * 300
    assert len(repair.completed("start of it", text, 50)) <= 11 + 50
    assert repair.completed("a quote of it", None) == "a quote of it"


def test_places_lead_back():
    rng = random.Random(14)
    for _ in range(500):
        text = "".join(rng.choice("aB \n\t“’éİß") for _ in range(rng.randrange(30)))
        normal, places = repair.normal_places(text)
        assert len(normal) == len(places) and places == sorted(places) and "  " not in normal and normal == normal.strip(" ")
        for c, i in zip(normal, places, strict=True):
            assert c == " " and text[i].isspace() or c in repair._PLAIN.get(text[i], text[i]).lower()


def test_quotes_of_documents(spark):
    t = lambda n: table(spark, SF, n)
    rows = {r["doc_id"]: r for r in repairs.quotes(t).collect()}
    got = {r["doc_id"]: r["completed"] for r in catalog.queries()["hlp34_completed_quotes"](spark, SF).collect()}
    assert got.keys() == rows.keys()
    for i, r in rows.items():
        if r["quote"] and len(r["quote"]) >= 8:
            assert got[i] in r["text"] and repair.normal_places(got[i])[0].startswith(repair.normal_places(r["quote"])[0].rstrip("\"' "))
