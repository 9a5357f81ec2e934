"""What a rule reads is made once for each row, however many words and branches look at it."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from attestor.functions import crypto as C2
from attestor.functions import rules as C
from attestor.functions import text as X
from attestor.operators import chunking as K
from attestor.operators import retrieval as V
from attestor.sources import documents, scans, tools


def made(column, call: str) -> int:
    """How often an expression computes a function."""
    return str(column).lower().count(call)


def test_rules_make_their_text_once(spark):
    assert made(C.vapt_control(F.col("a"), F.col("b"), F.col("c")), "lower(") == 1
    assert made(C.owasp_code(F.col("a"), F.col("b"), F.col("c")), "lower(") == 2


def test_contradictions_read_both_texts_once(spark):
    assert made(X.contradictions(F.col("a"), F.col("b")), "map_from_entries(") == 2
    rows = [("Logging: on", "Logging: off"), ("Logging: on", "Logging off"), (None, "Logging: off"), ("", ""), ("Logging = on", "Logging: yes")]
    got = spark.createDataFrame(rows, "a string, b string").select(X.contradictions(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [["logging"], [], [], [], []]


def test_impact_makes_its_text_once(spark):
    texts = [F.col(c) for c in "abcdefg"]
    assert made(C.impact(*texts), "lower(") == 2


def test_windows_do_not_stand_beside_each_sentence(spark):
    text = "\n\n".join(" ".join(f"Sentence {i} of block {b} has some words." for i in range(20)) for b in range(6))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "Too short.")], "id int, text string")
    w = K.windows(K.numbered(docs, ["id"], "text"), ["id"])
    assert K.entries(w, ["id"]).agg(F.count("parent")).first()[0] == w.count() > 0
    out = K.chunks(docs, ["id"], "text").collect()
    assert len(out) == len({r["content"] for r in out}) == 120 and all(r["content"] in r["parent"] for r in out)


def test_wanted_cells_are_picked_where_lines_are_cut(spark):
    text = 'A report\nNo,"Vulnerability Name",Severity,"a ""b"""\r\n1,"One, two",High," x ""y"" "\n\n2,,Low,z\n3,"two\nlines", ,""\n'
    docs = spark.createDataFrame([("f", text), ("g", "No,Other,Severity\n1,x,High"), ("h", None), ("i", "vulnerability name,Severity"), ("j", "\n\nvulnerability name , severity\n a , b \n")], "file string, content string")
    rows = scans.records(docs, lambda x: x.contains("vulnerability"), title=("title", "vulnerability name", "no"), sev=("severity",), last=('a "b"',), none=("none",))
    got = sorted((r["file"], r["at"], r["title"], r["sev"], r["last"], r["none"]) for r in rows.collect())
    assert got == [
        ("f", 2, "One, two", "High", 'x "y"', None), ("f", 3, "2", "Low", "z", None), ("f", 4, "two\nlines", None, None, None), ("j", 1, "a", "b", None, None),
    ]
    plan = tools.pentest_csv(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") == 1


def test_rules_run_where_their_anchors_stand(spark):
    assert made(C2.is_comment(F.col("a")), "lower(") + made(C2.is_comment(F.col("a")), "translate(") == 0
    # a split would compile its pattern for each line; settings make one key for all of them
    assert made(C2.accepted(F.col("a"), C2.TERMS, C2.SETTINGS), "regexp_instr(") == 1
    assert all(any(a in n.lower() for a in C2.anchors(t)) for t in C2.TERMS for n in t.names)
    lines = ["  # x", "\t// x", "REM\tx", "rem x", "remx", " <!-- x", "x # y", "", "--", "! x"]
    got = spark.createDataFrame([(x,) for x in lines], "a string").select(C2.is_comment(F.col("a"))).collect()
    assert [r[0] for r in got] == [True, True, True, True, False, True, False, False, True, True]
    marked = spark.createDataFrame([("RSA\0 rsa-2048, md5",), ("RSA rsa-2048, md5",)], "a string").select(C2.accepted(F.col("a"), C2.TERMS, C2.SETTINGS).alias("x")).collect()
    assert [[(s["start"], s["hit"]) for s in r["x"]] for r in marked] == [[(5, "rsa-2048"), (0, "RSA"), (15, "md5")], [(4, "rsa-2048"), (0, "RSA"), (14, "md5")]]


def test_files_are_read_once_for_all_kinds(spark):
    rows = [("a.csv", b'k,v\n1,"x, y"\n\n2,z\n'), ("a.csv", b'k,v\n1,"x, y"\n\n2,z\n'), ("b.csv", b"k,v"), ("c.csv", None), ("d.txt", b"one p\ntwo"), (None, b"x"), ("e.zip", b"no zip")]
    out = documents.chunks(documents.parts(spark.createDataFrame([(f, bytearray(d) if d is not None else None) for f, d in rows], "file string, data binary")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1 and "Exchange" not in plan
    table = "Headers: k  v\n1  x, y\n2  z"
    got = sorted((r["file"] or "", r["part"], r["chunk_index"], r["content"]) for r in out.collect())
    assert got == [("", "", 0, "x"), ("a.csv", "a.csv", 0, table), ("a.csv", "a.csv", 0, table), ("d.txt", "d.txt", 0, "one p\ntwo"), ("e.zip", "e.zip", 0, "no zip")]
    # zeros of bytes are looked for, not those of digits: "p" and the end of a line are 70 and 0a
    assert made(scans.decoded(F.col("a")), "contains(") == 2 and "contains(hex(" not in str(scans.decoded(F.col("a"))).lower()


def test_windows_of_rows_against_slices(spark):
    tables = {n: [f"r{i}" for i in range(n)] for n in (0, 1, 3, 4, 5, 6, 12, 13, 15, 16, 27, 28, 300)}
    rows = [(n, "h\n" + "\n".join(xs)) for n, xs in tables.items()]
    df = spark.createDataFrame(rows, "n int, text string")
    for sheet, size, step, head, sign in ((False, 15, 12, "Headers: h\n", ""), (True, 5, 4, "", "h=")):
        want = {(n, c): head + "\n".join(sign + x for x in xs[c * step : c * step + size]) for n, xs in tables.items() for c in range((len(xs) + step - 1) // step)}
        assert {(r["n"], r["chunk_index"]): r["content"] for r in documents.row_chunks(df, ["n"], "text", sheet).collect()} == want


def test_words_are_counted_as_tokens_are(spark):
    texts = ["The the THE that-thing that_thing ab abc a-b", None, "", "İstanbul theéthe straße the", "the\nthat\tthing;policy,policy", "x " * 50 + "the", "漢the字", "K12 Kelvin"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    names = ["the", "that", "policy"]
    held = docs.select("id", X.tokens(F.col("text")).alias("w")).collect()
    low = F.lower(F.coalesce("text", F.lit("")))
    got = {r["id"]: r["n"] for r in docs.select("id", V._counted(names)(low).alias("n")).collect()}
    assert got == {r["id"]: [len(r["w"]), *[r["w"].count(n) for n in names]] for r in held}
    seen = {r["t"]: r["df"] for r in docs.select(low.alias("t")).mapInPandas(V._vocabulary, "t string, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()}
    assert seen == Counter(w for r in held for w in set(r["w"]))
    # texts go to a task in batches, and no row of its own is made for a word of a text
    plan = V.bm25(docs, {"the": 1.0}, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "Generate" not in plan and "split(" not in plan


def test_vocabulary_hands_on_what_it_cannot_hold(monkeypatch):
    monkeypatch.setattr(V, "HELD", 3)
    out = pd.concat(V._vocabulary(iter([pd.DataFrame({"t": ["one two", "one two six ten", ""]}), pd.DataFrame({"t": ["one one six"]})])))
    assert out.groupby("t")["df"].sum().to_dict() == {"one": 3, "two": 2, "six": 2, "ten": 1} and len(out) > 4
    assert len(pd.concat(V._vocabulary(iter([])))) == 0
