"""Rearranged texts against plain slicing of code points, and units against plain splitting."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from attestor.llm import fill_in_middle as fim
from attestor.session import table

from .rows import edges


def plain(doc_id, text: str | None) -> tuple:
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    i, j = sorted((a % (len(t) + 1), b % (len(t) + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return doc_id, len(t), "plain", None, None, sha(t), sha(t)
    form = "spm" if d % 100 < 20 else "psm"
    out = f"<S>{t[j:]}<P>{t[:i]}<M>{t[i:j]}" if form == "spm" else f"<P>{t[:i]}<S>{t[j:]}<M>{t[i:j]}"
    return doc_id, len(t), form, i, j - i, sha(out), sha(t)


MARKED = ["<P>", "a <S> b", "x<M", "<P<S", ">S><", "<" * 50, "S>" * 50, "é<é>" * 9, "\U0001f600" * 70, "ab" * 33 + "ü" * 65]


@pytest.mark.parametrize("which", ["edges", "clashing", "table", "marked"])
def test_forms(spark, which):
    docs = table(spark, "/root/testdata/sf0.001", "documents") if which == "table" else edges(spark, which == "clashing")
    if which == "marked":
        docs = spark.createDataFrame([(i, MARKED[i % len(MARKED)]) for i in range(400)], "doc_id long, text string")
    assert Counter(map(tuple, fim.report(docs).collect())) == Counter(plain(r["doc_id"], r["text"]) for r in docs.collect())


def test_empty_table(spark):
    assert fim.report(edges(spark).filter("false")).count() == 0


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_units(unit):
    rng = random.Random(3)
    for n in [*range(40), 63, 64, 65, 127, 129, 1000, 5003]:
        text = "".join(rng.choice("ab \n\té你\U0001f600") for _ in range(n))
        parts = {"char": list(text), "word": re.findall(r"^[^ \t-\r]+|[ \t-\r]+[^ \t-\r]*", text), "line": re.findall(r"[^\n]*\n|[^\n]+", text)}[unit]
        data = text.encode()
        marks = fim.starts(data, unit)
        assert marks.bit_count() == len(parts)
        at = 0
        for k, part in enumerate(parts):
            assert fim.select(marks, k, len(data)) == at
            at += len(part.encode())


def test_unknown_unit():
    with pytest.raises(ValueError, match="no such unit"):
        fim.starts(b"x", "page")


def test_bytes_that_are_no_text():
    assert fim.starts(b"\x80\x80a\xff", "char").bit_count() == 3


def test_words_may_be_units(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i))) for i in range(60)], "doc_id long, text string")
    out = fim.transformed(docs, unit="word").select("*", fim.restored(fim.F.col("output"), fim.F.col("form")).alias("back")).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out:
        assert r["back"] == texts[r["id"]] and r["n"] == r["id"]
        if r["form"] == "psm":
            assert len(r["output"].split("<S>")[0].removeprefix("<P>").split()) == r["prefix_units"]
