"""Whole quotes against documents."""

from __future__ import annotations

from collections import Counter

from attestor.operators import retrieval

HEAD = "the quick brown fox jumps over the lazy dog near the old river bank"
QUOTE = HEAD + " and was approved on the first of may"
DOCS = [
    (1, f"Before. {QUOTE.upper()}\n after"), (2, HEAD + " and was rejected on the first of june"), (3, f"x{QUOTE}y"), (4, QUOTE.replace(" and", "; and")),
    (5, "first part has one two three four five six\n filler \nsecond part has seven eight nine ten eleven"), (6, "first part has one two three four five six"),
    (7, "kurz 你好世界"), (7, QUOTE), (None, QUOTE), (None, None),
]
QUOTES = [
    (10, QUOTE), (11, f' "{HEAD}\nand was approved on the first of may"\n'), (12, "second part has seven eight nine ten eleven\n\nfirst part has one two three four five six"),
    (13, "kurz"), (14, "好世"), (15, "NOT_FOUND"), (16, ""), (17, None), (18, QUOTE + "\n\nNOT_FOUND"), (10, QUOTE),
]


def test_whole_quotes(spark):
    docs, quotes = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(QUOTES, "item_id long, text string")
    got = Counter(map(tuple, retrieval.grounded(docs, quotes, "doc_id", "item_id", "text").collect()))
    holders = [1, 3, 4, 7, None]
    assert got == Counter({(10, d): 2 for d in holders} | {(11, d): 1 for d in holders} | {(12, 5): 1, (13, 7): 1, (14, 7): 1})


def test_status_of_quotes(spark):
    """Whole, in part, or not at all; rows of one item are judged each."""
    docs = spark.createDataFrame([*DOCS, (8, QUOTE + " and more")], "doc_id long, text string")
    quotes = spark.createDataFrame([*QUOTES, (20, QUOTE + "\n\nnever written anywhere at all")], "item_id long, text string")
    got = Counter(map(tuple, retrieval.best_grounding(docs, quotes, "doc_id", "item_id", "text").collect()))
    whole, part = {(10, "GROUNDED"): 2, (11, "GROUNDED"): 1, (12, "GROUNDED"): 1, (13, "GROUNDED"): 1, (14, "GROUNDED"): 1}, {(18, "PARTIALLY_GROUNDED"): 1, (20, "PARTIALLY_GROUNDED"): 1}
    assert got == Counter(whole | part | {(i, "NOT_GROUNDED"): 1 for i in (15, 16, 17)})


def test_claims(spark):
    """A claim without any three words in a row of its document is flagged; what says that something is absent isn't a claim."""
    text = "The policy states that all users rotate keys. It mentions purple elephants dancing around here! No evidence contains anything of it. Short states."
    rows = spark.createDataFrame([(1, text), (2, text), (3, None)], "k long, text string")
    docs = spark.createDataFrame([(1, "We know that all users rotate keys every month."), (2, "The policy states that all. Mentions purple elephants dancing."), (3, "x")], "k long, text string")
    got = sorted((r["k"], r["sentence"]) for r in retrieval.unsupported(rows, docs, "k", "text").collect())
    assert got == [(1, "It mentions purple elephants dancing around here!")]
