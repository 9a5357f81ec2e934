"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy node arrays.

Statistics are taken from whole texts in one pass and written; a sample of at most `SAMPLE` labelled rows (the least hashes
of id and statistics, equal rows once) trains the trees. Some features have a monotonic constraint: more repetition or more symbols never raises the score.
Every tree is complete, so a model is three arrays (feature, threshold, leaf) and scoring is `DEPTH` vectorised steps.

Null and empty texts have no words, fail the base rule and aren't kept. Without labelled rows the trees say 1.0 and the
base rule alone decides. Very long texts are described whole. A score of exactly 0.5 keeps a document, and values equal to
a threshold go left. Null ids are never in the sample; of several labels of one id the least counts; repeated rows are each
returned, alike; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ship, written
from .toxicity import FOLDS, least_hashes

SAMPLE, ROUNDS, DEPTH, RATE, BINS, LEAST_LEAF = 20_000, 60, 3, 0.15, 32, 1.0
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_stops"]
#: Features and their constraints: -1 falls, +1 rises, 0 is free.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeated": -1, "line_words": 0, "distinct": 0, "upper": 0, "digits": 0, "stops": 0}
_BLANK_LINE = re.compile(f"[{BLANKS}]*")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = (key ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(words) + 1, np.int64)
    # equal keys are compared by their words; unequal windows never share a verdict
    runs = np.split(order, np.flatnonzero(~same) + 1)
    for run in (r for r in runs if len(r) > 1):
        groups: dict[tuple, list[int]] = {}
        for i in run.tolist():
            groups.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
        for at in groups.values():
            if len(at) > 1:
                np.add.at(covered, at, 1)
                np.add.at(covered, np.array(at) + WINDOW, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def statistics(text: str) -> list[int]:
    """The numbers named in STATS."""
    words = text.encode().split()  # on bytes, only the six ASCII blanks separate words
    lines = [x for x in text.split("\n") if not _BLANK_LINE.fullmatch(x)]
    blanks = sum(map(text.count, BLANKS))
    data = np.frombuffer(text.encode(), np.uint8)
    upper, digits = int(((data > 64) & (data < 91)).sum()), int(((data > 47) & (data < 58)).sum())
    return [
        len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(set(words)), upper, digits, sum(len(w) < 4 for w in words),
    ]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the statistics as longs) for every row."""
    bound_batches(docs.sparkSession)
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t or "") for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in rows.T]], names=[id_col, *STATS])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(of, f"`{id_col}` {kind}, " + ", ".join(f"{s} long" for s in STATS))


def matrix(p: pd.DataFrame) -> np.ndarray:
    """The features of rows of statistics."""
    s = {k: p[k].to_numpy(np.float64) for k in STATS}
    words, lines, chars = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1), np.maximum(s["word_chars"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        words / lines, s["n_distinct"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_stops"] / words,
    ])


@dataclass
class Trees:
    """Complete trees of DEPTH levels: node i of a tree has the children 2i+1 and 2i+2, the leaves come last."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[tree, node - (2**DEPTH - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-np.logaddexp(0, -self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int]) -> Trees:
    """Newton boosting of the logistic loss on quantile bins. A split on a constrained feature needs leaf values in the
    right order, and their middle bounds all values below it, so the whole tree is monotonic."""
    share = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    inner, n = 2**DEPTH - 1, ROUNDS
    trees = Trees(np.zeros((n, inner), np.int64), np.full((n, inner), np.inf), np.zeros((n, inner + 1)), base)
    margin = np.full(len(y), base)
    for t in range(n):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        value = lambda gs, hs, b: float(np.clip(gs / (hs + LEAST_LEAF), *b))
        for i in range(inner):
            at, b = np.flatnonzero(node == i), bounds[i]
            gain = lambda gs, hs: gs * gs / (hs + LEAST_LEAF)
            best, choice = 1e-6, None
            for f, e in enumerate(edges):
                if not len(e) or len(at) < 2:
                    continue
                gl = np.cumsum(np.bincount(bins[at, f], g[at], len(e) + 1))
                hl = np.cumsum(np.bincount(bins[at, f], h[at], len(e) + 1))
                gr, hr = gl[-1] - gl, hl[-1] - hl
                gains = gain(gl, hl) + gain(gr, hr) - gain(gl[-1], hl[-1])
                gains[(hl < LEAST_LEAF) | (hr < LEAST_LEAF)] = 0
                left, right = np.clip(gl / (hl + LEAST_LEAF), *b), np.clip(gr / (hr + LEAST_LEAF), *b)
                gains[signs[f] * (right - left) < 0] = 0
                k = int(np.argmax(gains[:-1]))
                if gains[k] > best:
                    best, choice = gains[k], (f, k, left[k], right[k])
            left_b = right_b = b
            if choice:
                f, k, left, right = choice
                trees.feature[t, i], trees.threshold[t, i] = f, edges[f][k]
                node[at] = 2 * i + 1 + (bins[at, f] > k)
                if signs[f]:
                    mid = (left + right) / 2
                    left_b, right_b = ((b[0], mid), (mid, b[1])) if signs[f] > 0 else ((mid, b[1]), (b[0], mid))
            else:
                node[at] = 2 * i + 1  # an endless threshold: all go left
            bounds[2 * i + 1], bounds[2 * i + 2] = left_b, right_b
        for i in range(inner, 2 * inner + 1):
            at = node == i
            trees.leaf[t, i - inner] = RATE * value(g[at].sum(), h[at].sum(), bounds[i]) if at.any() else 0.0
        margin += trees.leaf[t, node - inner]
    return trees


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Trees | None:
    """Trees from a sample of labelled rows, none of the held-out fold."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    marks = labels.filter("quality IS NOT NULL").filter(fold != 0).groupBy(id_col).agg(F.min("quality").alias("_quality"))
    labelled = written(stats.join(marks, id_col).select(F.xxhash64(F.col(id_col), *STATS, F.lit("quality")).alias("h"), *STATS, "_quality"), "quality-rows")
    chosen = written(least_hashes(labelled, SAMPLE), "quality-chosen")
    rows = labelled.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"]).select(*STATS, "_quality").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(list(rows.columns))  # rows come in any order; sums must not depend on it
    return fit(matrix(rows), (rows["_quality"] > 0).to_numpy(float), list(FEATURES.values()))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics, base_failed, score, kept)."""
    stats = written(described(docs, id_col, text_col), "statistics")
    trees = train(stats, labels, id_col)

    @F.pandas_udf("double")
    def score(p: pd.DataFrame) -> pd.Series:
        return pd.Series(trees.score(matrix(p)) if len(p) else np.empty(0))

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = stats.withColumn("base_failed", failed)
    rows = rows.withColumn("score", score(F.struct(*STATS)) if trees else F.lit(1.0))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0.5))


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return judged(docs, labels, id_col, text_col).select(id_col, *STATS[:5], "base_failed", "kept", F.round("score", 6).alias("score"))
