"""Toxicity by non-negative positive-unlabelled learning (a linear model in numpy).

Confirmed toxic documents are the positives; all other text is unlabelled. With the class prior pi (the share of toxic
documents among the labelled ones of the training folds) the risk is

    pi * E_p[loss(g, +1)] + max(0, E_u[loss(g, -1)] - pi * E_p[loss(g, -1)])

and where the second part falls below zero, the step goes against it, so that the model can't fit it away.

Features are words and word beginnings of 4 and 5 letters: whether a text has one, and whether it has one in each
`DENSITIES` words at least. They are chosen by how much more often they occur in positives. Positives and unlabelled text
are samples of at most `POSITIVES` and `UNLABELLED` rows: those with the least hashes of id and text among all rows, equal
rows counting once, so the samples cover the whole table at every size, with null and repeated ids. Scoring reads every
whole text, however long.

Null and empty texts get the score of a text without features; without any positive all scores are 0. Null ids count as
not held out. Several labels of one id count as toxic if one of them says so. A score of exactly 0.5 counts as toxic.
Repeated rows are each scored, alike. An empty table gives no rows. Extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ship, written

#: Bounds of the training samples and of the vocabulary.
POSITIVES, UNLABELLED, VOCABULARY = 4000, 12000, 3000
#: Standard errors by which a feature must be more frequent in positives.
SURE = 2.0
#: A mark is added to a feature for each of these: so many words for each occurrence at most.
DENSITIES = (150, 40)
BEGINNINGS = (4, 5)
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(text: str | None) -> set[str]:
    """Words, and beginnings of words marked by a tilde; with @ for each density that they reach."""
    counts = Counter(_WORD.findall((text or "").lower()))
    total, found = sum(counts.values()), Counter(counts)
    for w, k in counts.items():
        for n in BEGINNINGS:
            if len(w) > n:
                found[f"{w[:n]}~"] += k
    out = set(found)
    for i, d in enumerate(DENSITIES, 1):
        out |= {f + "@" * i for f, k in found.items() if k * d >= total}
    return out


def least_hashes(rows: DataFrame, n: int) -> DataFrame:
    """(h): the n least distinct values of column h of `rows`. A threshold from the number of distinct values drops most
    rows before they are made distinct and sorted."""
    about = rows.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, 1.5 * (n + 50) / max(about, 1))
    least, span = -(2**63), 2**64
    few = rows if share == 1 else rows.filter(F.col("h") < least + int(span * share))
    return few.select("h").distinct().orderBy("h").limit(n)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """(text, positive) of the training sample, and the class prior."""
    train = labels.filter(~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    n_pos, n_all = train.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    if not n_pos:
        return docs.select(F.col(text_col).alias("text"), F.lit(True).alias("positive")).filter("false"), 0.0
    hashed = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("toxicity")).alias("h")
    rest = docs.filter(~held_out(id_col))
    light = written(rest.select(F.col(id_col), hashed), "toxicity-hashes")
    of_toxic = light.join(train.filter("toxic = 1").select(id_col), id_col, "left_semi")
    chosen = least_hashes(of_toxic, POSITIVES).withColumn("positive", F.lit(True)).unionByName(least_hashes(light, UNLABELLED).withColumn("positive", F.lit(False)))
    chosen = written(chosen, "toxicity-chosen")
    # at most POSITIVES + UNLABELLED rows of a number, so they are broadcast
    texts = rest.select(hashed, F.col(text_col).alias("text")).join(F.broadcast(chosen), "h").dropDuplicates(["h", "positive"])
    return texts.select("text", "positive"), min(0.9, n_pos / n_all)


def vocabulary(rows: DataFrame) -> list[str]:
    """The features that mark positives best; counted in the tasks, summed by Spark, VOCABULARY of them come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = {True: Counter(), False: Counter()}
            for text, positive in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[positive].update(features(text))
            keys = list(n[True].keys() | n[False].keys())
            columns = [pa.array(keys, pa.string()), *[pa.array([n[k][f] for f in keys], pa.int64()) for k in (True, False)]]
            yield pa.RecordBatch.from_arrays(columns, names=["f", "p", "u"])

    n_p, n_u = rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    sums = rows.mapInArrow(count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    p, u = F.col("p") / max(n_p, 1), F.col("u") / max(n_u, 1)
    gain = p * F.log((p + 1e-3) / (u + 1e-3))
    error = F.sqrt(p * (1 - p) / max(n_p, 1) + u * (1 - u) / max(n_u, 1))
    sure = (F.col("p") >= 3) & (p > 2 * u) & (p - u >= SURE * error)
    best = sums.filter(sure).orderBy(gain.desc(), "f").limit(VOCABULARY)
    return [r["f"] for r in best.select("f").collect()]


def _hits(text: str | None, index: dict[str, int]) -> list[int]:
    """The numbers of the features that a text has; only features of the vocabulary are counted."""
    counts = Counter(_WORD.findall((text or "").lower()))
    found: Counter[str] = Counter()
    for w, k in counts.items():
        if w in index:
            found[w] += k
        for n in BEGINNINGS:
            if len(w) > n and (start := w[:n] + "~") in index:
                found[start] += k
    total = sum(counts.values()) if found else 0
    out = []
    for f, k in found.items():
        names = [f, *(f + "@" * i for i, d in enumerate(DENSITIES, 1) if k * d >= total)]
        out += [index[x] for x in names if index.get(x, -1) >= 0]
    return sorted(out)


def _numbered(names: list[str]) -> dict[str, int]:
    """Numbers of the features; a feature that is there with a density only is known without a number."""
    index = {f.rstrip("@"): -1 for f in names}
    return index | {f: i for i, f in enumerate(names)}


def fit(rows: list[tuple[bool, list[int]]], n_features: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias minimising the non-negative risk with the logistic loss, by Adam over the whole sample."""
    positive = np.array([r[0] for r in rows], bool)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([j for r in rows for j in r[1]], np.int64)
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    w, m, v = (np.zeros(n_features + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        g = np.bincount(row, w[col], len(rows)) + w[-1]
        up = 1 / (1 + np.exp(-g))  # slope of the loss of calling it negative; up - 1: of calling it positive
        cost = np.logaddexp(0, g)
        negative = cost[~positive].sum() / n_u - prior * cost[positive].sum() / n_p
        slope = np.where(positive, -prior * up / n_p, up / n_u)
        if negative < 0:
            slope = -slope
        else:
            slope = slope + np.where(positive, prior * (up - 1) / n_p, 0)
        grad = np.append(np.bincount(col, slope[row], n_features), slope.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, int], np.ndarray, float]:
    """The vocabulary, its weights and the bias."""
    bound_batches(docs.sparkSession)
    ship(docs.sparkSession)
    rows, prior = sample(docs, labels, id_col, text_col)
    if not prior:
        return {}, np.zeros(0), float("-inf")
    rows = written(rows, "toxicity-sample")
    names = vocabulary(rows)
    index = _numbered(names)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([_hits(x, index) for x in b.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(1), found], names=["positive", "hits"])

    # At most POSITIVES + UNLABELLED rows of at most VOCABULARY small numbers.
    got = rows.mapInArrow(hits, "positive boolean, hits array<int>").collect()
    data = sorted((r["positive"], r["hits"]) for r in got)  # rows arrive in any order; sums must not depend on it
    weights, bias = fit(data, len(names), prior)
    return index, weights, bias


def scorer(model: tuple[dict[str, int], np.ndarray, float]):
    """A column function: the score of a whole text."""
    index, weights, bias = model
    table = weights.tolist()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        g = np.array([sum(table[j] for j in _hits(x, index)) for x in texts], float) + bias
        return pd.Series(np.exp(-np.logaddexp(0, -g)))

    return score


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column of scores, which replaces a column of that name."""
    score = scorer(train(docs, labels, id_col, text_col))
    return docs.withColumn(out, score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score below 0.5, with their columns."""
    score = scorer(train(docs, labels, id_col, text_col))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), score(text).alias("_score"))
    return whole.filter("_score < 0.5").select("_doc.*")


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = scored(docs.select(id_col, text_col), labels, id_col, text_col)
    return rows.select(id_col, held_out(id_col).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
