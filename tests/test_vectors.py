"""Nearest vectors against plain products, and the recall of the index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestor import catalog
from attestor.operators import vectors as N
from attestor.session import table


@pytest.mark.parametrize("scale", N.SCALES)
def test_nearest(spark, scale):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(300, 6))
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, x[3].tolist()), (None, x[4].tolist()), (401, None), (402, [1.0]), (403, [None] * 6)]
    q = [(i, x[i].tolist()) for i in (0, 3, 7, 20)] + [(99, None), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got: dict[int, list] = {}
    for r in N.nearest(df, spark.createDataFrame(q, "query long, v array<double>"), 9, "id", "v", scale=scale).collect():
        got.setdefault(r["query"], []).append((r["place"], r["id"], r["similarity"]))
    good = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == 6 and None not in v]

    def like(a, b):
        if scale == "half":
            return max(0.0, 1 - np.linalg.norm(a - b) / 2)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        c = a @ b / n if n else 0.0
        return max(0.0, c) if scale == "cosine" else c

    assert set(got) == {0, 3, 7, 20}
    for k, found in got.items():
        want = sorted(((-round(like(v, x[k]), 9), i is None, i or 0) for i, v in good))[:9]
        assert [(round(s, 9), i) for _, i, s in sorted(found, key=lambda f: f[0])] == [(-s, None if none else i) for s, none, i in want]


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    df = spark.range(40).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    got = N.nearest(df, df.withColumnRenamed("id", "query"), 1, "id", "v").collect()
    assert sorted((r["query"], r["id"]) for r in got) == [(i, i) for i in range(40)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_recall_of_the_index(spark, sf):
    at = f"/root/testdata/sf{sf}"
    found, exact = catalog.queries()["txt11_indexed"](spark, at), catalog.queries()["txt11_batch_nearest"](spark, at)
    assert N.recall(found, exact, "query", "vec_id") >= 0.9


def test_index_holds_every_row(spark, tmp_path):
    e = table(spark, "/root/testdata/sf0.001", "embeddings")
    middle = N.indexed(e, str(tmp_path / "i"), "vec_id", "embedding", 8)
    assert spark.read.parquet(str(tmp_path / "i")).count() == e.count() and len(middle) == 8
    asked = e.limit(5).select(F.col("vec_id").alias("query"), "embedding")
    all_ = N.search(spark, str(tmp_path / "i"), middle, asked, 10, "vec_id", "embedding", 8)
    assert N.recall(all_, N.nearest(e, asked, 10, "vec_id", "embedding"), "query", "vec_id") == 1.0


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "query long, v array<double>")
    assert N.nearest(none, one, 3, "id", "v").count() == 0
    assert N.nearest(one.withColumnRenamed("query", "id"), one.filter("false"), 3, "id", "v").count() == 0
    with pytest.raises(ValueError, match="no such scale"):
        N.nearest(none, one, 3, "id", "v", scale="other")


def test_ties_of_many_copies(spark):
    """Of thousands of equal rows a task hands on as many as are asked for, and the least ids win; rows without a number match nothing."""
    df = spark.range(5000, numPartitions=2).select("id", F.array(F.lit(1.0), F.when(F.col("id") == 3, float("nan")).otherwise(2.0)).alias("v"))
    ids = np.arange(5000)[::-1]
    many = list(N._of_batch(pa.array(ids), np.tile([1.0, 2.0], (5000, 1)), np.ones((600, 2)), pa.array(range(600)), 4, "half", ["q", "i", "s"]))
    assert sum(b.num_rows for b in many) == 2400 and set(pa.Table.from_batches(many)["i"].to_pylist()) == {0, 1, 2, 3}
    got = N.nearest(df, df.filter("id = 7").withColumnRenamed("id", "query"), 4, "id", "v").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [0, 1, 2, 4]


def test_similarities_at_once_are_few(monkeypatch):
    """However many queries a block has, only `CHUNK` of them are multiplied at once."""
    seen, whole = [], N.scores
    monkeypatch.setattr(N, "scores", lambda rows, queries, scale: seen.append(len(queries)) or whole(rows, queries, scale))
    list(N._of_batch(pa.array(range(9)), np.eye(9), np.ones((N.BLOCK, 9)), pa.array(range(N.BLOCK)), 2, "cosine", ["q", "i", "s"]))
    assert max(seen) <= N.CHUNK and sum(seen) == N.BLOCK


def test_search_is_made_of_products(spark, tmp_path):
    """A search makes no row for a pair of a query and a row of its cells: the plan has no join."""
    e = table(spark, "/root/testdata/sf0.001", "embeddings")
    middle = N.indexed(e, str(tmp_path / "i"), "vec_id", "embedding", 8)
    found = N.search(spark, str(tmp_path / "i"), middle, e.limit(5).select(F.col("vec_id").alias("query"), "embedding"), 10, "vec_id", "embedding", 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 50
