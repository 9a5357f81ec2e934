"""Nearest vectors for many queries: exact by block products, or from a written index of cells.

Exact: queries are sent to the tasks in blocks of `BLOCK`; a task multiplies a batch of its rows with all of them at once and
keeps the best k of each query, so k rows a query and task are shuffled, whatever the table's size.

Index: centroids come from a bounded sample (`SAMPLE` rows, those with the least hashes), and every row is written to the folder of
its nearest centroid. A search reads the cells nearest to each query only; the files of a large cell are dealt to tasks like any
others, which multiply their rows with the queries of a block that read the cell. How many of the exact neighbours a search finds depends on `probes`; measure
it with `recall`.

Similarity has one of three scales, as stores of vectors have them: "cosine" (never below 0), "unclipped" (1 minus the cosine
distance), and "half" (1 minus half the Euclidean distance, never below 0). Null vectors and queries, and those with null entries or of another
length than most, match nothing; a vector without length has cosine 0. Ties go to the least id. Repeated rows are each found.
Rows with null ids are found too; queries with null ids are dropped. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from ..session import bound_batches, ship

BLOCK, CHUNK, SAMPLE, STEPS = 2048, 256, 20_000, 12
SCALES = ("cosine", "unclipped", "half")


def _usable(vector: Column, size: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == size) & ~F.exists(vector, lambda c: c.isNull())


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _units(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def scores(rows: np.ndarray, queries: np.ndarray, scale: str) -> np.ndarray:
    """Similarity of each row with each query."""
    if scale == "half":
        square = (rows**2).sum(1)[:, None] + (queries**2).sum(1)[None, :] - 2 * rows @ queries.T
        return np.maximum(0.0, 1 - np.sqrt(np.maximum(square, 0)) / 2)
    cosine = _units(rows) @ _units(queries).T
    return np.maximum(cosine, 0) if scale == "cosine" else cosine


def _best(found: DataFrame, query: str, id_col: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("similarity"), F.col(id_col).asc_nulls_last()))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _of_batch(ids: pa.Array, rows: np.ndarray, queries: np.ndarray, names: pa.Array, k: int, scale: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The best k rows of a batch for each query, `CHUNK` queries at a time, so that a task holds few similarities at once. Of
    equal rows the least ids are kept. What has no similarity matches nothing."""
    order = pc.sort_indices(pa.table({"i": ids}), sort_keys=[("i", "ascending")], null_placement="at_end").to_numpy()
    ids, rows = ids.take(pa.array(order)), rows[order]
    for first in range(0, len(queries), CHUNK):
        s = np.round(scores(rows, queries[first : first + CHUNK], scale), 12)
        s[np.isnan(s)] = -np.inf
        least = np.partition(s, max(0, len(s) - k), axis=0)[max(0, len(s) - k)]
        more, same = s > least, (s == least) & (least > -np.inf)
        row, of_query = np.nonzero(more | (same & (np.cumsum(same, axis=0) <= k - more.sum(0))))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(first + of_query)), ids.take(pa.array(row)), pa.array(s[row, of_query])], names=columns)


def _blocks(asked: DataFrame) -> Iterator[list]:
    """Rows of the driver's local iterator in blocks of `BLOCK`: one block at a time is on the driver."""
    block = []
    for r in asked.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query: str = "query", scale: str = "cosine") -> DataFrame:
    """(query, id, similarity, place): the k nearest rows of each query (column `query`, vectors in `vector_col`)."""
    if scale not in SCALES:
        raise ValueError(f"no such scale: {scale}")
    spark = vectors.sparkSession
    bound_batches(spark, 4096)
    ship(spark)
    kind, key = vectors.schema[id_col].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    asked = queries.filter(F.col(query).isNotNull() & F.col(vector_col).isNotNull()).select(query, vector_col)
    schema = f"`{query}` {key}, `{id_col}` {kind}, similarity double"
    out = None

    def searched(block: list) -> DataFrame:
        size = len(block[0][1])
        block = [(i, v) for i, v in block if len(v) == size and None not in v]
        names, q = [i for i, _ in block], np.array([v for _, v in block], np.float64).reshape(-1, size)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield from _of_batch(b.column(0), _matrix(b.column(1)), q, pa.array(names, b.schema.field(0).type if key == kind else None), k, scale, [query, id_col, "similarity"])

        return vectors.filter(_usable(F.col(vector_col), size)).select(id_col, vector_col).mapInArrow(of, schema)

    for block in _blocks(asked):
        out = searched(block) if out is None else out.unionByName(searched(block))
    return _best(out if out is not None else spark.createDataFrame([], schema), query, id_col, k)


def centroids(vectors: DataFrame, vector_col: str, cells: int) -> np.ndarray:
    """Unit vectors in the middle of cells, by k-means on a sample of the rows with the least hashes."""
    usable = vectors.filter(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda c: c.isNull()))
    rows = usable.select(F.col(vector_col).alias("v"), F.xxhash64(vector_col).alias("h")).orderBy("h").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    size = max(map(len, (r["v"] for r in rows)), key=[len(r["v"]) for r in rows].count)
    x = _units(np.array([r["v"] for r in rows if len(r["v"]) == size], np.float64))
    rng = np.random.default_rng(0)
    middle = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(STEPS):
        near = (x @ middle.T).argmax(1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, x)
        middle = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _units(sums), middle)
    return middle


def _cells(middle: np.ndarray, n: int):
    """A column function: the n cells nearest to a vector."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def near(column):  # noqa: ANN001, ANN202
        import pandas as pd

        s = _units(np.array(column.tolist(), np.float64).reshape(len(column), -1)) @ middle.T
        return pd.Series(np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32).tolist())

    return near


def indexed(vectors: DataFrame, path: str, id_col: str, vector_col: str, cells: int) -> np.ndarray:
    """Write an index of all usable rows to `path`, a folder for each cell; returns the centroids, which a search needs."""
    ship(vectors.sparkSession)
    bound_batches(vectors.sparkSession, 4096)
    middle = centroids(vectors, vector_col, cells)
    rows = vectors.filter(_usable(F.col(vector_col), middle.shape[1])).select(id_col, vector_col)
    cell = _cells(middle, 1)(F.col(vector_col))[0] if len(middle) else F.lit(0)
    rows.withColumn("cell", cell).write.mode("overwrite").partitionBy("cell").parquet(path)
    return middle


def search(spark: SparkSession, path: str, middle: np.ndarray, queries: DataFrame, k: int, id_col: str, vector_col: str, probes: int, query: str = "query") -> DataFrame:
    """(query, id, similarity, place) from the `probes` cells of an index that are nearest to each query, by clipped cosine. A
    task multiplies the rows of a cell with all queries of a block that read this cell."""
    bound_batches(spark, 4096)
    ship(spark)
    rows = spark.read.parquet(path).select(id_col, vector_col, "cell")
    kind, key = rows.schema[id_col].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    asked = queries.filter(F.col(query).isNotNull() & _usable(F.col(vector_col), middle.shape[1])).select(query, vector_col)
    schema = f"`{query}` {key}, `{id_col}` {kind}, similarity double"
    out = None

    def searched(block: list) -> DataFrame:
        names, q = [i for i, _ in block], np.array([v for _, v in block], np.float64)
        cells = np.argsort(-(_units(q) @ middle.T), axis=1, kind="stable")[:, :probes] if len(middle) else np.zeros((len(q), 1), int)
        reads = {c: np.flatnonzero((cells == c).any(1)) for c in np.unique(cells).tolist()}

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, names_ = b.column(2).to_numpy(zero_copy_only=False), pa.array(names, b.schema.field(0).type if key == kind else None)
                for c in np.unique(at).tolist():
                    if c in reads:
                        some, part = reads[c], b.filter(pa.array(at == c))
                        yield from _of_batch(part.column(0), _matrix(part.column(1)), q[some], names_.take(pa.array(some)), k, "cosine", [query, id_col, "similarity"])

        return rows.filter(F.col("cell").isin(list(reads))).mapInArrow(of, schema)

    for block in _blocks(asked):
        out = searched(block) if out is None else out.unionByName(searched(block))
    return _best(out if out is not None else spark.createDataFrame([], schema), query, id_col, k)


def recall(found: DataFrame, exact: DataFrame, query: str, id_col: str) -> float:
    """The share of the exact neighbours that a search has found."""
    hits = exact.select(query, id_col).join(found.select(query, id_col), [query, id_col], "left_semi").count()
    return hits / max(1, exact.count())
