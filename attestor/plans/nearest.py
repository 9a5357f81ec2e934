"""Queries of nearest vectors: every twentieth row asks all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vectors as N
from ..session import shared_dir
from .registry import Tables, query

_c = F.col
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_HALF = "greatest(0, 1 - list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / 2)"


def _sql(score: str) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query, e.vec_id, round({score}, 12) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
SELECT query, vec_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS place FROM s QUALIFY place <= 10"""


def _asked(t: Tables) -> DataFrame:
    return t("embeddings").filter("vec_id % 20 = 0").select(_c("vec_id").alias("query"), "embedding")


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query", "vec_id", F.round("similarity", 6).alias("similarity"), "place")


@query("txt11_batch_nearest", _sql(f"greatest(0, {_COS})"))
def _(t: Tables) -> DataFrame:
    """The ten nearest rows of each query, exact."""
    return _shown(N.nearest(t("embeddings"), _asked(t), 10, "vec_id", "embedding"))


@query("txt11a_half_distance", _sql(_HALF))
def _(t: Tables) -> DataFrame:
    """The same on the scale of half the Euclidean distance."""
    return _shown(N.nearest(t("embeddings"), _asked(t), 10, "vec_id", "embedding", scale="half"))


@query("jon03_unclipped_hits", f"WITH h AS ({_sql(_COS)}) SELECT query, vec_id, source, similarity FROM h JOIN documents ON doc_id = vec_id WHERE lang = 'en'")
def _(t: Tables) -> DataFrame:
    """The nearest rows on the scale without a floor, with the chunks that are in scope."""
    hits = _shown(N.nearest(t("embeddings"), _asked(t), 10, "vec_id", "embedding", scale="unclipped"))
    return hits.join(t("documents").filter("lang = 'en'"), _c("vec_id") == _c("doc_id")).select("query", "vec_id", "source", "similarity")


@query("txt11_indexed")
def _(t: Tables) -> DataFrame:
    """The ten nearest from an index of 32 cells, of which a search reads 20: these vectors are close to random, so cells part them
    little. Tests measure the recall (0.92 to 0.94)."""
    import uuid

    e = t("embeddings")
    spark = e.sparkSession
    path = f"{shared_dir(spark)}/attestor/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    middle = N.indexed(e, path, "vec_id", "embedding", 32)
    return _shown(N.search(spark, path, middle, _asked(t), 10, "vec_id", "embedding", 20))
