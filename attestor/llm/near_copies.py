"""Near copies of a corpus: texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or more.

Four bits of a 64-bit fingerprint don't reach that far (texts of similarity 0.8 differ in about 10), so candidates come from the
ring's keys of `simhash` and from blocks of two min-wise shingles. In blocks of up to `SMALL` texts every pair that
keeps the budget of `WIDE` bits and of sizes goes to the shingle sets, which decide. A pair of similarity 0.8 is in no block with a
probability of 0.36 ** 8 = 0.0003, at 0.9 of 0.000002, and over the budget of bits with about 0.00001.

Larger blocks are pages that share a passage, and crowds of copies. Their texts are joined again by an exact key:

* Shingles are put in one order, frequent ones last. If two sets are similar, their first common shingle stands in the first
  ninth of the smaller one and in the first fifth of the larger one (for 0.8). So those are the keys, and a passage that many
  pages share is in no first ninth, unless they have hardly anything else; then they are alike.
* In keys of up to `SMALL` texts all pairs that the places, sizes and bits allow are decided.
* In larger keys, first each text meets a few pivots, which connects a crowd of copies by about as many links as it has
  texts. Only keys whose texts aren't all connected by then are compared pair by pair, in tiles of `VOLUME` shingles with
  their sets, leaving out pairs that are connected already: a link between them wouldn't change any group.

A link is only ever left out between texts that decided links connect, so groups don't depend on the size of a block. A
text in very many pairs meets them in several tasks.

Null texts count as empty; texts without words, null ones too, are one group. Very long texts are read whole. Rows with one id but
unlike texts are judged each by its own text; rows with a null id come last in their group. Of rows that share id and text
any one stays. An empty table gives no rows. Columns of any name pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import bound_batches, ship, written
from .components import components
from .simhash import BITS, SEED, SMALL, _chains, _grouped, _keys, _scheme, hashes, majority

#: Words of a shingle, least similarity, bits that a candidate may differ in, blocks of two min-wise shingles. Of 64 bits, a pair
#: of similarity 0.8 differs in 9.6 on average, with a standard deviation of 2.9.
WORDS, SIMILAR, WIDE, BANDS = 5, 0.8, 22, 8
#: Up to so many rows of keys are broadcast; so many frequent shingles are put last.
BROADCAST, FREQUENT = 500_000, 500_000
#: Pivots that a text of large keys meets; shingles of a tile's texts; pairs of a text that one task meets, and tasks for a text
#: with more.
PIVOTS, VOLUME, HUB, SALTS = 4, 400_000, 1000, 64

_FACTORS = np.random.default_rng(SEED).integers(1, 2**63, 2 * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def row_key(text: Column) -> Column:
    """Which text a row has; with the id it names the row, up to copies that share both."""
    return F.md5(F.coalesce(text, F.lit("")))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, norm, fp, size, bands, shingles) for every row: the digest of the text, that of its lower-cased words
    (equal words have equal shingles), fingerprint, number of distinct shingles, block keys and 32-bit hashes of shingles."""
    bound_batches(docs.sparkSession)
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def bands(h: np.ndarray) -> np.ndarray:
        """Negative keys, which the ring's keys never are."""
        if not len(h):
            return np.full(1, -1)
        least = np.array([(h * f).min() for f in _FACTORS]).reshape(BANDS, 2)
        mixed = (least[:, 0] * _FACTORS[:BANDS]) ^ (least[:, 1] * _FACTORS[BANDS:])
        return (mixed | np.uint64(1 << 63)).view(np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm, fp, size, keys, sets = [], [], [], [], []
            for text in b.column(1).to_pylist():
                words = (text or b"").lower().split()
                h = hashes(words, WORDS)
                own = np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32)
                norm.append(hashlib.md5(b" ".join(words), usedforsecurity=False).digest())
                fp.append(majority(h))
                size.append(len(own))
                keys.append(bands(h))
                sets.append(own)
            columns = [
                b.column(0), b.column(2), pa.array(norm, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64), pa.int64()), pa.array(size, pa.int32()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row_key", "norm", "fp", "size", "bands", "shingles"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), row_key(text).alias("row_key"))
    return rows.mapInArrow(of, f"id {kind}, row_key string, norm binary, fp long, size int, bands array<long>, shingles array<int>")


def _bounded(keys: DataFrame, n: int) -> DataFrame:
    """For a join: broadcast if there are few enough."""
    return F.broadcast(keys) if n <= BROADCAST else keys


def _sets(rows: DataFrame, texts: DataFrame, norms: DataFrame) -> DataFrame:
    """`norms` (norm, crowded) with fp, size and shingles, which are read from one row of each text."""
    meant = written(norms.join(texts.select("norm", "least.id", "least.row_key"), "norm"), "near-texts")
    named = [F.col("r.norm") == F.col("m.norm"), F.col("r.row_key") == F.col("m.row_key"), F.col("r.id").eqNullSafe(F.col("m.id"))]
    found = rows.alias("r").join(_bounded(meant, meant.count()).alias("m"), named)
    return written(found.select("m.norm", "crowded", "fp", "size", "shingles").dropDuplicates(["norm"]), "near-sets")


def _with_sets(pairs: DataFrame, sets: DataFrame, hubs: DataFrame, side: str, other: str) -> DataFrame:
    """`pairs` with the shingles of one side; a text of very many pairs is copied to several tasks."""
    own = sets.select(F.col("norm").alias(side), F.col("shingles").alias(f"s{side}"))
    if not (n := hubs.count()):
        return pairs.join(own, side)
    often = _bounded(hubs.select(F.col("v").alias(side), F.lit(True).alias("often")), n)
    salted = pairs.join(often, side, "left").withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = own.join(often, side, "left").withColumn("salt", F.explode(salts)).drop("often")
    return salted.drop("often").join(copies, [side, "salt"]).drop("salt")


def _decided(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    pairs = written(pairs.distinct(), "near-pairs")
    hubs = [written(pairs.groupBy(F.col(side).alias("v")).count().filter(F.col("count") > HUB).select("v"), "hubs") for side in "ab"]
    pairs = _with_sets(_with_sets(pairs, sets, hubs[0], "a", "b"), sets, hubs[1], "b", "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.filter(common >= similar * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _needed(x: np.ndarray, y: np.ndarray, similar: float) -> np.ndarray:
    """The least number of common shingles of similar sets of these sizes."""
    return np.ceil(similar / (1 + similar) * (x + y) - 1e-6)


def _allowed(one: tuple, other: tuple, similar: float) -> np.ndarray:
    """Whether texts (fp, size, place of a shingle) can be similar and have this as their first common shingle."""
    (f, n, i), (g, m, j) = one, other
    ok = np.minimum(n, m) >= similar * np.maximum(n, m) - 1e-6
    ok &= np.minimum(n - i, m - j) >= _needed(n, m, similar)
    return ok & (np.bitwise_count(f ^ g) <= WIDE)


def _prefixes(sets: DataFrame, similar: float) -> DataFrame:
    """(t, at, first, fp, size, v): the shingles that stand early enough in their text to be the first that a similar one has
    too; `first` says whether that holds also against larger texts."""
    count = sets.select(F.explode("shingles").alias("t")).groupBy("t").count().filter(F.col("count") > SMALL)
    often = np.array([tuple(r) for r in count.orderBy(F.col("count").desc(), "t").limit(FREQUENT).collect()], np.int64).reshape(-1, 2)
    often = often[np.argsort(often[:, 0], kind="stable")]
    names, counts = often[:, 0].astype(np.int32), often[:, 1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            n_of = []
            for s in b.column(3):
                t = s.values.to_numpy()
                n = len(t)
                frequency = np.zeros(n, np.int64)
                if len(names):
                    where = np.minimum(np.searchsorted(names, t), len(names) - 1)
                    frequency = np.where(names[where] == t, counts[where], 0)
                order = np.lexsort((t, frequency))[: n - math.ceil(similar * n - 1e-6) + 1]
                out[0].append(t[order])
                out[1].append(np.arange(len(order), dtype=np.int32))
                out[2].append(n - np.arange(len(order)) >= _needed(np.float64(n), np.float64(n), similar))
                n_of.append(len(order))
            row = pa.array(np.repeat(np.arange(b.num_rows), n_of))
            flat = [pa.array(np.concatenate(c) if c else np.empty(0)).cast(kind) for c, kind in zip(out, (pa.int32(), pa.int32(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*flat, b.column(1).take(row), b.column(2).take(row), b.column(0).take(row)], names=["t", "at", "first", "fp", "size", "v"])

    return sets.select("norm", "fp", "size", "shingles").mapInArrow(of, "t int, at int, first boolean, fp long, size int, v binary")


def _columns(table: pa.Table) -> tuple:
    fp, size, at = (table.column(c).to_numpy() for c in ("fp", "size", "at"))
    return fp.view(np.uint64), size.astype(np.float64), at.astype(np.float64)


def _pairs_of_keys(tokens: DataFrame, similar: float) -> DataFrame:
    """(a, b): all pairs that keys of up to `SMALL` texts allow; a partition's sorted keys are compared lag by lag."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one batch, and of the one before it that may share a key

        for b in batches:
            table = pa.Table.from_batches([*held, b])
            if not table.num_rows:
                continue
            held = table.slice(max(0, table.num_rows - SMALL)).combine_chunks().to_batches()
            new = table.num_rows - b.num_rows  # pairs among what was held are done
            t, values, v = table.column("t").to_numpy(), _columns(table), table.column("v").combine_chunks()
            for lag in range(1, SMALL):
                x = np.flatnonzero(t[lag:] == t[:-lag]) if len(t) > lag else np.empty(0, np.int64)
                if not len(x):
                    break
                x = x[x + lag >= new]
                ok = _allowed(tuple(c[x] for c in values), tuple(c[x + lag] for c in values), similar)
                yield pa.RecordBatch.from_arrays([v.take(pa.array(x[ok])), v.take(pa.array(x[ok] + lag))], names=["a", "b"])

    return tokens.repartition("t").sortWithinPartitions("t", "v").mapInArrow(of, "a binary, b binary")


def _bits(shingles: pa.ListArray) -> np.ndarray:
    """A row of bits for each set; a column for each shingle that at least two sets have."""
    flat, borders = shingles.values.to_numpy(), shingles.offsets.to_numpy()
    names, column, n = np.unique(flat[borders[0] : borders[-1]], return_inverse=True, return_counts=True)
    place = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[column]
    width = -(-int((n > 1).sum()) // 64) * 64
    out = np.zeros((len(shingles), width // 64), np.uint64)
    for i, (x, y) in enumerate(zip(borders - borders[0], borders[1:] - borders[0], strict=False)):
        row = np.zeros(width, bool)
        own = place[x:y]
        row[own[own >= 0]] = True
        out[i] = np.packbits(row).view(np.uint64)
    return out


def _links_of_tiles(tokens: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(a, b): links that connect all texts of unlike labels that large keys allow and whose sets are similar. The texts of a
    key are dealt to tiles by the volume of their sets, and each two tiles meet in a group of their own. There a text is compared with
    those that aren't connected with it yet, so a group gives no more links than it has texts."""
    parts = F.ceil(F.col("volume") / VOLUME).cast("int")
    own = tokens.withColumn("tile", F.pmod(F.xxhash64("v"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    own = own.withColumn("low", F.least("tile", "with")).withColumn("high", F.greatest("tile", "with"))
    own = own.join(sets.select(F.col("norm").alias("v"), "shingles"), "v").select("t", "low", "high", "tile", "at", "fp", "size", "label", "v", "shingles")

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tile", "ascending"), ("v", "ascending")])
        tile, values, v = table.column("tile").to_numpy(), _columns(table), table.column("v").combine_chunks()
        group = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        left = np.flatnonzero(tile == tile[0])
        both = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        a, b = [], []
        if both == (tile[0] != tile[-1]):  # else one of the two tiles is empty
            right = np.flatnonzero(tile != tile[0]) if both else left
            bits, size = _bits(table.column("shingles").combine_chunks()), values[1]
            for i in left.tolist():
                near = right if both else right[right > i]
                near = near[group[near] != group[i]]
                near = near[_allowed(tuple(c[i] for c in values), tuple(c[near] for c in values), similar)]
                if not len(near):
                    continue
                common = np.bitwise_count(bits[near] & bits[i]).sum(1)
                near = near[common >= similar * (size[near] + size[i] - common)]
                for g, first in zip(*np.unique(group[near], return_index=True), strict=True):
                    a.append(i)
                    b.append(int(near[first]))
                    group[group == g] = group[i]
        return pa.table({"a": v.take(pa.array(a, pa.int64())), "b": v.take(pa.array(b, pa.int64()))})

    return own.groupBy("t", "low", "high").applyInArrow(of, "a binary, b binary")


def _crowded_links(sets: DataFrame, links: DataFrame, similar: float) -> DataFrame:
    """The links (a, b) with those among crowded texts, as many as their groups need."""
    tokens = written(_prefixes(sets.filter("crowded"), similar), "prefixes")
    sizes = tokens.groupBy("t").agg(F.count("*").alias("n"), F.max("first").alias("first"), F.sum("size").alias("volume"))
    large = written(sizes.filter(F.col("first") & (F.col("n") > SMALL)).select("t", "volume"), "large-keys")
    n = large.count()
    used = written(sizes.filter(F.col("first") & F.col("n").between(2, SMALL)).select("t"), "small-keys")
    links = written(links.unionByName(_decided(_pairs_of_keys(tokens.join(used, "t", "left_semi"), similar), sets, similar)), "links")
    if not n:
        return links
    hot = written(tokens.join(_bounded(large, n), "t"), "hot-prefixes")
    # pivots, which differ from key to key
    of_key = hot.groupBy("t").agg(F.min_by(F.struct("v", "fp", "size"), F.xxhash64("t", "v")).alias("pivot"))
    early = hot.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("at"))).filter(F.col("nth") <= PIVOTS)
    met = early.join(_bounded(of_key, n), "t").filter(F.col("v") != F.col("pivot.v"))
    met = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot.fp"))) <= WIDE)
    met = met.filter(F.least("size", "pivot.size") >= similar * F.greatest("size", "pivot.size") - 1e-6)
    links = written(links.unionByName(_decided(met.select(F.col("v").alias("a"), F.col("pivot.v").alias("b")), sets, similar)), "links")
    labelled = hot.withColumn("label", F.col("v"))
    if not links.isEmpty():
        labelled = hot.join(components(links, "a", "b"), "v", "left").withColumn("label", F.coalesce("root", "v")).drop("root")
    labelled = written(labelled, "labelled")
    apart = labelled.groupBy("t").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("t")
    apart = written(apart, "apart-keys")
    if not (m := apart.count()):
        return links
    apart_rows = labelled.join(_bounded(apart, m), "t", "left_semi")
    return written(links.unionByName(_links_of_tiles(apart_rows, sets, similar)).distinct(), "links")


def similar_pairs(rows: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(a, b): links between texts (norm) of that similarity or more that connect all such texts. `rows` is `described`,
    `texts` has one row a norm with the row that stands for it (least)."""
    chain, parts = _scheme(texts.count())
    keyed = texts.select(F.explode(F.concat(_keys(F.col("fp"), chain, parts), "bands")).alias("key"), "fp", "size", F.col("norm").alias("v"))
    large = written(keyed.groupBy("key").count().filter(F.col("count") > SMALL).select("key"), "large-blocks")
    n = large.count()
    small = keyed.join(_bounded(large, n), "key", "left_anti") if n else keyed
    everywhere = [(np.uint64(2**64 - 1), WIDE)]
    pairs = written(_grouped(small, [*_chains(BITS), everywhere], similar, "binary").distinct(), "small-blocks")
    norms = pairs.select(F.explode(F.array("a", "b")).alias("norm"), F.lit(False).alias("crowded"))
    if n:
        norms = norms.unionByName(keyed.join(_bounded(large, n), "key", "left_semi").select(F.col("v").alias("norm"), F.lit(True).alias("crowded")))
    sets = _sets(rows, texts, norms.groupBy("norm").agg(F.max("crowded").alias("crowded")))
    links = _decided(pairs, sets, similar)
    return _crowded_links(sets, links, similar) if n else written(links, "links")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of each group of near copies: that with the least id, or else the least digest of its text."""
    rows = written(described(docs, id_col, text_col), "described")
    name = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row_key")
    texts = rows.groupBy("norm").agg(F.min(name).alias("least"), *[F.first(c).alias(c) for c in ("fp", "size", "bands")])
    texts = written(texts, "texts")
    edges = similar_pairs(rows, texts, similar)
    stays = texts.select("norm", "least")
    if not edges.isEmpty():
        roots = components(edges, "a", "b")
        stays = stays.join(roots.withColumnRenamed("v", "norm"), "norm", "left").withColumn("norm", F.coalesce("root", "norm"))
    stays = stays.groupBy("norm").agg(F.min("least").alias("least")).select(F.col("least.id").alias("_id"), F.col("least.row_key").alias("_key"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_0"), row_key(F.col(text_col).cast("string")).alias("_1"))
    kept = whole.join(stays, F.col("_0").eqNullSafe(F.col("_id")) & (F.col("_1") == F.col("_key")), "left_semi")
    return kept.dropDuplicates(["_0", "_1"]).select("_doc.*")
