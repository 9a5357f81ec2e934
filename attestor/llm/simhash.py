"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: lower-cased (A-Z) words, shingles of consecutive words, XXH64 with seed 42, majority of bits. Two
fingerprints link at `BITS` or fewer differing bits.

Pigeonring: cut the 64 bits into m = 5 segments on a ring. If two fingerprints differ in at most t = 4 bits, there is a
segment i from which every chain of l consecutive segments differs in at most floor(l * t / m) bits: none in segment i,
at most one in i and i+1, and so on. So the two agree in all of segment i and in one half of segment i+1, which makes
10 blocking keys of about 19 bits. Within a key, a chain that leaves its budget is dropped before the full Hamming check.

Two longer chains give wider keys: with a third segment there are 25 keys of about 26 bits, or 60 of about 30. All find
the same pairs; the number of fingerprints decides which costs least (`_scheme`), so that pair checks don't grow with the
square of the table.

Copies never meet: only distinct fingerprints are keyed. A partition sorted by key is read as a stream; each group of a
key emits the links of a spanning forest, found by flooding, so a cluster of n near copies costs about n comparisons and
n - 1 links instead of all pairs, and no link between different texts is lost.

Corpora are deduplicated by `near_copies`, which takes its first candidates from here.

Null texts count as empty; a text without words has fingerprint zero, linked like any other; very long texts are read
whole, in pieces of memory. Rows with a null id are returned, but don't name a component. Repeated rows and rows that
repeat an id with another text are each returned with their own component. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ship, written
from .components import components

SHINGLE, BITS, SEED = 4, 4, 42
#: (lowest bit, width) of the segments, and where the next segment is halved.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows of one fingerprint are spread over so many salts before they meet their component.
SALTS = 64
#: Groups of a key up to this size are compared lag by lag, larger ones are flooded; elements of one comparison block.
SMALL, BLOCK = 32, 1 << 21


def hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text's words, repeats included; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :]
    first = np.concatenate(([0], ends[: n - 1] + 1))
    cuts = map(slice, first.tolist(), last.tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(flat.__getitem__, cuts), repeat(SEED)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The 64-bit number whose bits are those that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    # bytes: A-Z only, and only the six ASCII blanks separate words
    return majority(hashes(text.lower().split(), shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x or b"", shingle) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(of, f"id {kind.simpleString()}, fp long")


def _part(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _cuts(segment: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """A segment in n parts."""
    low, width = segment
    at = [low + width * i // n for i in range(n + 1)]
    return [(x, y - x) for x, y in zip(at, at[1:], strict=False)]


def _scheme(n: int) -> tuple[int, int]:
    """(segments of a chain, parts of each) whose keys suit n distinct fingerprints."""
    return (2, 2) if n <= 1 << 22 else (3, 2) if n <= 1 << 28 else (3, 3)


def _kept(chain: int, parts: int, i: int) -> list[list[tuple[int, int]]]:
    """The bits of each key that begins with segment i: all of it, and the parts of the next segments but one part for
    each bit in which they may differ (one in the first of them, two in both)."""
    cut = [_cuts(SEGMENTS[(i + k) % len(SEGMENTS)], parts) for k in range(1, chain)]
    where = [(k, p) for k in range(chain - 1) for p in range(parts)]
    drops = [d for d in combinations(where, chain - 1) if sum(k == 0 for k, _ in d) <= 1]
    return [[SEGMENTS[i], *[cut[k][p] for k, p in where if (k, p) not in d]] for d in drops]


def _keys(fp: Column, chain: int = 2, parts: int = 2) -> Column:
    """The blocking keys: first segment and number of the key above, a hash of the bits below."""
    out = []
    for i in range(len(SEGMENTS)):
        for j, bits in enumerate(_kept(chain, parts, i)):
            value, width = F.lit(0).cast("long"), 0
            for low, w in bits:
                value = F.shiftleft(value, w).bitwiseOR(_part(fp, low, w))
                width += w
            out.append(F.lit((i << 8 | j) << 40).cast("long").bitwiseOR(value))
    return F.array(*out)


def _chains(bits: int) -> list[list[tuple[np.uint64, int]]]:
    """For each start, the masks of growing chains and the bits in which they may differ."""
    m, out = len(SEGMENTS), []
    for i in range(m):
        mask, chain = 0, []
        for n in range(1, m + 1):
            low, width = SEGMENTS[(i + n - 1) % m]
            mask |= ((1 << width) - 1) << low
            chain.append((np.uint64(mask), n * bits // m))
        out.append(chain)
    return out


def _close(diff: np.ndarray, chain: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Which differences keep every budget of the chain; the whole ring comes last and is the full Hamming check."""
    ok = np.bitwise_count(diff & chain[0][0]) <= chain[0][1]
    for mask, most in chain[1:]:
        ok &= np.bitwise_count(diff & mask) <= most
    return ok


def _flood(fps: np.ndarray, sizes: np.ndarray, chain: list[tuple[np.uint64, int]], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (new, from) of the links by which the clusters of a group are reached, each from the first of its rows;
    what is reached is compared with the rest only."""
    found, reached_from, rest = [], [], np.arange(len(fps))
    while len(rest) > 1:
        edge, rest = rest[:1], rest[1:]
        while len(edge) and len(rest):
            n = max(1, BLOCK // len(rest))
            now, edge = edge[:n], edge[n:]
            hit = _close(fps[now][:, None] ^ fps[rest][None, :], chain)
            if similar:
                hit &= np.minimum(sizes[now][:, None], sizes[rest][None, :]) >= similar * np.maximum(sizes[now][:, None], sizes[rest][None, :])
            some = hit.any(0)
            if some.any():
                found.append(rest[some])
                reached_from.append(now[hit[:, some].argmax(0)])
                edge, rest = np.concatenate((edge, rest[some])), rest[~some]
    none = np.empty(0, np.int64)
    return np.concatenate(found or [none]), np.concatenate(reached_from or [none])


def _linked(keys: np.ndarray, fps: np.ndarray, sizes: np.ndarray, chains: list, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked rows within the whole groups of sorted keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.concatenate((starts, [len(keys)])))
    chain_of = np.where(keys < 0, len(chains) - 1, keys >> 48)
    out_a, out_b = [], []
    for s, n in zip(starts[counts > SMALL].tolist(), counts[counts > SMALL].tolist(), strict=True):
        a, b = _flood(fps[s : s + n], sizes[s : s + n], chains[int(chain_of[s])], similar)
        out_a.append(a + s)
        out_b.append(b + s)
    small = np.flatnonzero(np.repeat((counts > 1) & (counts <= SMALL), counts))
    k = keys[small]
    for lag in range(1, SMALL):
        at = np.flatnonzero(k[lag:] == k[:-lag]) if len(k) > lag else np.empty(0, np.int64)
        if not len(at):
            break
        one, other = small[at], small[at + lag]
        for i in np.unique(chain_of[one]).tolist():
            own = chain_of[one] == i
            x, y = one[own], other[own]
            ok = _close(fps[x] ^ fps[y], chains[i])
            if similar:
                ok &= np.minimum(sizes[x], sizes[y]) >= similar * np.maximum(sizes[x], sizes[y])
            out_a.append(y[ok])
            out_b.append(x[ok])
    none = np.empty(0, np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _grouped(keyed: DataFrame, chains: list, similar: float, kind: str) -> DataFrame:
    """(a, b): linked vertices of (key, fp, size, v), group by group; a partition is read as a stream of its sorted keys."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            k, f, n = (t.column(i).to_numpy() for i in range(3))
            a, b = _linked(k, f.view(np.uint64), n, chains, similar)
            v = t.column(3).combine_chunks()
            return pa.RecordBatch.from_arrays([v.take(pa.array(a)), v.take(pa.array(b))], names=["a", "b"])

        held: list[pa.RecordBatch] = []  # the last key's rows, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() == k[-1]:
                held.append(batch)
                continue
            cut = int(np.searchsorted(k, k[-1]))
            held.append(batch.slice(0, cut))
            yield result(held)
            held = [batch.slice(cut)]
        if held:
            yield result(held)

    return keyed.repartition("key").sortWithinPartitions("key", "v").mapInArrow(of, f"a {kind}, b {kind}")


def links(fps: DataFrame, bits: int = BITS, scheme: tuple[int, int] | None = None) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column fp that connect all that differ in `bits` or fewer."""
    if bits >= len(SEGMENTS):
        raise ValueError(f"at most {len(SEGMENTS) - 1} bits: more need more segments")
    chain, parts = scheme or _scheme(fps.count())
    keyed = fps.select(F.explode(_keys(F.col("fp"), chain, parts)).alias("key"), "fp").select("key", "fp", F.lit(0).alias("size"), F.col("fp").alias("v"))
    return _grouped(keyed, _chains(bits), 0.0, "long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(id, fp, component): for every row its fingerprint and the smallest id that links of `bits` or fewer reach."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # The rows of a fingerprint may be a third of all: they are counted and later met by salt.
    salt_of = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    salt = salt_of("id").alias("salt")
    salted = written(prints.groupBy("fp", salt).agg(F.min("id").alias("least")), "salted")
    distinct = written(salted.groupBy("fp").agg(F.min("least").alias("least")), "distinct")
    edges = written(links(distinct, bits).distinct(), "links")
    roots = components(edges, "a", "b").withColumnsRenamed({"v": "fp"}) if not edges.isEmpty() else distinct.filter("false").select("fp", F.col("fp").alias("root"))
    # a component may hold most fingerprints with a link, so its rows meet its least id by salt
    rooted = distinct.join(roots, "fp").withColumn("salt", salt_of("fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_fp = rooted.join(least, ["root", "salt"]).select("fp", "component")
    of_fp = of_fp.unionByName(distinct.join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component")))
    of_salt = salted.select("fp", "salt").join(of_fp, "fp")
    return prints.select("id", "fp", salt).join(of_salt, ["fp", "salt"]).select("id", "fp", "component")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = classes(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
