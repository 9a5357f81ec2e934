"""Best-fit packing of tokenised documents, improved by a swap-based local search.

Documents longer than a window are cut from their end into whole windows, which are sequences of their own; what is left of
them and the shorter documents are packed whole. Items are dealt at random into groups of about `GROUP`, each packed by one
task: best fit in falling order of size, then the search. The search takes the emptiest bin as a donor and, between it and
the other underfull bins, moves a document, exchanges one for one, two for one or one for two, always choosing what raises the sum
of squared fills most. Each step empties the donor further in favour of a fuller bin, so bins run empty and are dropped.
A donor without such a step is left as it is and the next one is tried. The search ends when the number of bins is the least
that the sizes allow, or when a round over all donors has emptied none.

A bin has at most 63 distinct sizes (64 sum to more than 2,048), so bins are compared as rows of distinct sizes and memory is
bounded, whatever the sizes are. Bins that stay emptier than `LEAST` are taken apart again, and the items of all groups' such
bins are packed together in a second round, in as many groups as they need. Only ids, places and check sums are shuffled; token ids
never leave the task that made them.

Null texts count as empty: such a document has the closing id only. Very long texts are encoded whole, in one task. Ties go
to the first bin and the first of equal sizes. Repeated rows and null ids are each packed. An empty table gives no rows. Columns
beside id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ship, written
from .byte_ids import byte_ids_of

WINDOW, CLOSING = 2048, 0
#: Items that one task packs.
GROUP = 8192
#: Bins emptier than this are taken apart for the second round.
LEAST = 0.95
#: Elements of one comparison of donors' items with those of other bins.
BLOCK = 1 << 21


def best_fit(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Bins of sizes: each size goes to the bin that it leaves least room in."""
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    bins: list[list[int]] = []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(size)
        else:
            left, b = window, len(bins)
            bins.append([size])
        if left > size:
            insort(room, (left - size, b))
    return bins


class Search:
    """Local search over underfull bins. Sizes of a bin stand in its row of `sizes`, each distinct one once, then zeros."""

    def __init__(self, bins: list[list[int]], window: int = WINDOW):
        self.window = window
        self.bins = [sorted(b) for b in bins]
        self.fill = np.array([sum(b) for b in bins], np.int64)
        self.sizes = np.zeros((len(bins), max((len(set(b)) for b in bins), default=1)), np.int64)
        for i in range(len(bins)):
            self._row(i)
        self.steps = 0

    def _row(self, i: int) -> None:
        own = sorted(set(self.bins[i]))
        if len(own) > self.sizes.shape[1]:
            self.sizes = np.pad(self.sizes, ((0, 0), (0, len(own) - self.sizes.shape[1])))
        self.sizes[i] = 0
        self.sizes[i, : len(own)] = own

    def _best(self, donor: int, out: np.ndarray, back: np.ndarray) -> tuple[int, int, int] | None:
        """(bin, column of `back`, number of `out`) of the exchange that raises the sum of squares most: the donor gives one
        of the amounts `out` and gets back what stands in the bin's row of `back` (-1: nothing)."""
        room, apart, best, found = self.window - self.fill, self.fill - self.fill[donor], 0, None
        rows = max(1, BLOCK // max(1, back.shape[1]))
        for k, amount in enumerate(out.tolist()):
            for at in range(0, len(back), rows):
                gain = amount - back[at : at + rows]
                ok = (gain > 0) & (gain <= room[at : at + rows, None]) & (back[at : at + rows] >= 0)
                gain = np.where(ok, gain * (apart[at : at + rows, None] + gain), 0)
                if at <= donor < at + rows:
                    gain[donor - at] = 0
                if gain.size and gain.max() > best:
                    best, where = int(gain.max()), int(gain.argmax())
                    found = at + where // back.shape[1], where % back.shape[1], k
        return found

    def step(self, donor: int) -> bool:
        """One move or exchange between the donor and another bin; whether there was one."""
        own = self.bins[donor]
        one = np.array(sorted(set(own)), np.int64)
        nothing = np.where(self.fill > 0, 0, -1)[:, None]
        if (hit := self._best(donor, one, nothing)) is not None:
            return self._exchange(donor, hit[0], [int(one[hit[2]])], [])
        some = np.where(self.sizes > 0, self.sizes, -1)
        if (hit := self._best(donor, one, some)) is not None:
            return self._exchange(donor, hit[0], [int(one[hit[2]])], [int(self.sizes[hit[:2]])])
        pairs = sorted({(a, b) for i, a in enumerate(own) for b in own[i + 1 :]})
        if pairs and (hit := self._best(donor, np.array([a + b for a, b in pairs]), some)) is not None:
            return self._exchange(donor, hit[0], list(pairs[hit[2]]), [int(self.sizes[hit[:2]])])
        # two of another bin for one of the donor: pairs of the bins' distinct sizes, and equal sizes
        i, j = np.triu_indices(self.sizes.shape[1], 1)
        if len(i):
            x, y = self.sizes[:, i], self.sizes[:, j]
            two = np.where((x > 0) & (y > 0), x + y, -1)
            if (hit := self._best(donor, one, two)) is not None:
                return self._exchange(donor, hit[0], [int(one[hit[2]])], [int(x[hit[:2]]), int(y[hit[:2]])])
        twice = np.array([next((s for s, t in zip(b[::-1], b[-2::-1], strict=False) if s == t), 0) for b in self.bins], np.int64)
        if twice.any() and (hit := self._best(donor, one, np.where(twice > 0, 2 * twice, -1)[:, None])) is not None:
            return self._exchange(donor, hit[0], [int(one[hit[2]])], [int(twice[hit[0]])] * 2)
        return False

    def _exchange(self, donor: int, other: int, out: list[int], back: list[int]) -> bool:
        for s in out:
            self.bins[donor].remove(s)
            self.bins[other].append(s)
        for s in back:
            self.bins[other].remove(s)
            self.bins[donor].append(s)
        for i in (donor, other):
            self.bins[i].sort()
            self.fill[i] = sum(self.bins[i])
            self._row(i)
        self.steps += 1
        return True

    def run(self, least: int) -> list[list[int]]:
        """The bins when `least` are left or a round over all donors has emptied none."""
        while True:
            before = int((self.fill > 0).sum())
            stuck: set[tuple[int, ...]] = set()  # contents of donors that found nothing since the last step
            for donor in np.argsort(self.fill, kind="stable").tolist():
                while self.fill[donor] and int((self.fill > 0).sum()) > least and tuple(self.bins[donor]) not in stuck:
                    if self.step(donor):
                        stuck.clear()
                    else:
                        stuck.add(tuple(self.bins[donor]))
            after = int((self.fill > 0).sum())
            if after == before or after <= least:
                return [b for b in self.bins if b]


def packed_sizes(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Bins of sizes: best fit, then the search among those that aren't full."""
    bins = best_fit(sizes, window)
    least = -(-sum(sizes) // window)
    if len(bins) <= least:
        return bins
    full = [b for b in bins if sum(b) == window]
    return full + Search([b for b in bins if sum(b) < window], window).run(least - len(full))


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, closing: int = CLOSING) -> DataFrame:
    """(id, piece, start, length, ids_crc32, item): what is to be packed. Whole windows are cut off a long document's end."""
    bound_batches(docs.sparkSession, 256)
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, item = byte_ids_of(tokenizer), np.array([closing], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[tuple] = []
            for row, ids in enumerate(encode(b.column(1))):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % window or window, n + 1, window)] if n > window else [0, n]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((row, k, i, j - i, zlib.crc32(ids[4 * i : 4 * j]), item))
                    item += 1
            row, *rest = zip(*out, strict=True) if out else [()] * 6
            kinds = [pa.int32(), *[pa.int64()] * 4]
            columns = [b.column(0).take(pa.array(row, pa.int32())), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "item"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(of, f"id {kind}, piece int, start long, length long, ids_crc32 long, item long")


def _binned(rows: DataFrame, groups: int, window: int, turn: int) -> DataFrame:
    """The rows with the sequence they are in, their place there, and how full it is."""

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("item", "ascending")])
        lengths, group = table.column("length").to_pylist(), table.column("group")[0].as_py()
        of_size = defaultdict(list)
        for at in range(len(lengths) - 1, -1, -1):
            of_size[lengths[at]].append(at)
        sequence, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for number, sizes in enumerate(packed_sizes(lengths, window)):
            at = 0
            for size in sorted(sizes, reverse=True):
                row = of_size[size].pop()
                sequence[row], offset[row], fill[row] = group << 24 | number << 1 | turn, at, sum(sizes)
                at += size
        table = table.drop_columns(["group"])
        for name, values in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
            table = table.append_column(name, pa.array(values))
        return table

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, item long, sequence_id long, offset long, fill long"
    return dealt.groupBy("group").applyInArrow(of, schema)


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, closing: int = CLOSING, group: int = GROUP) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = written(pieces(docs, tokenizer, id_col, text_col, window, closing), "pieces")
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    groups = max(1, math.ceil(rows.count() / group))
    if groups == 1:
        return _binned(rows, 1, window, 0).select(columns)
    first = written(_binned(rows, groups, window, 0), "binned")
    rest = first.filter(F.col("fill") < LEAST * window)
    again = _binned(rest.drop("sequence_id", "offset", "fill"), max(1, math.ceil(rest.count() / group)), window, 1)
    return first.filter(F.col("fill") >= LEAST * window).unionByName(again).select(columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), id_col, text_col)
