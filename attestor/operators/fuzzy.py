"""Quotes that a text holds nearly: some window of as many words as the quote has is like it.

Likeness is the ratio of matching blocks (2 * matched characters / both lengths), as `difflib` defines it. It is computed only for
windows that can reach the least ratio. If M of the quote's a characters match M of the window's b in blocks, the quote keeps at
least (a - q + 1) - q * (a - M) - (q - 1) * (b - M) of its runs of q neighbouring characters: each unmatched character of the quote
breaks q, and two blocks that touch in the quote are parted by an unmatched character of the window. So a window must have that
many places with a run of the quote, which running sums tell for all windows at once, for pairs and for threes. Blocks are a
common subsequence, so a window whose longest one is too short is left out too; no window that is like enough is lost.

Quotes meet the chunks they were drawn from by an equi-join of the caller; each row is one quote and one chunk, so work is
spread by rows. Null or empty quotes and chunks match nothing; a chunk with fewer words than the quote doesn't match. Very
long chunks are read whole, in time proportional to their length but for the windows that pass. Repeated rows are each answered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ship

LEAST = 0.85


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def possible(quote: str, words: list[str], least: float = LEAST) -> list[int]:
    """Numbers of the windows that can be like the quote, by the bounds of lengths and of pairs of characters."""
    a, n = len(quote), len(quote.split())
    if not n or len(words) < n:
        return []
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    first = (ends - sizes)[: len(words) - n + 1]
    b = ends[n - 1 :] - first
    codes, own = _codes(" ".join(words)), _codes(quote)
    matched = np.ceil(least * (a + b) / 2 - 1e-9)
    enough = matched <= np.minimum(a, b)
    for q in (2, 3):
        grams, known = _grams(codes, q), np.unique(_grams(own, q))
        if not len(known):
            continue
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        sums = np.concatenate(([0], np.cumsum(known[at] == grams)))
        last = len(sums) - 1
        places = sums[np.minimum(np.maximum(first + b - q + 1, first), last)] - sums[np.minimum(first, last)]
        enough &= places >= (a - q + 1) - q * (a - matched) - (q - 1) * (b - matched)
    return np.flatnonzero(enough).tolist()


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Each run of q characters as one number; nothing if there are fewer. 21 bits hold any character."""
    out = codes[: max(0, len(codes) - q + 1)]
    for i in range(1, q):
        out = out << 21 | codes[i : len(codes) - q + 1 + i]
    return out


def common(places: dict[str, int], size: int, window: str) -> int:
    """Characters of the longest common subsequence, by bits; `places` has where each character of the quote stands."""
    every = (1 << size) - 1
    free = every
    for c in window:
        if hit := free & places.get(c, 0):
            free = (free + hit | free - hit) & every
    return size - free.bit_count()


def like(quote: str | None, text: str | None, least: float = LEAST) -> bool:
    """Whether a window of the text is like the quote; both are compared in lower case. Blocks are matched only in windows whose
    common subsequence, which holds all blocks in their order, is long enough."""
    quote, words = (quote or "").lower(), (text or "").lower().split()
    n = len(quote.split())
    if not n or len(words) < n:
        return False
    if f" {quote} " in f" {' '.join(words)} ":  # a window equals the quote
        return True
    places: dict[str, int] = {}
    for i, c in enumerate(quote):
        places[c] = places.get(c, 0) | 1 << i
    ends = list(accumulate(len(w) + 1 for w in words))
    most, seen = len(quote), 0  # no subsequence of a window that ends at `seen` is longer; each further character adds one at most
    for i in possible(quote, words, least):
        window = " ".join(words[i : i + n])
        needed = least * (len(quote) + len(window)) - 1e-6
        most, seen = most + ends[i + n - 1] - seen, ends[i + n - 1]
        if 2 * most < needed:
            continue
        most = common(places, len(quote), window)
        if 2 * most < needed:
            continue
        if SequenceMatcher(None, quote, window).ratio() >= least:
            return True
    return False


def first_like(pairs: DataFrame, key: str, nth: str, quote: str = "quote", text: str = "text", least: float = LEAST) -> DataFrame:
    """(key, nth): the first chunk, by nth, that is like the quote it is paired with; rows of null keys are dropped."""
    if not 0.5 <= least <= 1 or math.isnan(least):
        raise ValueError("the least ratio is between 0.5 and 1")
    bound_batches(pairs.sparkSession)
    ship(pairs.sparkSession)
    kinds = [pairs.schema[c].dataType.simpleString() for c in (key, nth)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 1]).filter(pa.array([like(q, t, least) for q, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_()))

    rows = pairs.filter(F.col(key).isNotNull()).select(key, nth, F.col(quote).cast("string"), F.col(text).cast("string"))
    return rows.mapInArrow(of, f"`{key}` {kinds[0]}, `{nth}` {kinds[1]}").groupBy(key).agg(F.min(nth).alias(nth))


def chunks_of(document: str):
    """Lines of a document of more than 40 characters, which stand for its chunks where it has none."""
    lines = F.transform(F.split(F.coalesce(F.col(document), F.lit("")), "\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.posexplode(F.filter(lines, lambda p: F.length(p) > 40)).alias("nth", "text")
