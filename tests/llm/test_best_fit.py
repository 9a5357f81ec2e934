"""Best-fit packing: ids against the tokenizer, exact round trips, and steps of the search against all exchanges."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestor.llm import best_fit
from attestor.llm.byte_ids import ByteIds
from attestor.session import table

from .rows import TEXTS, edges

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a  b", "a   b", "a\nb", "a\n\nb", "a \nb", "a\n b", " a", "a ", "\na", "a\n", "\n", " ", "a\tb c", "a b", "a  b", "don't we'll I'M 'tis x's, y's.", "word... (word) [w]! 'q'", "été, Straße; naïve.",
    "你好 世界, ok", "𞤀𞤣 a𞤀,", "Ԁԁ, x", "\0 a\0b", "áb, é.", "<|endoftext|> a", "a <|endoftext|>b", "x" * 500 + " " + "y" * 70 + ",", "\x1c a\x1cb", "1234 5,678.90 3rd", "tail'' ''' ,' '", "A.\nB,\nC d.\nE",
]


def test_ids():
    """Twice, so that what is remembered is tested too."""
    tokenizer, ids = Tokenizer.from_file(PATH), ByteIds(PATH)
    texts = [t or "" for t in TEXTS] + ODD + [f"{a} {b}\n{c}" for a in ODD[:12] for b in ODD[14:24] for c in ODD[5:30:4]]
    expected = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for _ in range(2):
        assert list(ids(texts)) == expected


@pytest.mark.parametrize("which", ["edges", "clashing", "table", "groups"])
def test_round_trip(spark, which):
    docs = edges(spark, which == "clashing") if which in ("edges", "clashing") else table(spark, "/root/testdata/sf0.001", "documents")
    encode = Tokenizer.from_file(PATH).encode
    pieces, total = Counter(), 0
    for r in docs.collect():
        ids = np.array([*encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, len(ids)] if len(ids) <= 2048 else [0, *range(first, len(ids) + 1, 2048)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[r["doc_id"], k, i, j - i, zlib.crc32(ids[i:j].tobytes())] += 1
        total += len(ids)
    rows = (best_fit.packed(docs, PATH, group=30) if which == "groups" else best_fit.report(docs)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(total / 2048) + (3 if which == "groups" else 1)


def test_empty_table(spark):
    assert best_fit.report(edges(spark).filter("false")).count() == 0


def gains(bins: list[list[int]], donor: int, window: int) -> int:
    """The most by which one exchange of the kinds allowed raises the sum of squares, over all of them."""
    best = 0
    outs = [(x,) for x in bins[donor]] + list(combinations(bins[donor], 2))
    for i, other in enumerate(bins):
        if i == donor or not other:
            continue
        backs = [(), *[(y,) for y in other], *combinations(other, 2)]
        for out in outs:
            for back in backs:
                if len(out) + len(back) > 3 or len(out) == 2 and not back:
                    continue
                d = sum(out) - sum(back)
                if d > 0 and sum(other) + d <= window:
                    best = max(best, d * (sum(other) - sum(bins[donor]) + d))
    return best


def test_steps_against_all_exchanges():
    """A donor has a step as long as any exchange raises the sum of squares, and every step raises it."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        window = int(rng.integers(20, 60))
        bins = best_fit.best_fit(rng.integers(1, window, int(rng.integers(4, 30))).tolist(), window)
        search = best_fit.Search(bins, window)
        for _ in range(40):
            donor = int(rng.integers(len(bins)))
            if not search.fill[donor]:
                continue
            before, possible = int((search.fill**2).sum()), gains(search.bins, donor, window)
            assert search.step(donor) == (possible > 0)
            assert int((search.fill**2).sum()) > before if possible else int((search.fill**2).sum()) == before
            assert search.fill.max() <= window and [sum(b) for b in search.bins] == search.fill.tolist()
        assert Counter(x for b in search.bins for x in b) == Counter(x for b in bins for x in b)


def fewest(sizes: tuple[int, ...], window: int) -> int:
    """The least number of bins, by trying all."""
    best = len(sizes)

    def put(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in {v: k for k, v in enumerate(bins) if v + sizes[i] <= window}.values():
            bins[b] += sizes[i]
            put(i + 1, bins)
            bins[b] -= sizes[i]
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best


def test_near_the_fewest_bins():
    """Small cases against all packings: never more than one bin above the least, seldom above it, and never above best fit alone."""
    rng, better, over = np.random.default_rng(5), 0, 0
    for _ in range(80):
        sizes = tuple(sorted(rng.integers(15, 50, 10).tolist(), reverse=True))
        least, plain, found = fewest(sizes, 100), len(best_fit.best_fit(list(sizes), 100)), len(best_fit.packed_sizes(list(sizes), 100))
        assert least <= found <= min(plain, least + 1)
        over += found - least
        better += plain - found
    assert over <= 12 and better >= 0


def test_search_empties_bins():
    rng = np.random.default_rng(6)
    sizes = rng.integers(300, 700, 1000).tolist()
    plain, found = len(best_fit.best_fit(sizes)), best_fit.packed_sizes(sizes)
    assert len(found) <= plain - 8 and sorted(x for b in found for x in b) == sorted(sizes) and max(map(sum, found)) <= 2048
    assert len(best_fit.packed_sizes([1100] * 3000)) == 3000
    assert len(best_fit.packed_sizes([1] * 5000 + [2047] * 3)) == math.ceil((5000 + 3 * 2047) / 2048)
    assert best_fit.packed_sizes([]) == []
