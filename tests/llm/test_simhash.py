"""Fingerprints and components against plain Python over all pairs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from attestor.llm import near_copies, simhash
from attestor.session import table

from .rows import edges


def plain(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows: list[tuple]) -> dict[int, int | None]:
    """The smallest id of each fingerprint's component, over all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def of(f: int) -> int:
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[of(a)] = of(b)
    least: dict[int, int | None] = {}
    for i, f in rows:
        now = least.get(of(f))
        least[of(f)] = i if now is None else now if i is None else min(now, i)
    return {f: least[of(f)] for f in fps}


@pytest.mark.parametrize("which", ["edges", "clashing", "table"])
def test_classes(spark, which):
    docs = table(spark, "/root/testdata/sf0.001", "documents") if which == "table" else edges(spark, which == "clashing")
    rows = [(r["doc_id"], plain(r["text"])) for r in docs.collect()]
    least = groups(rows)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.report(docs).collect())
    assert got == Counter((i, f"{f:016x}", least[f]) for i, f in rows)


@pytest.mark.parametrize("scheme", [(2, 2), (3, 2), (3, 3)])
def test_links_lose_nothing(spark, scheme):
    """With keys of each width. Random clusters, among them one larger than the groups that are compared lag by lag."""
    rng = random.Random(1)
    fps = set()
    for size in (2, 3, 10, 120):
        now = rng.getrandbits(64)
        for _ in range(size):
            fps.add(now)
            now ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 4))))
    fps |= {rng.getrandbits(64) for _ in range(500)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges_ = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, scheme=scheme).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges_)
    root = {f: f for f in fps}

    def of(f: int) -> int:
        while root[f] != f:
            f = root[f]
        return f

    for a, b in edges_:
        root[of(a)] = of(b)
    expected = groups(rows)
    for f in fps:
        for g in fps:
            assert (of(f) == of(g)) == (expected[f] == expected[g])


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def survivors(rows: list[tuple]) -> Counter:
    """(id, text) of the row that stays for each group, over all pairs of texts."""
    sets = {}
    for _, t in rows:
        sets.setdefault(shingles(t), len(sets))
    distinct = list(sets)
    root = list(range(len(distinct)))

    def of(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(distinct):
        for j in range(i):
            both = len(a & distinct[j])
            if both >= 0.8 * (len(a) + len(distinct[j]) - both) and both:
                root[of(i)] = of(j)
    least: dict[int, tuple] = {}
    for i, t in rows:
        g = of(sets[shingles(t)])
        key = (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest())
        least[g] = min(least.get(g, key), key)
    return Counter((None if k[0] else k[1], k[2]) for k in least.values())


@pytest.mark.parametrize("which", ["edges", "table"])
def test_one_of_each_group_stays(spark, which):
    docs = table(spark, "/root/testdata/sf0.001", "documents") if which == "table" else edges(spark, clashing=True)
    got = near_copies.deduplicated(docs)
    assert got.columns == docs.columns
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    assert Counter((r["doc_id"], digest(r["text"])) for r in got.collect()) == survivors([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_rows_of_one_id_are_judged_apart(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in "abc"]
    docs = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (8, texts[2]), (None, texts[2]), (None, texts[0] + " more"), (None, "alone")], "doc_id long, text string")
    assert Counter(map(tuple, near_copies.deduplicated(docs).collect())) == Counter([(7, texts[0]), (7, texts[1]), (8, texts[2]), (None, "alone")])


def test_near_copies_are_caught(spark):
    """Copies of similarity 0.8 to 0.95, of long and short texts, and a crowd of copies of one text."""
    rng = random.Random(2)
    rows, pairs = [], 0
    for n in (40, 100, 400, 2000):
        for _ in range(25):
            w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = list(w)
            for i in rng.sample(range(n), max(1, round(n * rng.uniform(0.005, 0.02)))):
                other[i] = f"x{rng.randrange(10**6)}"
            a, b = shingles(" ".join(w)), shingles(" ".join(other))
            pairs += len(a & b) / len(a | b) >= 0.8
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(other))]
    w = [f"c{i}" for i in range(300)]
    for k in range(400):
        rows.append((len(rows), " ".join(w[:k] + ["odd"] + w[k + 1 :]) if k < 300 else " ".join(w) + f" {k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs > 60
    kept = Counter(r["doc_id"] for r in near_copies.deduplicated(docs).collect())
    assert kept == Counter(i for i, _ in survivors(rows).elements())


def family_rows(families: int, own: int = 56, shared: int = 400, edit: int = 12) -> list[tuple[int, str]]:
    """Pages that share a passage and have words of their own, each with one edited copy of similarity above 0.8; pages of unlike
    families stay below it."""
    rng, rows = random.Random(families), []
    passage = [f"p{i}" for i in range(shared)]
    for k in range(families):
        mine = [f"f{k}w{i}" for i in range(own)]
        other = list(mine)
        for i in rng.sample(range(own), 1 + k % edit // 4):
            other[i] = f"f{k}e{i}"
        rows += [(2 * k, " ".join(passage + mine)), (2 * k + 1, " ".join(passage + other))]
    return rows


@pytest.mark.parametrize(("families", "own"), [(20, 56), (33, 56), (120, 56), (120, 50), (2000, 56)])
def test_pages_with_a_shared_passage(spark, families, own):
    """Blocks far larger than those that are compared whole: every copy is found, and no unlike page goes."""
    rows = family_rows(families, own)
    sets = [shingles(t) for _, t in rows]
    like = lambda a, b: len(a & b) / len(a | b)
    assert all(like(sets[i], sets[i + 1]) >= 0.8 for i in range(0, len(sets), 2))
    assert like(sets[0], sets[2]) < 0.8
    kept = [r["doc_id"] for r in near_copies.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()]
    assert sorted(kept) == [2 * k for k in range(families)]


@pytest.mark.parametrize("volume", [near_copies.VOLUME, 20_000])
def test_crowd_of_edited_copies(spark, monkeypatch, volume):
    """Hundreds of copies of one page, each edited in places of its own so that many are below 0.8 to each other, among
    pages of the same passage: groups are those of all pairs, also where their keys are dealt to several tiles."""
    monkeypatch.setattr(near_copies, "VOLUME", volume)
    monkeypatch.setattr(near_copies, "PIVOTS", 1)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for k in range(400):
        w = list(base)
        for i in rng.sample(range(300), rng.choice((1, 3, 6, 9, 14))):
            w[i] = f"x{k}y{i}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:220] + [f"z{k}q{i}" for i in range(60)]) for k in range(60)]
    rows = list(enumerate(texts))
    kept = Counter(r["doc_id"] for r in near_copies.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert kept == Counter(i for i, _ in survivors(rows).elements())


def test_empty_table(spark):
    none = edges(spark).filter("false")
    assert simhash.report(none).count() == near_copies.deduplicated(none).count() == 0
