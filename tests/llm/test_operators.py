"""The other operators against plain Python, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import wave
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestor.llm import media, mixing, packing, quality, token_counts, toxicity, url_rules
from attestor.session import table

from .rows import edges, labels

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(params=["edges", "clashing", "table"])
def docs(request, spark):
    return table(spark, "/root/testdata/sf0.001", "documents") if request.param == "table" else edges(spark, request.param == "clashing")


def texts(docs) -> list[tuple]:
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


# Packing


def test_packing_round_trip(docs):
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    expected = Counter()
    for i, t in texts(docs):
        ids = np.array([*encode(t, add_special_tokens=False).ids, 1], "<u4")
        expected[i, len(ids), ids.tobytes()] += 1
    rows = packing.report(docs).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    waste = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        lacks = 0 if at & (at - 1) == 0 else 2048 - at
        assert lacks <= packing.PADDING
        waste += lacks
    assert waste <= 0.01 * sum(r["length"] for r in rows)
    # each piece has the ids at its place in some row of its document, and all places are covered once per row
    of = defaultdict(list)
    for (i, n, ids), copies in expected.items():
        of[i, n].append((ids, copies))
    covered = Counter()
    for r in rows:
        same = of[r["doc_id"], r["doc_tokens"]]
        assert any(zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for ids, _ in same)
        covered[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert covered == Counter({(i, n): n * sum(c for _, c in same) for (i, n), same in of.items()})


def test_sum_of_squares_choice():
    """The chosen level leaves the least sum of squares of all choices, with and without room for another window."""
    rng = np.random.default_rng(0)
    packer = packing.Packer(window=16)
    for _ in range(300):
        packer.count = rng.integers(0, 4, 17)
        packer.count[0] = packer.count[16] = 0
        n = int(rng.integers(1, 16))

        def cost(level: int, n: int = n) -> int:
            c = packer.count.copy()
            c[level] -= level > 0
            c[min(16, level + n)] += 1
            return int((c[1:16] ** 2).sum())

        whole = [x for x in range(1, 17 - n) if packer.count[x] > 0]
        assert cost(packer._level(n)) == min(map(cost, [0, *whole]))
        if packer.count.any():
            level = packer._level(n, may_open=False)
            assert packer.count[level] and cost(level) == min(map(cost, whole or [x for x in range(1, 16) if packer.count[x] > 0]))


@pytest.mark.parametrize("n", [200, 1000, 20_000])
def test_windows_fill_as_documents_come(n):
    """Partitions of several sizes: no document is cut for want of room, what is left open is little for the partition, and
    only that is cut at the end."""
    rng = np.random.default_rng(n)
    sizes = np.minimum(np.exp(rng.normal(6, 1.2, n)).astype(int) + 1, 30_000)
    packer = packing.Packer()
    for i, k in enumerate(sizes.tolist()):
        packer.add(i, bytes(4 * k))
    left = packer.n_open
    assert packer.forced == 0 and left <= 8 * n**0.5 and packer.placed == len(packer.done)
    assert all(sum(map(len, held)) == 2048 for held in packer.done)
    whole = Counter(p.doc for held in packer.done for p in held if p.doc_tokens <= 2048)
    assert set(whole.values()) <= {1}
    packer.close()
    assert packer.n_open == 0 and packer.placed + packer.closed == len(packer.done)
    tokens = [sum(map(len, held)) for held in packer.done]
    assert sum(tokens) == sizes.sum() and all(t & (t - 1) == 0 or 2048 - t <= packing.PADDING for t in tokens)
    assert packer.closed <= 11 * left


def test_sizes_that_never_fit_are_cut():
    """No two documents fit one window: space stays bounded."""
    packer = packing.Packer(window=64, space=4)
    for i in range(500):
        packer.add(i, np.arange(40, dtype="<u4").tobytes())
        assert packer.n_open <= 4
    assert packer.forced > 100
    packer.close()
    covered = Counter()
    for held in packer.done:
        for p in held:
            assert p.ids == np.arange(40, dtype="<u4").tobytes()[4 * p.start : 4 * (p.start + len(p))]
            covered[p.doc] += len(p)
    assert covered == Counter(dict.fromkeys(range(500), 40))


# Token counts


def test_token_counts(docs):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    expected = Counter()
    for i, t in texts(docs):
        n = len(encode(t, add_special_tokens=False).ids)
        expected[i, len(t.encode()), n, n > 1024] += 1
    rows = token_counts.report(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == expected
    for r in rows:
        same = [t for i, t in texts(docs) if i == r["doc_id"]][:1] if r["over_limit"] else []
        for t in same:  # one code point more passes the limit
            assert len(encode(t[: r["fit_chars"]], add_special_tokens=False).ids) <= 1024 < len(encode(t[: r["fit_chars"] + 1], add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["don't stop  now\n\n x 'll ve", "café 你好 \U0001f600 naïve", "a <|endoftext|> b<|endoftext|>", "   ", "it's'd 12345 !!! ...\t\t"])
def test_count_of_every_prefix(text):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    levels = token_counts.levels(token_counts.prefixes_of(public_tokenizers.path("byte_bpe_50k.json")).table(text))
    assert levels.tolist() == [len(encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_truncation_and_budget(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = Tokenizer.from_file(path).encode
    text = "several words, and don't forget 12 numbers"
    df = token_counts.prefix_tables(spark.createDataFrame([(1, text)], "doc_id long, text string"), path)
    at, fits = df.select(token_counts.count_at("prefix", F.lit(13)), token_counts.fitting(F.col("prefix"), 5)).first()
    assert at == len(encode(text[:13]).ids)
    assert fits == max(i for i in range(len(text) + 1) if len(encode(text[:i]).ids) <= 5)


# Media


def test_media_round_trip(docs):
    expected = Counter()
    for i, t in texts(docs):
        data = t.encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        expected[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    rows = media.encoded(docs).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows)
    assert got == expected
    for r in rows:
        with wave.open(BytesIO(bytes(r["media"]))) as w:
            assert hashlib.sha256(w.readframes(w.getnframes())).hexdigest() == r["payload_sha256"]
        assert r["fingerprint"] == sorted(r["fingerprint"])


def plain_codes(data: bytes) -> list[int]:
    """Frame by frame and pair by pair, without blocks or strides."""
    x = np.concatenate((np.frombuffer(data, np.uint8), np.full(media.FRAME, 128, np.uint8)))
    starts = [0, *range(media.HOP, max(0, len(data) - media.FRAME) + media.HOP, media.HOP)] if len(data) > media.FRAME else [0]
    frames = []
    for s in starts:
        frame = (x[s : s + media.FRAME].astype(np.float32) - 128) * np.hanning(media.FRAME).astype(np.float32)
        level = [int(v) for v in np.rint(16 * np.log2(1 + np.abs(np.fft.rfft(frame)[1:])))]
        bands = [level[32 * k : 32 * k + 32] for k in range(4)]
        frames.append([(max(b), 32 * k + b.index(max(b)) + 1) for k, b in enumerate(bands)])
    found = []
    for t, bands in enumerate(frames):
        for k, (power, place) in enumerate(bands):
            before = [frames[u][k][0] for u in range(max(0, t - media.AROUND), t)]
            after = [frames[u][k][0] for u in range(t + 1, min(len(frames), t + media.AROUND + 1))]
            if power > 0 and all(power > p for p in before) and all(power >= p for p in after):
                found.append((t, place))
    out = []
    for t, f in found:
        later = [(u, g) for u, g in found if u > t][: media.PARTNERS]
        out += [t << 32 | f << 16 | g << 8 | u - t for u, g in later if u - t <= media.APART]
    return sorted(out)


def test_fingerprints(spark):
    """The whole array and its digest, against a plain version."""
    rows = media.report(edges(spark)).join(media.encoded(edges(spark)).select("doc_id", "media", "payload_sha256").distinct(), ["doc_id", "payload_sha256"])
    for r in rows.filter("n_bytes < 4000").distinct().collect():
        codes = plain_codes(media.samples(bytes(r["media"])))
        assert r["fingerprint"] == codes
        assert r["feature"] == f"{len(codes)}:{hashlib.sha256(','.join(map(str, codes)).encode()).hexdigest()}"


def test_tones_are_peaks_and_shift_in_time():
    tone = lambda hz, n: (128 + 100 * np.sin(2 * np.pi * hz * np.arange(n) / media.RATE)).astype(np.uint8)
    song = np.concatenate([tone(f, 1280) for f in (500, 1500, 2500, 3500, 900)]).tobytes()
    code = media.codes(song)
    later = media.codes(b"\x80" * media.HOP * 40 + song)
    low = set((code & 0xFFFFFFFF).tolist())
    assert len(code) and len(low & set((later & 0xFFFFFFFF).tolist())) >= 0.8 * len(low)


def test_the_last_samples_are_in_a_frame():
    rng = np.random.default_rng(0)
    for n in (320, 448, 704):
        a = rng.integers(0, 256, n).astype(np.uint8)
        b = np.concatenate((a[:-64], (128 + 100 * np.sin(np.arange(64))).astype(np.uint8)))
        assert any((x.tolist() != y.tolist()) for x, y in zip(media.peaks(a.tobytes()), media.peaks(b.tobytes()), strict=True))


def test_partners_are_in_later_frames(monkeypatch):
    t, f = np.array([0, 0, 0, 0, 1, 2, 3, 90]), np.array([1, 40, 70, 100, 2, 3, 4, 5])
    monkeypatch.setattr(media, "peaks", lambda data: (t, f))
    later = lambda i: [j for j in range(len(t)) if t[j] > t[i]][: media.PARTNERS]
    expected = [int(t[i] << 32 | f[i] << 16 | f[j] << 8 | t[j] - t[i]) for i in range(len(t)) for j in later(i) if t[j] - t[i] <= media.APART]
    assert media.codes(b"").tolist() == sorted(expected)


# Quality


def plain_statistics(text: str) -> tuple:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def test_quality(docs, spark):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = quality.report(docs, labels(spark)).collect()
    assert Counter(tuple(r[c] for c in names) for r in rows) == Counter((i, *plain_statistics(t)) for i, t in texts(docs))
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(20 * x[:, 1]) + 0.2 * rng.random(2000) > 0.7).astype(float)
    trees = quality.fit(x, y, [1, -1, 0])
    for f, sign in ((0, 1), (1, -1)):
        at = np.repeat(rng.random((50, 1, 3)), 101, axis=1)
        at[:, :, f] = np.linspace(0, 1, 101)
        scores = trees.score(at.reshape(-1, 3)).reshape(50, 101)
        assert (sign * np.diff(scores, axis=1) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8


def test_quality_held_out(spark):
    marks = table(spark, SF, "labels")
    got = quality.report(table(spark, SF, "documents"), marks).join(marks, "doc_id").filter("NOT base_failed").filter(toxicity.held_out("doc_id"))
    rows = [(r["kept"], r["quality"] == 1) for r in got.collect()]
    assert sum(a == b for a, b in rows) >= 0.75 * len(rows)


# Toxicity


def test_toxicity_held_out(spark):
    marks = table(spark, SF, "labels")
    got = toxicity.report(table(spark, SF, "documents"), marks).join(marks, "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert right >= 0.9 * len(got)


def test_toxicity_edges(docs, spark):
    rows = toxicity.report(docs, labels(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in texts(docs))
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    kept = toxicity.kept(docs, labels(spark))
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs, marks = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    turned = marks.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda m: {r["doc_id"]: r["score"] for r in toxicity.report(docs, m).collect()}
    assert score(marks) == score(turned)


def test_samples_bound_rows(spark, monkeypatch):
    """However rows spread over ids, no more than the bounds are collected; null ids are sampled like others."""
    monkeypatch.setattr(toxicity, "POSITIVES", 50)
    monkeypatch.setattr(toxicity, "UNLABELLED", 120)
    monkeypatch.setattr(quality, "SAMPLE", 70)
    keep = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:20]
    docs = [(keep[i % 20], f"bad text {i}") for i in range(6000)] + [(None, f"no id {i}") for i in range(3000)] + [(keep[0], "the same")] * 3000
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, int(i in keep[:10])) for i in keep], "doc_id long, quality int, toxic int")
    rows = toxicity.sample(docs, marks, "doc_id", "text")[0].collect()
    n = Counter(r["positive"] for r in rows)
    assert n == {True: 50, False: 120} and len(set(rows)) == 170
    assert sum("no id" in r["text"] for r in rows) > 20
    assert sorted(rows) == sorted(toxicity.sample(docs.repartition(5), marks, "doc_id", "text")[0].collect())
    sizes, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, signs: sizes.append(len(y)) or fit(x, y, signs))
    quality.report(docs, marks)
    assert sizes == [70] or len(sizes) == 1 and sizes[0] <= 70


def plain_fit(rows: list[tuple[bool, list[int]]], n: int, prior: float, steps: int = 400) -> tuple[list[float], float]:
    """The non-negative risk row by row, with the same optimiser."""
    import math

    w, m, v = [0.0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1)
    w[n] = math.log(prior / (1 - prior))
    pos, unl = [f for p, f in rows if p], [f for p, f in rows if not p]
    for t in range(1, steps + 1):
        margin = lambda f: sum(w[j] for j in f) + w[n]  # noqa: B023, E731
        negative = sum(math.log1p(math.exp(margin(f))) for f in unl) / len(unl) - prior * sum(math.log1p(math.exp(margin(f))) for f in pos) / len(pos)
        grad = [3e-4 * x for x in w[:n]] + [0.0]
        sign = -1 if negative < 0 else 1
        for f, positive in [(f, True) for f in pos] + [(f, False) for f in unl]:
            up = 1 / (1 + math.exp(-margin(f)))
            slope = sign * (-prior * up / len(pos) if positive else up / len(unl))
            if positive and sign > 0:
                slope += prior * (up - 1) / len(pos)
            for j in [*f, n]:
                grad[j] += slope
        for j in range(n + 1):
            m[j] = 0.9 * m[j] + 0.1 * grad[j]
            v[j] = 0.999 * v[j] + 0.001 * grad[j] ** 2
            w[j] -= 0.05 * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return w[:n], w[n]


def test_risk_against_plain_python():
    """Weights of the vectorised estimator; the second sample drives the negative part below zero."""
    rng = np.random.default_rng(3)
    for share in (0.2, 0.9):
        rows = [(bool(rng.random() < 0.4), sorted(rng.choice(6, 3, replace=False).tolist())) for _ in range(40)]
        rows = [(p, [0, *f[1:]] if p else f) for p, f in rows]
        weights, bias = toxicity.fit(rows, 6, share, steps=60)
        expected, expected_bias = plain_fit(rows, 6, share, steps=60)
        assert np.allclose(weights, expected, atol=1e-6) and abs(bias - expected_bias) < 1e-6


def test_scores_against_plain_python(spark):
    """Every document's score is the logistic sum of the weights of the features it has."""
    docs, marks = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    index, weights, bias = toxicity.train(docs, marks)
    names = {f: weights[i] for f, i in index.items() if i >= 0}
    got = {r["doc_id"]: r["score"] for r in toxicity.report(docs, marks).collect()}
    for i, t in texts(docs):
        g = bias + sum(names.get(f, 0.0) for f in toxicity.features(t))
        assert abs(got[i] - 1 / (1 + np.exp(-g))) < 1e-9


def test_kept_against_plain_trees(spark):
    """Each verdict by walking the trees node by node."""
    docs, marks = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    stats = quality.described(docs).cache()
    trees = quality.train(stats, marks)
    kept = {r["doc_id"]: r["kept"] for r in quality.report(docs, marks).collect()}
    pdf = stats.toPandas()
    for i, x, failed in zip(pdf["doc_id"], quality.matrix(pdf), (pdf["n_words"] < 10) | (100 * pdf["n_repeat_words"] > 20 * pdf["n_words"]), strict=True):
        margin = trees.base
        for t in range(len(trees.feature)):
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + (2 if x[trees.feature[t, node]] > trees.threshold[t, node] else 1)
            margin += trees.leaf[t, node - (2**quality.DEPTH - 1)]
        assert kept[i] == (not failed and margin >= 0)


# Mixing


def plain_targets(sizes: dict[str, int]) -> dict[str, float]:
    """Targets by raising what stands under its cap until nothing is above it."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    fixed: dict[str, float] = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = sum(w for s, w in weight.items() if s not in fixed)
        now = {s: rest * w / free for s, w in weight.items() if s not in fixed}
        over = {s: 3.0 * sizes[s] for s, x in now.items() if x > 3 * sizes[s]}
        if not over:
            return fixed | now
        fixed |= over


def test_mixing(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes["z" if r["source"] is None else "s" + r["source"]] += len(WORD.findall(r["text"] or ""))
    targets = plain_targets(dict(sizes))
    got = mixing.report(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in rows)
    taken, source = defaultdict(int), {str(r["doc_id"]): "z" if r["source"] is None else "s" + r["source"] for r in rows if r["doc_id"] is not None}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["doc_id"] is not None:
            s = source[str(r["doc_id"])]
            assert r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-6 * max(1, targets[s])
        taken[r["target"], r["source_size"]] += r["taken"]
    for (target, _), n in taken.items():
        assert abs(n - target) <= 1
    assert Counter(map(tuple, mixing.report(docs.repartition(7)).collect())) == Counter(map(tuple, got))


def test_reruns_agree(spark):
    """Null ids, repeated ids and a crowd of copies, in any order and number of partitions."""
    rows = [(None if i % 2 else i, f"{'word ' * (i % 40 + 1)}{i}", "ab"[i % 3 == 0]) for i in range(300)] + [(5, "the same text " * 9, "b")] * 12_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bag = lambda d: Counter(map(tuple, d.collect()))
    got = bag(mixing.report(docs))
    assert sum(got.values()) == len(rows)
    assert got == bag(mixing.report(docs.repartition(7))) == bag(mixing.report(docs.orderBy(F.desc("text"))))
    taken = defaultdict(int)
    for (_, _, size, target, n), times in got.items():
        taken[size, target] += n * times
    assert all(abs(n - target) <= 1 for (_, target), n in taken.items())
    mixed = bag(mixing.mixed(docs))
    assert mixed == bag(mixing.mixed(docs.repartition(7)))
    words = Counter()
    for (_, text, s), n in mixed.items():
        words[s] += n * len(text.split())
    wanted = {r["target"] for r in mixing.report(docs).select("target").distinct().collect()}
    for n in words.values():  # each source is within one document of its target
        assert min(abs(n - w) for w in wanted) <= 41


def test_mixed_rows(docs):
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    times = Counter(str(r["doc_id"]) for r in got.collect())
    rows = Counter(str(r["doc_id"]) for r in docs.collect())
    assert all(n <= 3 * rows[i] for i, n in times.items())


# URL rules

LIST = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org", "https://a.Example.org/es/x?q=1", "http://example.org/en/12", "http://example.org/en/2",
    "x://y.com/fr/", "x://y.com/fr", "x://com/de/a#b", "x://notcom/de/", "x://best-casino.net/a", "x://casinos.net/", "x://a.b?c://d/e",
    "x://xxx.org/", "x://adult.com/fr/y", "x://adult.com/de/y", "a\nb://porn.io", "ftp://example.org:80/es/", "x://a.com//fr/",
]


def plain_rule(url: str | None) -> tuple:
    rest = (url or "").partition("://")[2]
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
    fits = []
    for rule, verdict in LIST.items():
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and m[2].startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    _, rule, verdict = max(fits, default=(0, None, None))
    bad = not host or any(w in re.split("[^a-z0-9]", host) for w in url_rules.BLOCKED_WORDS)
    return host, m[2], rule, verdict or ("block" if bad else "allow")


def test_url_rules(spark):
    rows = [*enumerate(URLS), (None, "x://y.com/fr/"), (0, None), (0, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS token", "'y' AS _row", "'z' AS pattern")
    assert Counter(map(tuple, url_rules.report(pages).collect())) == Counter((i, *plain_rule(u)) for i, u in rows)
    few = url_rules.judged(pages).agg(F.max("candidates")).first()[0]
    assert few < len(url_rules.RULES)  # only rules that a token fetches run


def test_patterns():
    """Which URLs a pattern matches and which tokens it is sure of."""
    import re as regex

    cases = {
        "/ads/": (("ads",), ["a.b/ads/", "a.b/x/ads/y"], ["a.b/ads", "a.b/bads/"]),
        "/wp-login.php|": (("wp", "login", "php"), ["a/wp-login.php"], ["a/wp-login.php5"]),
        "||shop.": (("shop",), ["shop.de/", "x.shop.de/"], ["myshop.de/", "a/shop.de"]),
        "||pills^": (("pills",), ["pills/", "a.pills"], ["pills.com/"]),
        "/track/*/pixel.": (("track", "pixel"), ["a/track/1/2/pixel.gif"], ["a/track/pixel.gif"]),
        "ban": ((), ["urban/"], ["a/"]), "|a.b/*x": (("a", "b"), ["a.b/cx"], ["c.a.b/x"]), "^aff^": (("aff",), ["x/aff", "x/aff/"], ["x/affe", "aff/"]),
    }
    for pattern, (literals, fit, miss) in cases.items():
        rule = url_rules.pattern_rule(pattern)
        assert rule.literals == literals
        assert all(regex.search(rule.pattern, u) for u in fit) and not any(regex.search(rule.pattern, u) for u in miss)


@pytest.mark.parametrize("broadcast", [True, False])
def test_ten_thousand_rules(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_rules, "BROADCAST", 100)
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(60)]
    pick = lambda: words[int(rng.zipf(1.3)) % len(words)]
    forms = [lambda: f"/{pick()}/", lambda: f"||{pick()}.{pick()}^", lambda: f"/{pick()}/*/{pick()}^", lambda: f"^{pick()}-{pick()}^", lambda: f"/{pick()}.{pick()}|", lambda: f"|{pick()}.{pick()}/{pick()}*"]
    rules = [url_rules.pattern_rule(forms[i % 6]()) for i in range(10_000)]
    rules += [url_rules.list_rule("allow", f"{pick()}.{pick()}/{pick()}/") for _ in range(200)]
    urls = [f"http://{pick()}.{pick()}/{pick()}/{pick()}-{pick()}/{pick()}.{pick()}" for _ in range(150)]
    got = {r["page_id"]: r for r in url_rules.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    compiled = [(re.compile(r.pattern), r) for r in rules]
    for i, u in enumerate(urls):
        place = u.removeprefix("http://")
        fits = [r for c, r in compiled if c.search(place)]
        named = max(((len(r.name), r.name, r.verdict) for r in fits if r.name), default=None)
        assert got[i]["rule"] == (named and named[1])
        assert got[i]["verdict"] == (named[2] if named else "block" if any(not r.name for r in fits) else "allow")
    assert sum(r["candidates"] for r in got.values()) < 0.2 * len(urls) * len(rules)


def test_empty_tables(spark):
    none, marks = edges(spark).filter("false"), labels(spark)
    for out in (packing.report(none), token_counts.report(none), media.report(none), mixing.report(none), mixing.mixed(none),
                quality.report(none, marks), toxicity.report(none, marks), toxicity.kept(none, marks.filter("false"))):
        assert out.count() == 0
    assert url_rules.report(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert toxicity.report(edges(spark), marks.filter("false")).filter("score > 0").count() == 0
    assert quality.report(edges(spark), marks.filter("false")).count() == edges(spark).count()
