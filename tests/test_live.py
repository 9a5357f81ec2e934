"""Streams against batches, limits against a plain fold, stores run twice."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from attestor.session import table
from attestor.sources import stores
from attestor.streaming import checkpoints, counters

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    """Files in the order of their events, a gap of a day among them; the stream's newest rows are the batch's."""
    events = table(spark, SF, "events").orderBy("ts", "event_id").collect()
    schema = table(spark, SF, "events").schema
    step = -(-len(events) // 4)
    for i in range(4):
        spark.createDataFrame(events[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # started again, it finds nothing new and changes nothing
        counters.follow(spark, str(tmp_path / "in"), schema, check, out, files=100).awaitTermination()
    names = ["user_id", "events", "errors", "value", "first", "last", "state"]
    rows = lambda df: Counter(tuple(r[c] for c in names) for r in df.collect())
    batch = table(spark, SF, "events")
    assert rows(counters.latest(spark, out)) == rows(counters.counters(batch))
    assert counters.lives(batch).count() > counters.counters(batch).count()


def test_events_in_any_order(spark, tmp_path):
    """Events that arrive up to 23 hours late, also between two lives, which they join: still the batch's rows."""
    rng, start = random.Random(11), dt.datetime(2024, 1, 1)
    rows = []
    for user in range(25):
        at = 0.0
        for i in range(rng.randrange(4, 25)):
            at += rng.choice((0.5, 5, 13, 23.5, 24, 25, 40))
            rows.append((start + dt.timedelta(hours=at), user, user * 100 + i, rng.choice(("view", "error", "purchase")), rng.choice((None, 1.5, 2.25))))
        # far apart, and joined by one that lies between them
        rows += [(start + dt.timedelta(hours=h), user, user * 100 + 50 + k, "view", 1.0) for k, h in enumerate((700, 746, 723))]
    schema = "ts timestamp, user_id long, event_id long, event_type string, value double"
    arrival = sorted(rows, key=lambda r: (r[0] + dt.timedelta(hours=rng.uniform(0, 23)), r[2]))
    step = -(-len(arrival) // 12)
    for i in range(12):
        spark.createDataFrame(arrival[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        (tmp_path / "in").touch()
    out = str(tmp_path / "out")
    counters.follow(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, str(tmp_path / "check"), out).awaitTermination()
    names = ["user_id", "events", "errors", "value", "first", "last", "state"]
    got = {r["user_id"]: tuple(r[c] for c in names[1:]) for r in counters.latest(spark, out).collect()}
    want = {r["user_id"]: tuple(r[c] if c != "value" else r[c] or 0.0 for c in names[1:]) for r in counters.counters(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
    assert counters.lives(spark.createDataFrame(rows, schema)).count() > 60


def test_progress_of_a_stream(spark, tmp_path):
    """Reports in files, begun again halfway: the state is that of all reports, and what is left is what no report ended."""
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(12)
    rows = [(rng.choice(["s1", "s2", None]), f"c{rng.randrange(6)}", rng.choice(["RUNNING", "COMPLETED", "FAILED"]), start + dt.timedelta(minutes=rng.randrange(90))) for _ in range(120)]
    schema = spark.createDataFrame([], "session string, control string, status string, at timestamp").schema
    for i in range(0, 120, 40):
        spark.createDataFrame(rows[i : i + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        checkpoints.follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "check"), str(tmp_path / "out")).awaitTermination()
    got = {(r["session"], r["control"]): (r["status"], r["at"], r["reports"]) for r in checkpoints.state(spark, str(tmp_path / "out")).collect()}
    want = {}
    for s, c, status, at in rows:
        if s:
            old = want.get((s, c), (at, status, 0))
            want[s, c] = (*max(old[:2], (at, status)), old[2] + 1)
    assert got == {k: (status, at, n) for k, (at, status, n) in want.items()}
    work = spark.createDataFrame([("s1", f"c{i}") for i in range(8)] + [("s1", "c0"), ("s3", "c0")], "session string, control string")
    progress = checkpoints.state(spark, str(tmp_path / "out"))
    ended = {c for (s, c), (_, status, _) in want.items() if s == "s1" and status != "RUNNING"}
    left = sorted(map(tuple, checkpoints.remaining(work, progress).collect()))
    assert left == sorted([("s1", f"c{i}") for i in range(8) if f"c{i}" not in ended] + [("s3", "c0")])
    states = {r["session"]: (r["total"], r["done"], r["state"]) for r in checkpoints.sessions(work, progress).collect()}
    assert states == {"s1": (8, len(ended), "STARTED"), "s3": (1, 0, "WAITING")}


def test_named_scopes_without_rows_are_emptied(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "n long, file string, report string"
    stores.replace_scope(spark.createDataFrame([(1, "a b", "x"), (2, "b", "y"), (3, "c=d", "y"), (4, None, "y")], schema), path, ["file", "report"])
    named = spark.createDataFrame([("a b", "x"), ("c=d", "y"), (None, "y"), ("b", "z")], "file string, report string")
    for _ in range(2):
        stores.replace_scope(spark.createDataFrame([(5, "a b", "x")], schema), path, ["file", "report"], named)
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [2, 5]


def test_a_batch_written_again_changes_nothing(spark, tmp_path):
    rows = counters.counters(table(spark, SF, "events"))
    path = f"{tmp_path}/out/batch=000000003"
    rows.write.mode("overwrite").parquet(path)
    before = Counter(map(tuple, counters.latest(spark, f"{tmp_path}/out").collect()))
    rows.write.mode("overwrite").parquet(path)
    assert Counter(map(tuple, counters.latest(spark, f"{tmp_path}/out").collect())) == before


def test_refused_attempts_do_not_count(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), start + dt.timedelta(seconds=rng.randrange(900))) for _ in range(400)] + [("c", start)] * 9
    df = spark.createDataFrame(rows, "ip string, ts timestamp").repartition(5)
    got = Counter(map(tuple, counters.limited(df, "ip", "ts").collect()))
    expected = Counter()
    for ip in ("a", "b", "c", None):
        passed: list[dt.datetime] = []
        for t in sorted(t for i, t in rows if i == ip):
            passed = [p for p in passed if (t - p).total_seconds() < 60]
            ok = len(passed) < 5
            expected[ip, t, ok] += 1
            if ok:
                passed.append(t)
    assert got == expected


def test_inserting_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\0b"), (2, None), (2, None)], "k long, v string")
    for _ in range(2):
        stores.insert(rows, f"{tmp_path}/t", ["k"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect())) == [(1, "ab"), (2, None)]


def test_other_scopes_stay(spark, tmp_path):
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "n long, file string, report string")
    stores.replace_scope(first, f"{tmp_path}/t", ["file", "report"])
    stores.replace_scope(spark.createDataFrame([(3, "a", "x")], first.schema), f"{tmp_path}/t", ["file", "report"])
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [2, 3]


def test_import_knows_blanks(spark, tmp_path):
    """A missing value in a file is an empty text; a stored null isn't."""
    known = spark.createDataFrame([("c", ""), ("d", None)], "control string, note string")
    stores.export_json(spark.createDataFrame([("c", None), ("d", None), ("d", None), ("e", "n")], known.schema), f"{tmp_path}/j")
    assert sorted(map(tuple, stores.imported(known, f"{tmp_path}/j", ["control", "note"]).collect())) == [("d", ""), ("e", "n")]


def test_knowledge_without_a_file(spark, tmp_path):
    assert stores.knowledge(spark, f"{tmp_path}/none.json", "a string").count() == 0


def test_purged(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 3, 1),), (None,)], "ts timestamp")
    assert stores.purged(rows, "ts", F.expr("TIMESTAMP '2024-03-02 00:00:00'"), 30).count() == 1
