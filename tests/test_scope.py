"""Merged tables against the rule over whole reports, and scope detection on single documents."""

from __future__ import annotations

from collections import Counter

import pytest

from attestor.operators import merging, scoping
from attestor.plans import scope
from attestor.session import table


def whole(rows: list[dict]) -> list[tuple]:
    """The rule over a whole report, without blocks: each row against all findings so far."""
    out: list[dict] = []
    norm = lambda t: " ".join((t or "").lower().split()).strip(" .,;:")
    for r in sorted(rows, key=lambda r: r["nth"]):
        f = dict(r) | {"rows": [r["nth"]]}
        near = [
            g for g in out
            if g["table"] != f["table"] and g["severity"] == f["severity"] and (g["score"] is None or f["score"] is None or g["score"] == f["score"])
            and (not g["target"] or not f["target"] or g["target"].lower() == f["target"].lower())
        ]
        a = norm(f["title"])
        exact = [g for g in near if a and norm(g["title"]) == a]
        cut = [g for g in near if a and (b := norm(g["title"])) and (a == b or len(a) >= 20 and b.startswith(a) or len(b) >= 20 and a.startswith(b))]
        into = exact[0] if len(exact) == 1 else cut[0] if not exact and len(cut) == 1 else None
        if into is None:
            out.append(f)
            continue
        into["title"] = f["title"] if len(f["title"] or "") > len(into["title"] or "") else into["title"]
        into["target"] = into["target"] or f["target"]
        into["score"] = f["score"] if into["score"] is None else into["score"]
        into["remediation"] = into["remediation"] or f["remediation"]
        into["cves"] = list(dict.fromkeys(into["cves"] + f["cves"]))
        into["evidence"] += "\n\n" + f["evidence"].split("\n\n", 1)[-1]
        into["rows"].append(r["nth"])
    return [(f["report"], f["title"], f["severity"], f["score"], f["target"], f["remediation"], tuple(f["cves"]), f["evidence"], tuple(f["rows"])) for f in out]


def test_merged_as_over_whole_reports(spark):
    rows = scope.report_rows(lambda n: table(spark, "/root/testdata/sf0.001", n))
    reports: dict[int, list[dict]] = {}
    for r in rows.collect():
        reports.setdefault(r["report"], []).append(r.asDict())
    # orders have few rows, so some are put together to a report of hundreds
    large = [r | {"report": -1, "nth": i} for i, r in enumerate(r for k in sorted(reports)[:60] for r in reports[k])]
    df = rows.unionByName(spark.createDataFrame(large, rows.schema))
    expected = Counter(f for rs in [*reports.values(), large] for f in whole(rs))
    got = merging.merged(df).collect()
    assert Counter((r["report"], r["title"], r["severity"], r["score"], r["target"], r["remediation"], tuple(r["cves"]), r["evidence"], tuple(r["rows"])) for r in got) == expected
    assert sum(len(r["rows"]) > 1 for r in got) > 100


ROW = {"report": 1, "table": "a", "title": "A title that is long enough to cut", "severity": "HIGH", "score": None, "target": None, "remediation": None, "cves": [], "evidence": "e"}
SCHEMA = "report long, nth long, `table` string, title string, severity string, score double, target string, remediation string, cves array<string>, evidence string, extra string"


@pytest.mark.parametrize(("changes", "n"), [
    (({}, {"table": "b"}), 1), (({}, {}), 2), (({}, {"table": "b", "title": "A title that is long "}), 1), (({}, {"table": "b", "title": "A title that is"}), 2), (({"score": 5.0}, {"table": "b", "score": 7.0}), 2),
    (({"target": "h1"}, {"table": "b", "target": "H1"}), 1), (({"target": "h1"}, {"table": "b", "target": "h2"}), 2), (({}, {"table": "b", "severity": "LOW"}), 2), (({"title": None}, {"table": "b", "title": None}), 2),
    (({"title": "A title that is long enough one"}, {"title": "A title that is long enough two"}, {"table": "b", "title": "A title that is long enough"}), 3), (({"title": "Weak"}, {"table": "b", "title": "weak."}), 1),
    (({"title": "A title that is long enough"}, {"title": "A title that is long enough two"}, {"table": "b", "title": "A title that is long enough"}), 2), (({"cves": None}, {"table": "b", "cves": None, "evidence": None}), 1),
])
def test_pairs(spark, changes, n):
    df = spark.createDataFrame([tuple((ROW | c | {"nth": i, "extra": "x"}).get(k.split(" ")[0].strip("`")) for k in SCHEMA.split(", ")) for i, c in enumerate(changes)], SCHEMA)
    assert merging.merged(df).count() == n
    assert merging.merged(df.filter("false")).count() == 0


def test_kinds(spark):
    docs = spark.createDataFrame([
        (1, "An agenda, no nda", [1.0, 0.0]), (2, "The agenda", [0.0, 1.0]), (3, None, None), (4, "x" * 6000 + " security policy", None), (5, "our Security Policy", None), (6, "antimalwares", None), (6, "antimalwares", None),
    ], "id long, text string, vector array<double>")
    signals = spark.createDataFrame([("People", "NDA"), ("Tech", "malware"), ("Tech", "malware"), ("Other", None)], "kind string, keyword string")
    described = spark.createDataFrame([("Access", [0.9, 0.1]), ("Access", [0.9, 0.1])], "kind string, vector array<double>")
    got = sorted(map(tuple, scoping.kinds(docs, signals, described, ("security policy",), ("People", "Risk")).collect()))
    every = [("People", "all"), ("Risk", "all"), ("Tech", "all")]
    assert got == sorted([(1, "People", "keyword"), (1, "Access", "likeness"), *[(i, *x) for i in (2, 3, 4) for x in every], (5, "People", "umbrella"), (5, "Risk", "umbrella"), (6, "Tech", "keyword")])
    mapping = spark.createDataFrame([("People", "6.1"), ("People", "6.1"), ("Tech", "8.7"), ("Risk", "6.1")], "kind string, control string")
    assert sorted(map(tuple, scoping.controls(scoping.kinds(docs, signals), mapping).filter("id in (1, 2)").collect())) == [(1, "6.1"), (2, "6.1"), (2, "8.7")]
    assert scoping.kinds(docs.filter("false"), signals).count() == 0
    many = spark.range(scoping.MOST + 1).selectExpr("'K' AS kind", "CAST(id AS STRING) AS keyword")
    with pytest.raises(ValueError, match="more than"):
        scoping.kinds(docs, many)


def test_blocks_come_many_at_once(spark):
    """Blocks are read in batches, also those that lie across batches; a report of one block is put together whole."""
    rows = [ROW | {"report": None if i % 9 == 0 else i // 6, "nth": i, "table": "ab"[i % 2], "severity": (None, "LOW", "HIGH")[i // 2 % 3], "title": ("Weak", "A title that is long enough", None)[i % 3]} for i in range(600)]
    rows += [ROW | {"report": -5, "nth": i, "table": str(i % 7), "title": f"A title that is long enough {i % 40}"} for i in range(900)]
    df = spark.createDataFrame([tuple((r | {"extra": "x"}).get(k.split(" ")[0].strip("`")) for k in SCHEMA.split(", ")) for r in rows], SCHEMA)
    reports: dict[object, list[dict]] = {}
    for r in rows:
        reports.setdefault(r["report"], []).append(r)
    expected = Counter((f[0], f[1], f[2], f[-1]) for rs in reports.values() for f in whole(rs))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = merging.merged(df)
        assert Counter((r["report"], r["title"], r["severity"], tuple(r["rows"])) for r in got.collect()) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()  # no call of Python for each block
