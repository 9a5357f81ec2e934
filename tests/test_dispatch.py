"""Files of many formats in one pass: what is shuffled and written is bounded by what is read."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from attestor.plans import scans as P
from attestor.session import OPEN_FILES, table, written
from attestor.sources import scans

HEAD = "Plugin ID,CVE,CVSS v3.0 Base Score,Risk,Host,Protocol,Port,Name,Description\n"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exports_share_one_shuffle_of_columns(spark):
    files = P.exported(lambda n: table(spark, "/root/testdata/sf0.001", n), P.nessus_file(), P.qualys_file(), P.openvas_file(), P.nuclei_file(), P.sarif_file())
    shown = plan(files)
    assert shown.count("Exchange") == 1
    assert "Plugin ID" not in shown[shown.index("Exchange") :]


def test_lines_of_an_export(spark):
    rows = [(1, 2, 30, 4, "R", 5.0, 0.07), (1, 1, 31, 4, None, 6.0, 0.0), (1, 1, 30, 4, "A", 7.0, 0.1), (2, 1, None, 9, "N", 1.0, None)]
    items = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double")
    got = dict(P.exported(lambda _: items, P.qualys_file()).collect())
    head = "Scan Results\nLaunch Date,today\nIP,DNS,QID,Title,Type,Severity,CVSS Base,CVSS3.1 Base\n"
    assert got == {"1": head + "10.0.0.4,,30,Item 30,Vuln,2,5.5,10.0\n10.0.0.4,,31,Item 31,Vuln,2,5.5,0.0\n10.0.0.4,,30,Item 30,Vuln,3,5.5,7.0", "2": head + "10.0.0.9,,null,Item null,Ig,2,5.5,null"}


def test_findings_of_a_file_need_no_shuffle(spark):
    nessus = HEAD + "7,CVE-2020-0002,5.0,High,h,tcp,1,late,x\n3,,,None,h,tcp,1,a,\n7,CVE-2020-0001,9.0,Low,h,tcp,1,other,y\n7,cve-2020-0002,,Low,h,tcp,2,b,\nx,,,,,,,,\n7,CVE-2020-0003,,,h,,1,c,"
    one = lambda i, at, sev, name="n": json.dumps({"template-id": i, "matched-at": at, "info": {"name": name, "severity": sev}})
    nuclei = "\n".join([one("t", "h", "low"), one("s", "h", "high"), "broken", one("t", "h", "critical"), one("t", "h", "info", "m"), one("t", "g", "medium")])
    text = "[t] [http] [low] h x\nnoise\n[u:v] [dns] [high] g\n[t] [http] [high] h\n[t] [low] h\n[] [http] [low] h"
    files = [("a", nessus), ("b", nuclei), ("b2", text), ("a", nessus), ("b", nuclei), ("c", None), ("d", ""), ("e", HEAD)]
    docs = spark.createDataFrame(files, "file string, content string")
    shown = lambda df: sorted((r["file"], r["plugin_id"], r["title"], r["severity"], r["severity_score"], r["target"], r["cve_list"]) for r in df.collect())
    out = scans.nessus_csv(docs)
    assert "Exchange" not in plan(out)
    assert shown(out) == sorted([
        ("a", "3", "a", "INFO", None, "h:1/tcp", []), ("a", "7", "b", "LOW", None, "h:2/tcp", ["CVE-2020-0002"]), ("a", "7", "c", "INFO", None, "h:1/tcp", ["CVE-2020-0003"]),
        ("a", "7", "late", "HIGH", 5.0, "h:1/tcp", ["CVE-2020-0002", "CVE-2020-0001"]),
    ] * 2, key=lambda r: r[:4])
    out = scans.nuclei(docs)
    assert "Exchange" not in plan(out)
    assert shown(out.filter("file <> 'b2'")) == sorted([("b", "t", "n", "LOW", None, "h", []), ("b", "s", "n", "HIGH", None, "h", []), ("b", "t", "m", "INFO", None, "h", []), ("b", "t", "n", "MEDIUM", None, "g", [])] * 2)
    assert shown(out.filter("file = 'b2'")) == [("b2", "t", "t", "LOW", None, "h", []), ("b2", "u:v", "u:v", "HIGH", None, "g", [])]


def test_places_of_columns_are_looked_up_once_for_each_file(spark):
    docs = spark.createDataFrame([("a", HEAD)], "file string, content string")
    shown = scans.nessus_csv(docs)._jdf.queryExecution().optimizedPlan().toString()
    at = [line for line in shown.splitlines() if "array_position(" in line]
    assert len(at) == 1 and "sort_array(" not in at[0]


def test_formats_are_told_in_order(spark):
    files = {
        "  <NessusClientData_v2>": "nessus_xml", "<x>\nHost: 10.0.0.1\nPorts:": "nmap_grepable", '{"a": 1}\n[t] [http] [low] h': "nuclei", '{"a": "runs"}': None, ' {"runs": [], "version": "2.1.0"}': "sarif",
        '[{"RuleID": 1, "template-id": 2}]': "gitleaks", '{"template-id": "runs"}': "nuclei", '{"runs": 1, "template-id": 2}': "nuclei", '"runs" "version"': None, "\n<niktoscan>": None, 'a,"QID",Title\n': "qualys_csv",
        "IP,QID ,title": "qualys_csv", "no QID, title": None, "no QID , here\n QID,TITLE": "qualys_csv", "Plugin ID,Host": "nessus_csv", "nvt NAME": "openvas_csv", "": None,
    }
    docs = spark.createDataFrame([(c,) for c in files] + [(None,)], "content string")
    got = {r["content"]: r["f"] for r in docs.select("content", scans.format_of().alias("f")).collect()}
    assert got == files | {None: None}


def test_folders_are_written_small_and_unsorted(spark):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    # more folders than a task holds open
    rows = spark.range(5_000).select((F.col("id") % (OPEN_FILES + 9)).alias("k"), F.concat(F.lit("some text "), "id").alias("t"))
    back = written(rows, "folders", ["k"])
    assert spark.conf.get(key) == before
    assert all(".zstd." in f for f in back.inputFiles())
    assert sorted(map(tuple, back.select("k", "t").collect())) == sorted(map(tuple, rows.collect()))


def test_head_of_a_file(spark):
    rows = ["x" * 4000 + "nvt name", "x" * 3992 + "NVT name", "é" * 3992 + "NVT name", "é" * 3993 + "nvt name", "İ nvt name"]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "i int, content string").select("i", scans.format_of().alias("f"))
    assert {r["i"]: r["f"] for r in got.collect()} == {0: None, 1: "openvas_csv", 2: "openvas_csv", 3: None, 4: "openvas_csv"}
