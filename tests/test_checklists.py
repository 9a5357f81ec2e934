"""Checklists read from rows of worksheets, and the controls that their items mean."""

from __future__ import annotations

from attestor.operators import checklists as K

ROWS = [
    ("a", "Notes", 0, 0, ["nothing here"]), ("a", "Checklist", 1, 0, [None, " "]), ("a", "Checklist", 1, 1, ["S No", "Control ID", "Audit check", "Policy document", "Evidence file", "File type"]),
    ("a", "Checklist", 1, 2, ["1", "8.17", "Are clocks set?", "clock.pdf", "n/a", "pdf"]), ("a", "Checklist", 1, 3, ["", None, "", None]), ("a", "Checklist", 1, 4, ["2", "", "Is access reviewed?", "", "log.txt"]),
    ("a", "Checklist", 1, 5, ["S No", "", "Audit check", "x.pdf"]), ("b", "Other", 0, 3, ["Control ID", "Evidence"]), ("b", "Other", 0, 4, ["5.15", "proof.docx"]), ("b", "Zzz", 1, 0, ["Question"]), ("b", "Zzz", 1, 1, ["not read"]),
    ("c", "Sheet1", 0, 0, [None]), ("d", "x", 0, 0, ["Control name", "Document"]), ("d", "x", 0, 1, ["Access control", "File"]), ("d", "x", 0, 2, ["control name"]),
]


def test_read(spark):
    rows = spark.createDataFrame(ROWS, "file string, sheet string, sheet_at int, row int, cells array<string>")
    got = {(r["file"], r["row"]): tuple(r)[2:] for r in K.read(rows).collect()}
    assert got == {
        ("a", 2): ("8.17", "", "Are clocks set?", ["clock.pdf"], ["clock.pdf"], []), ("a", 4): ("", "", "Is access reviewed?", ["log.txt"], [], ["log.txt"]),
        ("b", 4): ("5.15", "", "", ["proof.docx"], [], ["proof.docx"]), ("d", 1): ("", "Access control", "Access control", [], [], []),
        ("d", 2): ("", "control name", "control name", [], [], []),  # with no other column the names are read as questions too
    }
    assert K.read(rows.filter("false")).count() == 0


def test_controls(spark):
    controls = spark.createDataFrame(
        [("c1", "5.15 Access control", 1), ("c2", "8.17 Clock synchronization", 2), ("c3", "8.1 User endpoint devices", 3), ("c4", "8.15 Logging", 4), ("c5", "5.15 Access control twice", 5)], "control string, label string, at int"
    )
    items = spark.createDataFrame(
        [(1, "Control 8.17", "", ""), (2, "", "access CONTROL", ""), (3, "", "Clock synchr", ""), (4, "", "", "Do the user devices comply?"), (5, "", "", "are passwords long?"), (6, None, None, None), (7, "8.170", "logging", ""),
         (8, "5.15", "", ""), (9, "8.15 logging", "", ""), (10, "", "Clock", "")],
        "n int, id_text string, name_text string, question string",
    )
    got = {r["n"]: (r["control"], r["by"]) for r in K.controls_of(items, controls, "n", {"passwords": "c9"}).collect()}
    assert got == {
        1: ("c2", "id"), 2: ("c1", "label"), 3: ("c2", "prefix"), 4: ("c3", "name"), 5: ("c9", "rule"), 6: (None, None), 7: ("c4", "label"), 8: ("c1", "id"), 9: ("c4", "id"), 10: ("c2", "name"),
    }


def test_references_of_a_crowded_session(spark, monkeypatch):
    """Thousands of references of few forms and thousands of uploads in one session, against the rule taken literally."""
    refs = spark.range(3000).selectExpr("1L AS s", "id AS row", "element_at(array('Policy ' || id % 50, 'see Policy_' || id % 50 || ' V1.pdf p.3', 'prose', ' ', 'policy_7 v1.PDF'), CAST(id % 5 + 1 AS INT)) AS cell")
    refs = refs.unionByName(spark.createDataFrame([(None, 9000, "Policy_1 V1.pdf"), (2, 9001, "a.pdf")], "s long, row long, cell string"))
    uploads = spark.range(2000).selectExpr("1L AS s", "2000 - id AS at", "'Policy_' || id || ' V1.pdf' AS name")
    names = [(2000 - i, f"Policy_{i} V1.pdf", f"policy {i} v1 pdf", f"policy {i} v1") for i in range(2000)]

    def meant(r: str) -> str | None:
        def n(c: str) -> int:
            return len(c) if c in r else len(r) if r in c else 0

        best = min((((-(10**6) if r in (f, s) else -max(n(f), n(s))), at, name) for at, name, f, s in names), default=(0,))
        return best[2] if r and best[0] else None

    forms = {f: meant(f) for i in range(50) for f in (f"policy {i}", f"see policy {i} v1 pdf p 3", "prose", "policy 7 v1 pdf")}
    low = lambda c: " ".join("".join(x if x.isascii() and x.isalnum() else " " for x in c.lower()).split())
    want = {(1, r["row"]): forms.get(low(r["cell"])) for r in refs.filter("s = 1").collect()} | {(None, 9000): None, (2, 9001): None}
    for bound in (K.BROADCAST, 10):  # broadcast, and dealt to tasks
        monkeypatch.setattr(K, "BROADCAST", bound)
        got = {(r["s"], r["row"]): r["file"] for r in K.resolved(refs, uploads, "s", "row", "cell", "name", "at").collect()}
        assert got == {k: v for k, v in want.items() if v or k[1] >= 9000}


def test_files_of_many_rows_are_collected_once(spark):
    rows = spark.range(5000).selectExpr("1 AS s", "id % 2 AS c", "id AS at", "'f' || id % 3 AS f")
    plan = K.locked(rows, "s", "c", "at", "f")
    assert {r["c"]: r["files"] for r in plan.collect()} == {0: ["f0", "f2", "f1"], 1: ["f1", "f0", "f2"]}


def test_shared_words_of_repeated_sets(spark):
    """Many items and labels of few sets of words: a pair of an item and a label is never made."""
    items = spark.range(2000).selectExpr("id AS n", "element_at(array('brand economy steel', 'brand', 'copper tin zinc', '', 'economy economy brand'), CAST(id % 5 + 1 AS INT)) AS t")
    items = items.unionByName(spark.createDataFrame([(0, "brand economy steel"), (None, "brand tin")], "n long, t string"))
    controls = spark.range(1, 1001).selectExpr("id AS control", "'Supplier ' || id || CASE WHEN id > 500 THEN ' brand economy' ELSE ' brand' END AS label", "id AS at")
    got = {r["n"]: (r["control"], r["overlap"]) for r in K.overlaps(items, controls, "n", "t", "control", "label", "at").collect()}
    assert got == {None: (1, 1)} | {n: (1, 1) if n % 5 == 1 else (501, 2) for n in range(2000) if n % 5 in (0, 1, 4)}
