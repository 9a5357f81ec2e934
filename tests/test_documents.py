"""Documents of each format, containers in containers, chunks and the guardrail."""

from __future__ import annotations

import io
import random
import zipfile
from collections import Counter

import pytest

from attestor.sources import documents as D

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def zipped(members: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def sheet(rows: list[list[str]]) -> str:
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v != "" else ""
    return f"<worksheet {S}><sheetData>" + "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>"


ROWS = [["id", "name", "state"], *[[str(i), f"n{i}" if i != 3 else "", "on"] for i in range(12)]]
XLSX = zipped({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One"/><sheet name="Two"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet(ROWS), "xl/worksheets/sheet2.xml": sheet([["only"], ["x"]])})
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body>" + "".join(f"<w:p><w:r><w:t>Paragraph {i} {'word ' * 60}</w:t></w:r></w:p>" for i in range(8)) + "</w:body></w:document>"})
CSV = "a,b\n" + "".join(f'{i},"x, {i}"\n' for i in range(30))
FILES = {
    "t.txt": b"short", "c.csv": CSV.encode(), "b.xlsx": XLSX, "d.docx": DOCX, "p.html": b"<html><head><title>no</title></head><body><p>One &amp; two</p><script>x()</script><div>three</div></body></html>",
    "x.xml": b"<a><b>value</b><c/></a>", "z.zip": zipped({"in/t.txt": b"inside", "__MACOSX/t.txt": b"no", ".h": b"no", "run.exe": b"no", "deep.zip": zipped({"d.csv": b"k\n1\n", "deeper.zip": zipped({"e.txt": b"x"})})}), "bad.zip": b"not a zip", "e.txt": b"", "n.txt": None,
}


@pytest.fixture(scope="module")
def chunked(spark):
    docs = spark.createDataFrame([(f, bytearray(d) if d is not None else None) for f, d in FILES.items()], "file string, data binary")
    rows = D.chunks(D.parts(docs)).orderBy("file", "part", "chunk_index").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["part"], []).append(r["content"])
    return out


def test_formats(chunked):
    assert chunked["t.txt"] == ["short"] and chunked["bad.zip"] == ["not a zip"] and not {"e.txt", "n.txt"} & set(chunked)
    assert chunked["p.html"] == ["One & two\nthree"]
    assert chunked["x.xml"] == ["b: value\n\n[RAW XML]\n<a><b>value</b><c/></a>"]
    assert chunked["z.zip/in/t.txt"] == ["inside"] and "z.zip/deep.zip/d.csv" in chunked
    assert not any("MACOSX" in p or p.endswith((".exe", ".h")) for p in chunked)


def test_sheets_have_five_rows_and_share_one(chunked):
    first, second, third = chunked["b.xlsx#One.csv"]
    lines = lambda c: [x.split(" | ")[0] for x in c.split("\n")]
    assert lines(first) == [f"id={i}" for i in range(5)] and lines(second) == [f"id={i}" for i in range(4, 9)] and lines(third) == [f"id={i}" for i in range(8, 12)]
    assert "id=3 | state=on" in first and chunked["b.xlsx#Two.csv"] == ["only=x"]


def test_tables_have_fifteen_rows_and_share_three(chunked):
    got = chunked["c.csv"]
    assert [c.split("\n")[0] for c in got] == ["Headers: a  b"] * 3
    assert [c.split("\n")[1].split("  ")[0] for c in got] == ["0", "12", "24"] and got[0].split("\n")[-1] == "14  x, 14"


def test_paragraphs_are_packed_whole(chunked):
    got = chunked["d.docx"]
    seen = Counter(line.split()[1] for c in got for line in c.split("\n\n"))
    assert set(seen) == set(map(str, range(8))) and all(len(c) >= 1000 for c in got[:-1])
    assert all(b.split("\n\n")[0] in a for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("text", ["", "x" * 999, "word " * 900, "line of words\n" * 400, ("para " * 30 + "\n\n") * 40, "y" * 5000])
def test_char_chunks(text):
    got, s = D.by_chars(text), text.strip()
    assert "".join(got) or not s
    at = 0
    for piece in got:  # every piece is a stretch of the text, and each begins before the last one ends
        found = s.find(piece, max(0, at - 260))
        assert found != -1 and found <= at and len(piece) <= 1002
        at = found + len(piece)
    assert not s or s.endswith(got[-1])


def test_guardrail(spark):
    rows = {
        "a.pdf": zipped({"x": b"1"}), "b.png": b"%PDF-1.4", "c.txt": b"MZ\x90\0", "d.docx": zipped({"word/vbaProject.bin": b"1"}), "e.zip": zipped({"big": b"0" * 2_000_000}),
        "f.zip": zipped({"run.ps1": b"x"}), "g.png": b"\x89PNG\r\n", "h.pdf": b"%PDF-1.7", "i.txt": b"", "j.txt": None, "k.zip": zipped({"ok.txt": b"fine"}),
    }
    docs = spark.createDataFrame([(f, bytearray(d) if d is not None else None) for f, d in rows.items()], "file string, data binary")
    got = {r["file"]: r["flaw"] for r in D.guarded(docs).collect()}
    assert got == {"a.pdf": "signature", "b.png": "signature", "c.txt": "executable", "d.docx": "macro", "e.zip": "ratio", "f.zip": "member", **dict.fromkeys(("g.png", "h.pdf", "i.txt", "j.txt", "k.zip"))}


def plain_runs(data: bytes, wide: bool) -> str:
    """Runs found character by character."""
    out, now = [], ""
    for i in range(0, len(data) - 1 if wide else len(data), 2 if wide else 1):
        c = data[i] if not wide or data[i + 1] == 0 else 0
        if 32 <= c <= 126 or c in (9, 10, 13):
            now += chr(c)
            continue
        out += [now] if len(now) >= 4 else []
        now = ""
    return " ".join([*out, now] if len(now) >= 4 else out)


def test_legacy_files(spark):
    rng = random.Random(18)
    head = D.OLE + bytes(12)
    for _ in range(200):
        data = bytes(rng.choice((0, 65, 97, 32, 10, 200, 255)) for _ in range(rng.randrange(120)))
        wide = plain_runs(data, True)
        assert D.legacy_text(data) == (wide if len(wide) >= 40 else plain_runs(data, False))
    said = "The policy of access is reviewed each year."
    files = {"a.doc": head + b"\x01" + b"\x02" + said.encode("utf-16-le") + b"\xff\xfe\x01", "b.ppt": head + b"\x90" + said.encode() + b"\x00\x01abc", "c.doc": said.encode(), "d.doc": D.OLE, "e.doc": b""}
    got = {n: [(k, x.decode()) for _, k, x in D.opened(n, d)] for n, d in files.items()}
    assert got == {"a.doc": [("text", said)], "b.ppt": [("text", said)], "c.doc": [("text", said)], "d.doc": [("text", "")], "e.doc": [("text", "")]}
