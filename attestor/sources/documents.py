"""Documents of several formats to parts and chunks of text.

`parts` opens containers in the tasks that hold their files, one file at a time, and hands on all others as they are: members of archives (two levels), sheets of
workbooks as tables, paragraphs of word processor files. Everything else is bytes, whose text is taken by the session. Files
that can't be opened come through whole. Null and empty files have no chunks; other columns than those named are not read.

Sizes, overlaps and marks are fixed values: they have to give the chunks that are stored.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import labels as L
from ..functions import text as X
from ..session import bound_batches, ship
from . import scans, tools

DEPTH, MOST_BYTES, MOST_RATIO = 2, 500_000_000, 100
NO_TEXT = (".exe", ".dll", ".so", ".bin", ".jar", ".class", ".pyc", ".o", ".dylib", ".msi")
DANGEROUS = (".exe", ".ps1", ".bat", ".cmd", ".js", ".vbs", ".scr", ".msi", ".dll", ".com", ".jar", ".sh")
SHEET_ROWS, SHEET_OVERLAP, TABLE_ROWS, TABLE_OVERLAP, TARGET, OVERLAP, CAP, MOST_TEXT = 5, 1, 15, 3, 1000, 200, 2000, 50_000_000
#: Kinds of files by extension, others are text; extensions of files that are opened; columns of parts.
KINDS = {".csv": "table", ".html": "html", ".htm": "html", ".xml": "xml"}
HOLDING, PART = (".zip", ".xlsx", ".docx", ".doc", ".ppt"), ["file", "part", "kind", "data"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, data) of all files below a path in any store that Spark can read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("file"), F.col("content").alias("data"))


#: First bytes of binary office files.
OLE = bytes.fromhex("d0cf11e0")


def _members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """The files of an archive in order of their names, but for hidden ones, what has no text, and what would burst."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            base = info.filename.rsplit("/", 1)[-1]
            if info.is_dir() or "__MACOSX" in info.filename or not base or base.startswith(".") or base.lower().endswith(NO_TEXT):
                continue
            if info.file_size > MOST_BYTES or info.compress_size and info.file_size / info.compress_size > MOST_RATIO:
                continue
            yield info.filename, z.read(info)


def _paragraphs(data: bytes) -> str:
    """Paragraphs of a word processor file, parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in body.iter(f"{_W}p"))
    return "\n\n".join(x for x in lines if x)


def _sheets(data: bytes) -> Iterator[tuple[str, str]]:
    """(name, table as CSV) of each sheet that has rows; empty cells between others stay."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        paths = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for i, path in enumerate(paths):
            rows = []
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for n, c in enumerate(row.iter(f"{_S}c")):
                    at = 0
                    for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                        at = 26 * at + ord(letter) - 64
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if v is None else v.text or ""
                    cells[at - 1 if at else n] = shared[int(text)] if c.get("t") == "s" and text else text
                rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
            if rows:
                out = io.StringIO()
                width = max(map(len, rows))
                pd.DataFrame([r + [""] * (width - len(r)) for r in rows]).to_csv(out, index=False, header=False)
                yield titles[i] if i < len(titles) else str(i), out.getvalue()


#: Least characters of a run in a legacy file, and the least text for which two bytes a character are believed.
LEAST_RUN, LEAST_WIDE = 4, 40


def _runs(codes: np.ndarray) -> str:
    """The runs of printable characters among codes, with a blank between them."""
    good = ((codes >= 32) & (codes <= 126)) | (codes == 9) | (codes == 10) | (codes == 13)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
    text = codes.astype(np.uint8).tobytes().decode("latin-1")
    return " ".join(text[a:b] for a, b in edges.reshape(-1, 2).tolist() if b - a >= LEAST_RUN)


def legacy_text(data: bytes) -> str:
    """What can be read in a word processor's or presentation's binary file without its format: runs of printable characters of
    two bytes each, else, if these say too little, of one byte."""
    wide = _runs(np.frombuffer(data[: len(data) // 2 * 2], "<u2"))
    return wide if len(wide) >= LEAST_WIDE else _runs(np.frombuffer(data, np.uint8))


def opened(name: str, data: bytes, depth: int = 0) -> Iterator[tuple[str, str, bytes]]:
    """(part, kind, bytes) of one file: itself, or what it holds."""
    low = name.lower()
    try:
        if low.endswith(".zip") and depth < DEPTH:
            for member, inner in list(_members(data)):
                yield from opened(f"{name}/{member}", inner, depth + 1)
            return
        if low.endswith(".xlsx"):
            sheets = list(_sheets(data))
            for title, table in sheets:
                yield (f"{name}#{title}.csv" if len(sheets) > 1 else f"{name}.csv"), "sheet", table.encode()
            return
        if low.endswith(".docx"):
            yield name, "paragraphs", _paragraphs(data).encode()
            return
        if low.endswith((".doc", ".ppt")) and data[:4] == OLE:
            yield name, "text", legacy_text(data).encode()
            return
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, RuntimeError, NotImplementedError):
        pass  # what can't be opened comes whole
    yield name, KINDS.get(posixpath.splitext(low)[1], "text"), data


def parts(docs: DataFrame) -> DataFrame:
    """(file, part, kind, data) for what each file of (file, data) holds. Only containers are taken out of their batch; all
    other files go through as they come."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, data = b.column(0), b.column(1)
            said = names.fill_null("")
            low = pc.utf8_lower(said)
            whole = pc.invert(reduce(pc.or_, [pc.ends_with(low, e) for e in HOLDING]))
            kinds = pa.array([KINDS.get(posixpath.splitext(n)[1], "text") for n in low.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([names, said, kinds, data.fill_null(b"")], names=PART).filter(whole)
            for i in np.flatnonzero(~np.asarray(whole)).tolist():
                f = said[i].as_py()
                for p, k, x in opened(f, data[i].as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([p]), pa.array([k]), pa.array([x], pa.binary())], names=PART)

    ship(docs.sparkSession)
    bound_batches(docs.sparkSession, 16)  # a batch of whole files must fit a worker
    return docs.select("file", "data").mapInArrow(of, "file string, part string, kind string, data binary")


def text_of(kind: Column, data: Column) -> Column:
    """Text by kind: tags are taken off pages; a summary of its elements stands before the source of a document of tags."""
    t = scans.decoded(data)
    bare = F.regexp_replace(t, r"(?is)<(script|style|head|meta)[^>]*>.*?</(script|style|head|meta)>", " ")
    lines = F.regexp_replace(tools.plain(F.regexp_replace(bare, r"(?i)<(?:p|div|br|tr|li|h[1-6])[^>]*>", "\n")), r"[ \t]*\n[ \t]*", "\n")
    page = F.trim(F.regexp_replace(lines, r"\n\n+", "\n\n"))
    named = F.regexp_extract_all(t, F.lit(r"<([A-Za-z][\w.-]*)[^<>/]*>([^<>]+)</"), F.lit(0))
    line = lambda x: F.concat_ws(": ", F.regexp_extract(x, r"<([A-Za-z][\w.-]*)", 1), X.stripped(F.regexp_extract(x, r">([^<>]+)<", 1)))
    tags = F.concat(F.array_join(F.filter(F.transform(named, line), lambda x: ~x.endswith(": ")), "\n"), F.lit("\n\n[RAW XML]\n"), t)
    return F.when(kind == "html", page).when(kind == "xml", tags).otherwise(t)


# Chunks


def by_chars(s: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Pieces of about `target` characters that share `overlap`. A piece ends after a blank line within the last 150 characters,
    else after a line within 100, else after a word within 50, else at the target."""
    s = s.strip()
    out, start = [], 0
    while start < len(s):
        end = start + target
        if end >= len(s):
            out.append(s if not out else s[start:])
            break
        for mark, back in (("\n\n", 150), ("\n", 100), (" ", 50)):
            # the mark may begin at the end itself, and not at the start of the piece
            at = s.rfind(mark, max(start + 1, end - back + 1), end + len(mark))
            if at != -1:
                end = at + len(mark)
                break
        if piece := s[start:end].strip():
            out.append(piece)
        start = max(end - overlap, start + 1)
    return out


def by_paragraphs(paragraphs: list[str], target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Whole paragraphs up to `target` characters. The next piece begins with the last of them that fit `overlap`, at least
    one, but never with all."""
    out, held, fresh = [], [], 0
    size = lambda ps: sum(len(p) + 2 for p in ps)
    for i, p in enumerate(paragraphs):
        held.append(p)
        fresh += 1
        if size(held) >= target or i == len(paragraphs) - 1:
            out.append("\n\n".join(held))
            keep = 1
            while keep < len(held) and size(held[-keep - 1 :]) <= overlap:
                keep += 1
            held, fresh = held[max(len(held) - keep, min(1, len(held))) :] if len(held) > 1 else [], 0
    return out


@F.pandas_udf(ArrayType(StringType()))
def prose_chunks(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    """Of paragraphs, whole ones; of other texts, stretches of characters."""
    cut = lambda k, t: by_paragraphs([p for p in t.split("\n\n") if p.strip()]) if k == "paragraphs" else by_chars(t)
    return pd.Series([cut(k, t or "") for k, t in zip(kinds, texts, strict=True)], dtype=object)


_LINE = r'(?:"[^"]*+"|[^"\r\n])++'
_CELL = r',((?:"[^"]*+"|[^",])*+)'


def _cells(line: Column) -> Column:
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    return F.transform(raw, lambda v: F.trim(F.replace(F.regexp_replace(v, '^"|"$', ""), F.lit('""'), F.lit('"'))))


def windows_of(text: Column, sheet: bool) -> Column:
    """array of contents: the rows of a table in windows that overlap. Those of sheets are column=value pairs and capped,
    those of other tables go below their header. A table is one value, so its lines are cut where it stands, once for all
    windows, and none of them is shuffled."""
    n, shared = (SHEET_ROWS, SHEET_OVERLAP) if sheet else (TABLE_ROWS, TABLE_OVERLAP)
    step = n - shared

    def shown(line: Column, head: Column) -> Column:
        if not sheet:
            return F.array_join(_cells(line), "  ")
        pairs = F.zip_with(head, _cells(line), lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat_ws("=", h, v)))
        return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " | ")

    def of(t: Column, head: Column) -> Column:
        lines = F.filter(F.regexp_extract_all(t, F.lit(_LINE), F.lit(0)), lambda x: F.trim(x) != "")
        # a line and its end take two of a text's 2^31 bytes at least, so that is all of them
        rows = F.transform(F.slice(lines, F.lit(2), F.lit(2**30)), lambda x: shown(x, head))
        rows = F.filter(rows, lambda x: x != "") if sheet else rows
        return X.let(rows, lambda xs: F.when(F.size(xs) > 0, contents(xs, head)).otherwise(F.array().cast("array<string>")))

    def contents(xs: Column, head: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / step).cast("int"))
        body = lambda c: F.array_join(F.slice(xs, c * step + 1, F.lit(n)), "\n")
        return F.transform(starts, lambda c: F.left(body(c), F.lit(CAP)) if sheet else F.concat(F.lit("Headers: "), F.array_join(head, "  "), F.lit("\n"), body(c)))

    return X.let(F.coalesce(text, F.lit("")), lambda t: X.let(_cells(F.regexp_extract(t, rf"^\s*({_LINE})", 1)), lambda head: of(t, head)))


def row_chunks(tables: DataFrame, keys: Sequence[str], text: str, sheet: bool) -> DataFrame:
    """(keys..., chunk_index, content): the windows of each table."""
    return tables.select(*keys, F.posexplode(windows_of(F.col(text), sheet)).alias("chunk_index", "content"))


def chunks(rows: DataFrame) -> DataFrame:
    """(file, part, kind, chunk_index, source_type, content) of `parts`, which are read once for all kinds."""
    ship(rows.sparkSession)
    text = rows.select("file", "part", "kind", text_of(F.col("kind"), F.col("data")).alias("text"))
    kind, prose = F.col("kind"), ~F.col("kind").isin("sheet", "table")
    c = F.when(kind == "sheet", windows_of(F.col("text"), True)).when(kind == "table", windows_of(F.col("text"), False))
    cut = text.withColumn("p", prose_chunks("kind", F.when(prose, F.col("text")))).select("file", "part", "kind", F.posexplode(c.otherwise(F.col("p"))).alias("chunk_index", "content"))
    return cut.withColumn("source_type", F.when(kind == "sheet", "xlsx").otherwise(L.source_type(F.col("part"))))


# Guardrail


def _inside(name: str, data: bytes) -> str | None:
    """Why an archive is suspicious: macros, size, ratio, or members that run."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
    except zipfile.BadZipFile:
        return None
    names = [i.filename for i in infos]
    if any("vba" in n.lower() for n in names):
        return "macro"
    small, large = sum(i.compress_size for i in infos), sum(i.file_size for i in infos)
    if large > MOST_BYTES:
        return "size"
    if small and large / small > MOST_RATIO:
        return "ratio"
    return "member" if any(n.lower().endswith(DANGEROUS) for n in names) else None


@F.pandas_udf(StringType())
def archive_flaw(names: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([_inside(n or "", d) if d is not None and d[:2] == b"PK" else None for n, d in zip(names, data, strict=True)], dtype=object)


def guarded(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """`docs` (file, data) with flaw: why a file should be looked at, null for a clean one. The first layer that finds
    something counts: its signature, then what its archive holds, then its text."""
    ship(docs.sparkSession)
    head, ext = F.hex(F.substring("data", 1, 4)), F.regexp_replace(L.extension(F.col("file")), r"^\.", "")
    image = head.startswith("89504E47") | head.startswith("FFD8FF")
    known = image | head.startswith("25504446") | (head == "504B0304") | (head == "D0CF11E0")
    signature = (
        F.when(head.startswith("4D5A"), "executable").when((ext == "pdf") & (head == "504B0304"), "signature")
        .when(ext.isin("png", "jpg", "jpeg") & known & ~image, "signature")
    )
    archive = F.when(head == "504B0304", archive_flaw("file", "data"))
    said = F.lit(None).cast("string") if text is None else F.when(text.contains("\0"), "nul").when(F.length(text) > MOST_TEXT, "long")
    return docs.withColumn("flaw", F.coalesce(signature, archive, said))
