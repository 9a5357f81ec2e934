"""Fill-in-middle rearrangement by bit-parallelism on big integers.

A text is UTF-8 bytes. `bytes.translate` turns it into digits of a class, which as one big integer are a mask with a bit for each
byte (the first byte is the lowest bit). Shifted boolean operations on masks mark where units begin, `bit_count` says how
many there are, and the place of the k-th unit is found by halving the mask again and again, so that a text of n bytes
costs O(n / 64) word operations for each cut and nothing is decoded.

Units are code points; words (with the blanks before them) and lines may be asked for. Two ranks drawn from a hash of the id cut
the text into prefix, middle and suffix. `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle;
`plain` leaves the text as it is. As a text with one of the marks stays plain, `restored` gives back every text exactly.

Null texts count as empty; an empty text is plain. Very long texts are cut whole. A null id is hashed as no digits.
Equal ids draw equal ranks, whatever their texts; repeated rows are each returned; when both ranks are equal the
middle is empty. Bytes that are no valid UTF-8 begin a unit unless they are continuation bytes. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ship

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts so many stay plain, and of those that are cut so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Masks of at most this many bits are searched bit by bit.
NARROW = 64


def _digits(members: bytes) -> bytes:
    """A table for `bytes.translate`: digit 1 for the bytes of a class."""
    return bytes(49 if b in members else 48 for b in range(256))


_CLASSES = {"continuation": _digits(bytes(range(0x80, 0xC0))), "blank": _digits(b" \t\n\v\f\r"), "newline": _digits(b"\n")}


def mask(data: bytes, kind: str) -> int:
    """The bytes of a class; bit i stands for byte i."""
    return int(data[::-1].translate(_CLASSES[kind]) or b"0", 2)


def starts(data: bytes, unit: str = "char") -> int:
    """Where units begin, as a mask. The first byte always begins one."""
    if not data:
        return 0
    every = (1 << len(data)) - 1
    if unit == "char":
        found = every & ~mask(data, "continuation")
    elif unit == "word":  # a unit begins with the blanks before its word: where a blank follows a word
        blank = mask(data, "blank")
        found = blank & ~(blank << 1)
    elif unit == "line":  # after each line end
        found = mask(data, "newline") << 1 & every
    else:
        raise ValueError(f"no such unit: {unit}")
    return found | 1


def select(bits: int, rank: int, width: int) -> int:
    """The place of the set bit that has `rank` set bits below it."""
    at = 0
    while width > NARROW:
        half = width // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - below, at + half
    for _ in range(rank):
        bits &= bits - 1
    return at + (bits & -bits).bit_length() - 1


def cut(data: bytes, h: str, unit: str = "char") -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, units of the prefix, units of the middle, output) of a text; `h` is 32 hexadecimal digits or more."""
    at = starts(data, unit)
    n = at.bit_count()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or h3 % 100 >= 100 - PLAIN:
        return n, "plain", None, None, data
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (select(at, k, len(data)) if k < n else len(data) for k in (first, last))
    prefix, middle, suffix = PREFIX + data[:i], MIDDLE + data[i:j], SUFFIX + data[j:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", first, last - first, suffix + prefix + middle
    return n, "psm", first, last - first, prefix + suffix + middle


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", salt: str = "1") -> DataFrame:
    """(id, n, form, prefix_units, middle_units, output) for every row; ranks come from the sha256 of salt and id."""
    bound_batches(docs.sparkSession)
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            rows = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            out = [cut(data, hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), unit) for i, data in rows]
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n", "form", "prefix_units", "middle_units", "output"])

    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), data.alias("data"))
    return rows.mapInArrow(of, f"id {kind}, n long, form string, prefix_units long, middle_units long, output binary").withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    p, s, m = (F.instr(output, mark.decode()) for mark in (PREFIX, SUFFIX, MIDDLE))
    part = lambda begin, end: F.substr(output, begin + 3, end - begin - 3)
    middle = F.substr(output, m + 3)
    psm = F.concat(part(p, s), middle, part(s, m))
    spm = F.concat(part(p, m), middle, part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    output, form = F.col("output"), F.col("form")
    return transformed(docs, id_col, text_col).select(
        F.col("id").alias(id_col), "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest(output).alias("output_sha256"), digest(restored(output, form)).alias("restored_sha256"),
    )


#: The same rows in SQL. `restored_sha256` is the digest of the text itself.
ORACLE = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS r2,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS r3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS r4 FROM hashed
), ranked AS (
  SELECT *, least(r1, r2) AS i, greatest(r1, r2) AS j, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r3 >= 90 THEN 'plain'
    WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, '<P>' || substring(text, 1, i) AS prefix, '<M>' || substring(text, i + 1, j - i) AS middle, '<S>' || substring(text, j + 1) AS suffix FROM ranked
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN prefix || suffix || middle ELSE suffix || prefix || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
