"""Rows that try the edges: nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NEAR = " ".join(f"word{i}" for i in range(400))
TEXTS = [
    None, "", " \t\n", "one", "Ein kurzer Satz.", NEAR, NEAR, NEAR.replace("word7 ", "other "), NEAR.upper(),
    "password=abcdefgh1 user: bob\nAKIA" + "A" * 16 + " https://host.example/x token: short",
    'API_KEY="zz/yy+xx==" ' + "0123456789abcdef" * 3 + " secret = 12345678",
    "write to a.b@example.org or 10.0.0.1, 300.1.1.1, 1.2.3.4.5.6.7.8, card 4111 1111 1111 1111, +49 (30) 1234-5678",
    "GB82 WEST 1234 5698 7654 32 is my bank account; call 555-123-4567; a@b@c.de x@y",
    "café 你好 \U0001f600 naïve password=é secret: \U0001f600 token=abcdefghij",
    "don't stop <|endoftext|> now <|startoftext|>\n\n  it's   100% sure\x85  x",
    "same line\nsame line\nsame line\n" * 5, "a b c d e a b c d e a b c d e f", "$ % & | < > # *" * 9,
    "lorem ipsum dolor " * 20_000, "0" * 9_000, "x" * 9_000, "a" * 31 + " " + "b" * 33, "1" * 16 + "-" + "2" * 30,
]


def edge_rows() -> list[tuple]:
    out = [(i, t, "en" if i % 2 else None, "ab"[i % 2] if i % 5 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    unnamed = [(None, f"no id here either, {'x ' * i}password=abcdefgh{i}", "en", "a", 30) for i in range(12)]
    unlike = [(77, f"{w} " * 60, "en", "b", 60) for w in ("north", "south", "west")]
    often = [(78, "one text that comes again and again with its id", "en", "b", 47)] * 300
    return [*out, out[9], out[9], (None, None, None, None, None), *unnamed, unnamed[0], *unlike, *often]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("id", "fp", "salt", "_row", "_text", "kind", "start", "score", "epochs", "target", "_nth", "_key", "_size", "_toxicity", "_source", "positive", "size")


def edges(spark: SparkSession, clashing: bool = False) -> DataFrame:
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    if clashing:
        for c in CLASHING:
            df = df.selectExpr("*", f"'{c}' AS `{c}`")
    return df


def labels(spark: SparkSession) -> DataFrame:
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(len(TEXTS))]
    return spark.createDataFrame([*rows, (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
