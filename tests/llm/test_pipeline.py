"""Each stage of the corpus pipeline on what the stage before it kept, against its operator and plain counts."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestor.llm import pii, toxicity
from attestor.llm import pipeline as corpus_pipeline
from attestor.session import table, written

from .rows import edges
from .test_simhash import survivors

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def test_order_and_columns(stages, spark):
    assert list(stages) == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns and after.dtypes == before.dtypes


def checked(name: str, before, after, spark) -> None:
    """What a stage made of its input, against plain versions and counts."""
    was, now = rows(before), rows(after) if name != "packing" else Counter()
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    if name == "toxicity":
        scored = toxicity.scored(before, table(spark, SF, "labels"), out="_toxicity_score").collect()
        assert now == Counter(tuple(r)[: len(before.columns)] for r in scored if r["_toxicity_score"] < 0.5)
    elif name == "near_dedup":
        assert Counter((r["doc_id"], digest(r["text"])) for r in after.collect()) == survivors([(r["doc_id"], r["text"]) for r in before.collect()])
        assert set(now) <= set(was)
    elif name == "pii":
        same = [i for i, c in enumerate(before.columns) if c not in ("text", "n_chars")]
        assert Counter(tuple(r[i] for i in same) for r in was.elements()) == Counter(tuple(r[i] for i in same) for r in now.elements())
        left = pii.report(after).agg({"n_email": "sum", "n_card": "sum", "n_phone": "sum"}).first()
        assert not any(left)
        assert all(r["n_chars"] == len(r["text"] or "") for r in after.collect())
        # texts without any personal data stay as they are
        clean = {digest(r["text"]) for r in before.join(pii.report(before).filter("spans = ''").select("doc_id"), "doc_id", "left_semi").collect()}
        found = {digest(r["text"]) for r in before.join(pii.report(before).filter("spans <> ''").select("doc_id"), "doc_id", "left_semi").collect()}
        assert clean - found <= {digest(r["text"]) for r in after.collect()}
    elif name == "mixing":
        assert set(now) <= set(was) and all(n <= 3 * was[r] for r, n in now.items())
        words = lambda c, source=None: sum(n * len((r[1] or "").split()) for r, n in c.items() if source is None or r[3] == source)
        largest = max((len((r[1] or "").split()) for r in was), default=0)
        assert abs(words(now) - words(was)) <= max(0.1 * words(was), largest * len({r[3] for r in was}))
    else:
        encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
        tokens = Counter((r["doc_id"], len(encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in before.collect())
        got: Counter = Counter()
        for r in after.collect():
            got[r["doc_id"], r["doc_tokens"]] += r["length"]
        assert got == Counter({k: k[1] * n for k, n in tokens.items()})


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "pii", "mixing", "packing"])
def test_stage(stages, spark, name):
    checked(name, *stages[name], spark)


def test_run_gives_the_last_stage(stages, spark):
    _, after = stages["packing"]
    again = corpus_pipeline.run(spark, SF)
    assert again.columns == after.columns
    tokens = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.filter("start = 0").collect())
    assert tokens(again) == tokens(after)


@pytest.mark.parametrize("clashing", [False, True])
def test_edge_rows_through_the_chain(spark, clashing):
    """Nulls, empty and long texts, repeated rows and ids, and columns with the names of helpers: each stage against its plain
    version on what the stage before it kept."""
    docs = edges(spark, clashing)
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), f"edge-{name}")
        assert name == "packing" or after.columns == docs.columns
        assert after.count()
        checked(name, docs, after, spark)
        docs = after


def test_empty_table_through_the_chain(spark):
    docs = edges(spark).filter("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0


def test_tables_without_other_columns(spark):
    docs = edges(spark).select("doc_id", "text", "source")
    assert corpus_pipeline.redact(spark, docs, SF).columns == docs.columns
