import random

import pytest

from veritide.llm import bpe, queries

pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=bpe.load_ranks(bpe.DEFAULT_VOCABULARY), special_tokens={})


def odd_texts():
    rng = random.Random(3)
    fixed = ["", " ", "a", "aaa aaaa aaaaa", "<|endoftext|>", "Don't  stop\r\n\tnow", "漢字かな交じり文", "🎉👍🏽", "x" * 30_000, "ab" * 5000, "\u0000​", "it's I'LL 12345 ½"]
    return fixed + ["".join(rng.choice("ab éß漢🎉\n '1.") for _ in range(rng.randint(0, 80))) for _ in range(300)]


def test_ids_equal_the_library(spark, reference):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(1000, None), (0, "again"), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text or "", r.ids) for r in bpe.encode(df, "text").collect())
    assert got == sorted((i, t or "", reference.encode_ordinary(t) if t else []) for i, t in rows)


def test_whole_table_round_trip(spark, data, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.p6_ids(spark, data).collect():
        assert reference.decode(r.ids) == (texts[r.doc_id] or "") and r.ids == (reference.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])


def test_empty_table_and_clashing_column(spark):
    df = spark.createDataFrame([], "ids string, text string")
    out = bpe.encode(df, "text")
    assert out.count() == 0 and out.columns == ["text", "ids"]
