"""BPE by the table of distinct words, against the tokenizer on whole texts."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from flowspark.llm.bpe import bpe_decode, bpe_encode, hot_units, pieces, word_table
from flowspark.llm.queries import QUERIES, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("most_hot", [0, 40, 1 << 20])
def test_odd_rows(spark, odd, odd_rows, tokenizer, most_hot):
    """Every unit by the shuffle, most by it, and most by the broadcast: equal ids, also for units of more than 15 bytes."""
    rows = [(i, t) for i, t, _ in odd_rows]
    rows += [(200, "<|endoftext|> a<|endoftext|>b  \n <|endoftext|"), (201, "x" * 70_000 + " " * 300 + "\t\n" + "é" * 40), (202, "don't  stop 　 42nd    \x00nul\x00"), (203, "the the the " * 500)]
    df = spark.createDataFrame([(i, t, "k", "i") for i, t in rows], "doc_id long, text string, key string, ids string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in bpe_decode(bpe_encode(df, PATH, most_hot=most_hot), PATH).collect())
    assert got == sorted((i is None, i or 0, *want(tokenizer, t)) for i, t in rows)


def test_empty(spark, empty):
    assert bpe_decode(bpe_encode(empty, PATH), PATH).count() == 0


def test_hot_text(spark, tokenizer):
    """A third of all rows alike, with null ids."""
    rows = [(None, "same words again, and rareword1x")] * 300 + [(k, f"own{k} words again {k * 7919}") for k in range(600)]
    got = bpe_encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH, most_hot=8).collect()
    count = lambda xs: sorted((i is None, i or 0, x) for i, x in xs)
    assert count((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == count((i, want(tokenizer, t)[0]) for i, t in rows)


def test_word_table(spark):
    """Each distinct unit once; the frequent ones are bounded."""
    df = spark.createDataFrame([("a b b c c c",), ("c " * 40 + "é" * 20,), (None,)], "text string").repartition(2)
    table = word_table(df, PATH)
    n = {r.unit: r.n for r in table.collect()}
    assert n[" c"] == 3 + 39 and n["c"] == 1 and n[" b"] == 2 and table.count() == len(n)
    for most, units in ((1, 1), (0, 0)):
        hot, rest = hot_units(table, most)
        assert len(hot.h) == units and rest.count() == table.count() - units


def test_pieces_and_broken_bytes(spark, tokenizer):
    """Ids that cut a character, and ids without a piece, as the tokenizer decodes them."""
    pool, bounds = pieces(PATH)
    assert len(bounds) == 50_258 and bytes(pool[bounds[50_256] :]) == b"<|endoftext|>"
    ids = [[], [50256], tokenizer.encode("日本語 text").ids[1:], [200, 201, 5], tokenizer.encode("a€").ids[:-1]]
    df = spark.createDataFrame([(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)], "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in bpe_decode(df, PATH).collect()} == {k: tokenizer.decode(x, skip_special_tokens=False) for k, x in enumerate(ids)}


def test_op13(spark, tokenizer):
    got = {r.doc_id: r for r in QUERIES["op13_bpe"](spark, SF).collect()}
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(got) == len(rows)
    for d in rows:
        ids, text = want(tokenizer, d["text"])
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
