import gc
import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfacet.llm import common, substring


def brute(rows, size=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - size + 1):
                if first[tuple(w[i : i + size])] < d:
                    gone |= set(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["id"], r["n"], r["removed"], r["kept"]) for r in df.collect()), key=str)


def test_edges_against_all_windows(spark, edge_docs):
    wanted = brute([tuple(r) for r in edge_docs.collect()])
    assert rows_of(substring.dedup_table(edge_docs.withColumn("id", F.lit("x")).withColumn("th", F.lit(1)).withColumn("blob", F.lit(2)))) == wanted


def test_empty(spark, empty_docs):
    assert substring.dedup_table(empty_docs).count() == 0


def test_batches_equal_the_whole(spark, edge_docs, tmp_path, fanout=2):
    docs = edge_docs.filter("doc_id is not null")
    wanted = brute([tuple(r) for r in docs.collect()])
    index, got = substring.FingerprintIndex(spark, f"file://{tmp_path}/ix", buckets=4, fanout=fanout), []
    for lo, hi in ((0, 3), (3, 8), (8, 12), (12, 99)):
        batch, history = docs.filter(f"doc_id >= {lo} and doc_id < {hi}"), docs.filter(f"doc_id < {lo}")
        got += rows_of(index.add(batch, history if lo else None))
    assert sorted(got, key=str) == wanted
    assert max(level for level, _ in index.runs()) >= 1
    runs = index._version()
    assert set(runs) <= set(index._listed("runs")) <= set(runs) | set(index._version(1))  # the version before still reads


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(ValueError):
        substring.dedup_table(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_removed_text_is_real(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, "left " + text + " right")], "doc_id long, text string")
    kept = {r["id"]: r["kept"] for r in substring.dedup_table(docs, want_text=True).collect()}
    assert kept == {1: text, 2: "left right"}


@pytest.mark.parametrize("most", [1, 60, 1 << 21])
def test_texts_in_parts_equal_single_texts(monkeypatch, most):
    monkeypatch.setattr(substring, "PART", most)
    rng = random.Random(most)
    texts = ["".join(rng.choice("abé\x85\x00\x1c \t\n\x0b\x0c\r ") for _ in range(rng.choice([0, 1, 30, 150]))) for _ in range(200)]
    texts = [None, "", " ", *texts, "a b " * 30, " a  b ", None]
    column = pa.array(["left out", *texts]).slice(1)
    for text, read in zip(texts, substring.read_texts(column), strict=True):
        words = common.words_of(text)
        h = common.word_hashes(words)
        assert read.words() == words and read.joined() == b" ".join(words) and np.array_equal(read.h, h)
        assert np.array_equal(read.least, substring.minimizers(h))
        assert np.array_equal(substring.distinct(read.least), np.unique(read.least))
    assert list(substring.read_texts(pa.array([], pa.string()))) == []


def test_a_word_is_hashed_once_a_part(monkeypatch):
    hashed = []
    monkeypatch.setattr(substring, "word_hashes", lambda words: hashed.extend(words) or common.word_hashes(words))
    list(substring.read_texts(pa.array(["a b a", "b c\ta"])))
    assert sorted(hashed) == [b"a", b"b", b"c"]


def test_memory_is_given_back_without_a_walk_over_all_modules(monkeypatch):
    monkeypatch.setitem(sys.__dict__, "_keyfacet_frozen", False)
    try:
        common.release_memory()
        assert gc.get_freeze_count() > 10_000 > len(gc.get_objects())
        frozen = gc.get_freeze_count()
        common.release_memory()
        assert gc.get_freeze_count() <= frozen
    finally:
        gc.unfreeze()
