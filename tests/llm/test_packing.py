import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfacet.llm import common, packing
from keyfacet.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = "A b's <|endoftext|>x İstanbul ΣΑΣ. fín CAFÉ! 12ab ab12, don't ''s .. a.b ß ﬁx. 　z \x1c q\x85w é é. $% word.,!?"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_word_cache_equals_the_tokenizer(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    own = packing.WordTokenizer(tokenizer_path())
    for t, got in zip([*texts, ODD], own.encode([*texts, ODD])):
        assert got == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


LETTERS = "".join(c for c in map(chr, range(0x180)) if c.isalpha())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(LETTERS + "ΣſﬁＡ́ ,!", max_size=40), max_size=5))
def test_latin_words_equal_the_tokenizer(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    own = packing.WordTokenizer(tokenizer_path())
    texts = [*texts, " ".join(a + b for a in LETTERS for b in "aÀß"), LETTERS]
    for t, got in zip(texts, own.encode(texts)):
        assert got == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


class Watched:
    """A tokenizer that notes what it is given."""

    def __init__(self, tok):
        self.tok, self.given = tok, []

    def encode_batch_fast(self, words, **how):
        self.given += words
        return self.tok.encode_batch_fast(words, **how)


def empty_cache(path):
    own = packing.WordTokenizer(path)
    own.ids, own.seen = {}, bytearray(packing.SEEN)
    return own


def test_latin_words_skip_the_normalizer(tok):
    own = empty_cache(tokenizer_path())
    own.tok = Watched(tok)
    text = "Plain WORDS and Straße CAFÉ Ærø"
    (got,) = own.encode([text])
    assert own.tok.given == [] and got == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_normalizers_are_not_skipped(tmp_path):
    from tokenizers import Regex, Tokenizer, normalizers

    path, tok = str(tmp_path / "other.json"), Tokenizer.from_file(tokenizer_path())
    tok.normalizer = normalizers.Sequence([normalizers.Replace(Regex("oe"), "é"), normalizers.Lowercase()])
    tok.save(path)
    text = "coeur Foehn élan, ÉTÉ"
    assert empty_cache(path).encode([text])[0] == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_full_cache_keeps_the_words_in_use(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 300)
    own, learned, sizes = empty_cache(tokenizer_path()), [], []
    learn = own.learn
    own.learn = lambda new: learned.append(new) or learn(new)
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    hot = {word(i).encode() for i in range(100)}
    for k in range(12):  # every word but the hot ones is in two texts
        own.encode([" ".join(word(i) for i in [*range(100), *range(100 + 50 * k, 200 + 50 * k)])])
        sizes.append(len(own.ids))
    assert not hot & set().union(*learned[2:])
    assert max(sizes) <= 300


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=255) | st.sampled_from("'sStre.,-1 <|>\x1c\x85\xa0"), max_size=40), max_size=5), st.booleans())
def test_cut_texts_equal_the_tokenizer(texts, beyond):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    own = packing.WordTokenizer(tokenizer_path())
    texts = [*texts, "don't DON'T dogs'.x x.'s a-b (c),'d 12ab3.4 <|ENDOFTEXT|> É,é×÷²ª", "<|endoftext|>A,b", *(["ſA,b Word, word"] if beyond else [])]
    for t, got in zip(texts, own.encode(texts)):
        assert got == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_word_has_one_entry_whatever_stands_next_to_it():
    own, learned = empty_cache(tokenizer_path()), []
    learn = own.learn
    own.learn = lambda new: learned.append(new) or learn(new)
    own.encode(["Word word, WORD. (word) word-word, Café café! CAFÉ12"])
    assert learned == [{"word", "café", ",", ".", "(", ")", "-", "!", "12"}]


def test_other_pre_tokenizers_are_not_cut(tmp_path):
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    path, tok = str(tmp_path / "other.json"), Tokenizer.from_file(tokenizer_path())
    split = pre_tokenizers.Split(Regex(r"\p{L}+-\p{L}+|\S"), "removed", invert=True)
    tok.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tok.save(path)
    assert empty_cache(path).encode(["well-known a-b"])[0] == np.array(tok.encode("well-known a-b", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("also", ["", " ſ"])
def test_a_full_cache_keeps_cut_and_whole_words_in_use(monkeypatch, also):
    monkeypatch.setattr(packing, "CACHE_WORDS", 300)
    own, learned, sizes = empty_cache(tokenizer_path()), [], []
    learn = own.learn
    own.learn = lambda new: learned.append(new) or learn(new)
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    for k in range(12):
        own.encode([" ".join(word(i) for i in [*range(100), *range(100 + 50 * k, 200 + 50 * k)]) + also])
        sizes.append(len(own.ids))
    hot = {word(i).encode() if also else word(i) for i in range(100)}
    assert hot <= learned[0] and not hot & set().union(*learned[2:]) and max(sizes) <= 300


def check(packed, docs, tok, capacity):
    rows = packed.collect()
    assert len(rows) == len({(r["sequence_id"], r["offset"]) for r in rows})
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = []
    for r in docs.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            wanted.append((r["doc_id"], k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(wanted, key=str)
    return len(by_seq)


def test_edges_round_trip(spark, edge_docs, tok):
    clash = edge_docs.withColumn("piece", F.lit("x")).withColumn("deal", F.lit(0)).withColumn("length", F.lit(0))
    packed = packing.pack_documents(clash, tokenizer_path())
    n = check(packed, edge_docs, tok, 2048)
    used, bound = packing.certificate(packed)
    assert used == n and used - bound <= 1


def test_partitions_exchange(spark):
    """Small partitions leave gaps; repacking brings the bins close to the bound of the whole."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(5, 60, 3000)
    rows = spark.createDataFrame([(i, int(s), int(rng.integers(0, 1 << 40))) for i, s in enumerate(sizes)], "doc_id long, length long, deal long")
    more = packing.pack(rows, 100, per_partition=25, least_open=8)
    first = rows.withColumn("b", F.pmod("deal", F.lit(120))).groupBy("b").agg(F.collect_list("length").alias("x")).collect()
    once = sum(packing.best_fit_decreasing(np.array(r["x"]), 100)[2] for r in first)
    used, bound = packing.certificate(more, 100)
    assert bound <= used < once and more.filter("sequence_id >= 3 * shiftleft(1L, 52)").count() > 0
    assert sorted((r["doc_id"], r["length"]) for r in more.collect()) == [(i, int(s)) for i, s in enumerate(sizes)]


def test_empty(spark, empty_docs):
    assert packing.pack_documents(empty_docs, tokenizer_path()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_bound_never_exceeds_the_optimum(sizes):
    def fits(items, bins):
        if not items:
            return True
        tried = set()
        for i, room in enumerate(bins):
            if room >= items[0] and room not in tried:
                tried.add(room)
                if fits(items[1:], bins[:i] + [room - items[0]] + bins[i + 1 :]):
                    return True
        return False

    items = sorted(sizes, reverse=True)
    best = next(n for n in range(1, len(items) + 1) if fits(items, [30] * n))
    counts = np.bincount(items, minlength=31)
    _, _, n = packing.best_fit_decreasing(np.array(sizes), 30)
    assert packing.lower_bound(counts, 30) <= best <= n


def test_slices_hold_few_bytes_of_text():
    texts = ["a" * 300, None, "é" * 200, "b" * 2000, "", "c" * 500, "d" * 500, "e" * 2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    parts = [p.column(1).to_pylist() for b in (batch, batch.slice(3), batch.slice(8)) for p in common.sliced([b], 5, text=1, most=1000)]
    assert parts == [texts[:3], texts[3:4], texts[4:7], texts[7:], texts[3:4], texts[4:7], texts[7:]]


def test_other_stages_drop_the_tokenizer():
    own = packing.WordTokenizer(tokenizer_path())
    own.encode(["some words, some words"])
    name, batch = packing.cache_name(tokenizer_path()), pa.RecordBatch.from_arrays([pa.array(["x"])], names=["text"])
    list(common.sliced([batch], keep=name))
    assert common.worker_cache(name)["ids"] is own.ids
    list(common.sliced([batch]))
    assert not common.worker_cache(name)


def test_file_numbers_need_no_python_workers(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    spark.range(0).write.parquet(str(tmp_path / "none"))
    at, none = (common.Located(spark.read.parquet(str(tmp_path / x))) for x in ("t", "none"))
    assert "LocalRelation" in at.files._jdf.queryExecution().optimizedPlan().toString()
    assert at.files.dtypes == [("__no", "bigint"), ("__path", "string")]
    assert at.numbered("row").select("row").distinct().count() == 10 and none.numbered("row").count() == 0
