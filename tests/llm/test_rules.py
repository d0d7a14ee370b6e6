from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_fixtures import prose
from keyfacet.llm import rules


def brute(text):
    t = text or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = t.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c") and x in lines[:i])
    symbols = sum(t.count(x) for x in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, dup, len(again)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#|é\x1c\x85 ", max_size=60))
def test_counts(text):
    got = rules.text_counts(text)[:5]
    wanted = brute(text)
    assert got == (wanted if wanted[0] else (0, 0, 0, 0, 0)) or not wanted[0] and got[0] == 0


def test_symbols_need_no_words(spark):
    assert rules.text_counts("###")[:3] == (1, 3, 3)


def table(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, 90) if good else " ".join(w.upper() + "!!" for w in prose(i, 90).split())
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_list_separates_and_keeps_columns(spark):
    docs, labels = table(spark)
    learned = rules.learn_from(docs, labels, sample=300)
    assert learned
    kept = rules.keep_good(docs.withColumn("n_words", F.lit("clash")), learned)
    assert kept.columns == ["doc_id", "text", "n_words"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(400) if i % 4]


def test_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 0), (5, None)], "doc_id long, quality int")
    learned = rules.learn_from(edge_docs, labels)
    assert learned == []
    got = rules.judge(edge_docs, learned, ["doc_id"])
    assert got.count() == edge_docs.count()
    for r, text in zip(got.collect(), (x["text"] for x in edge_docs.collect())):
        n, chars, symbols, dup, again = brute(text)
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (n, again, dup)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n) and r["kept"] == (not r["base_failed"])
    assert rules.keep_good(empty_docs, learned).count() == 0
    assert rules.learn_from(empty_docs, labels.limit(0)) == []


def test_conditional_is_a_column(spark):
    rule = (rules.Test("upper_share", True, 0.5), rules.Test("words", False, 200.0))
    df = rules.add_counts(spark.createDataFrame([("AB CD",), ("ab cd",)], "text string"), "text", [])
    assert [r[0] for r in df.select(rules.rejects([rule])).collect()] == [0, None]
