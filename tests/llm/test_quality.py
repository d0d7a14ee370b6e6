import numpy as np
from pyspark.sql import functions as F

from llm_fixtures import prose
from keyfacet.llm import quality


def table(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        bad = (lambda t: t.upper() + "!!") if i % 2 else (lambda t: " ".join([t.split()[0]] * 60))
        rows.append((i, prose(i, 60) if good else bad(prose(i, 60))))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = table(spark)
    model = quality.train(docs, labels.filter("doc_id % 5 <> 1"))
    scored = quality.score(docs.withColumn("score", F.lit("clash")), model, ["doc_id"]).join(labels, "doc_id").filter("doc_id % 5 = 1").collect()
    assert len(scored) == 60 and np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in scored]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_same_model_twice(spark):
    docs, labels = table(spark, 60)
    a, b = quality.train(docs, labels), quality.train(docs.repartition(7), labels.repartition(3))
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_repeated_rows_and_very_long_texts(spark):
    docs, labels = table(spark, 60)
    model = quality.train(docs.unionByName(docs), labels)
    alone = quality.train(docs, labels)
    assert (model.weight == alone.weight).all()
    long = spark.createDataFrame([(1, prose(1, 200_000)), (2, "x" * 2_000_000), (2, "x" * 2_000_000)], "doc_id long, text string")
    got = sorted(tuple(r) for r in quality.score(long, model, ["doc_id"]).select("doc_id", "score").collect())
    assert len(got) == 3 and got[1] == got[2] and all(0 <= s <= 1 for _, s in got)


def test_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.train(edge_docs, labels)
    scores = [r["score"] for r in quality.score(edge_docs, model, ["doc_id"]).collect()]
    assert len(scores) == edge_docs.count() and set(scores) == {0.5}
    assert quality.score(empty_docs, model, ["doc_id"]).count() == 0
    assert len(quality.features(None)) == len(quality.features(" \n")) == 0


def test_descent_reaches_the_optimum():
    """The objective against that of a plain subgradient descent of many steps, on overlapping classes."""
    rng = np.random.default_rng(3)
    y = rng.random(80) < 0.4
    rows = [np.unique(rng.integers(10, 40, 8) + (5 if label else 0)) for label in y]
    r = quality.log_ratios(rows, y)
    w, bias = quality.dual_coordinate_descent(rows, r, y, epochs=2000, tolerance=1e-8)
    x = np.zeros((80, 47))
    for i, f in enumerate(rows):
        x[i, f] = r[f] / np.sqrt((r[f] ** 2).sum())
    x[:, 46] = 1
    sign, cost = np.where(y, 1.0, -1.0), np.where(y, 80 / (2 * y.sum()), 80 / (2 * (~y).sum()))
    objective = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    v, best = np.zeros(47), np.inf
    for step in range(1, 40_001):
        hit = sign * (x @ v) < 1
        v = v - (v - x[hit].T @ (cost * sign)[hit]) / step
        best = min(best, objective(v))
    own = objective(np.append(w[:46], bias))
    assert own <= best + 1e-6 and best - own < 0.02 * own


def test_descent_separates():
    rng = np.random.default_rng(0)
    y = rng.random(60) < 0.5
    rows = [np.unique(np.concatenate([rng.integers(10, 60, 8), [1 if label else 2]])) for label in y]
    r = quality.log_ratios(rows, y)
    w, bias = quality.dual_coordinate_descent(rows, r, y)
    assert r[1] > 0 > r[2]
    margins = np.array([(w[f] * r[f]).sum() / np.sqrt((r[f] ** 2).sum()) + bias for f in rows])
    assert ((margins > 0) == y).all()
