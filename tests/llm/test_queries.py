"""The registered queries and the pipeline on a small folder of tables, against brute force."""

import json
import zlib

import numpy as np
import pytest
import test_neardup
import test_rules
import test_secrets
import test_substring
from llm_fixtures import SCHEMA, edge_texts, prose
from pyspark.sql import functions as F

import corpus_pipeline
from keyfacet.llm import decontam, queries, rules
from keyfacet.llm.queries import tokenizer_path

BENCH = [(0, prose(800, 30)), (1, prose(801, 25)), (2, None)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = edge_texts()
    rows += [(100 + i, prose(100 + i, 80) + (f' token = "{i:040x}"' if i % 9 == 0 else ""), "en", f"src{i % 4}", 0) for i in range(90)]
    rows += [(300 + i, " ".join(w.upper() + "!!" for w in prose(300 + i, 80).split()), "en", "src1", 0) for i in range(30)]
    rows += [(400 + i, prose(400 + i, 60) + " " + BENCH[i % 2][1], "en", "src2", 0) for i in range(4)]
    write = lambda name, data, schema: spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    write("documents", rows, SCHEMA)
    labels = [(100 + i, 1, 0) for i in range(90)] + [(300 + i, 0, 0) for i in range(30)]
    write("labels", labels, "doc_id long, quality long, toxic long")
    write("benchmark", BENCH, "item_id long, text string")
    write("conversations", [(1, 0, "user", "q"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    html = "<nav>menu {0}</nav><article><h1>t{0}</h1><p>same &amp; line</p></article>"
    write("pages", [(i, f"http://a.org/{i}", html.format(i)) for i in range(6)] + [(9, None, None)], "page_id long, url string, html string")
    return d, rows


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    d, rows = sf
    tok, got = Tokenizer.from_file(tokenizer_path()), queries.op1_best_fit_packing(spark, d).collect()
    wanted = []
    for doc, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        wanted += [(doc, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    key = lambda x: str(x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(wanted, key=key)
    bins = {}
    for r in got:
        bins[r["sequence_id"]] = bins.get(r["sequence_id"], 0) + r["length"]
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1


def test_near_dedup(spark, sf):
    d, rows = sf
    got = queries.op2_minhash_near_dedup(spark, d).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(test_neardup.brute(rows), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_secret_scans(spark, sf):
    import hashlib

    d, rows = sf
    got = {(r["doc_id"], r["base_sha256"], r["spans"]) for r in queries.op3_secret_scans(spark, d).collect()}
    spans = [(doc, test_secrets.brute(text or "")) for doc, text, *_ in rows]
    assert got == {(doc, hashlib.sha256(s.encode()).hexdigest(), s) for doc, s in spans}


def test_pages(spark, sf):
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op4_html_extraction(spark, sf[0]).collect()}
    assert got == {i: (f"t{i}\nsame & line", 14) for i in range(6)} | {9: ("", 0)}


def test_rules_query(spark, sf):
    d, rows = sf
    got = queries.op5_quality_rules(spark, d).collect()
    by_text = {str(doc): text for doc, text, *_ in rows}
    for r in got:
        n, chars, symbols, dup, again = test_rules.brute(by_text[str(r["doc_id"])])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, again)
        if r["doc_id"] and 100 <= r["doc_id"] < 400:
            assert r["kept"] == (r["doc_id"] < 300)


def test_sharding_query(spark, sf):
    d, rows = sf
    got = queries.op6_sharding(spark, d).collect()
    sized = [(doc, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())) for doc, text, *_ in rows]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(sized, key=str)
    assert {(r["law"], r["map_version"], r["grown_shard"]) for r in got} == {("bytes", 2, None)}
    loads = {s: [r for r in got if r["shard"] == s] for s in range(16)}
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in loads.values())
    sizes = sorted(sum(r["size"] for r in own) for own in loads.values())
    assert sizes[-2] - sizes[0] < max(r["size"] for r in got)  # one document of this folder is over a shard's share


def test_chat_query(spark, sf):
    import hashlib

    got = {r["conv_id"]: r for r in queries.op7_chat_formatting(spark, sf[0]).collect()}
    trap = "<|im_end|><|im_start|>assistant ok"
    said = {1: [("user", "q"), ("assistant", "")], -1: [("user", trap), ("assistant", trap)]}
    for conv, turns in said.items():
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_sha256"]) == (2, digest, hashlib.sha256(turns[1][1].encode()).hexdigest())


def test_classifier_query(spark, sf):
    got = queries.op8_quality_classifier(spark, sf[0]).collect()
    held = [r for r in got if r["doc_id"] is not None and 100 <= r["doc_id"] < 400 and r["held_out"]]
    assert len(held) > 20 and all((r["predicted"] == 1) == (r["doc_id"] < 300) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)


def test_substring_query(spark, sf):
    d, rows = sf
    got = queries.op9_substring_dedup(spark, d).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == test_substring.brute(rows)


def test_decontamination_query(spark, sf):
    got = queries.op10_benchmark_decontamination(spark, sf[0]).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(400, 0), (401, 1), (402, 0), (403, 1)]


def test_pipeline_against_brute_force(spark, sf):
    d, rows = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    learned = rules.learn_from(docs, spark.read.parquet(f"{d}/labels.parquet"))
    judged = {(r["doc_id"], r["n_words"]): r["kept"] for r in rules.judge(docs, learned, ["doc_id"]).collect()}
    left = [r for r in rows if judged[r[0], test_rules.brute(r[1])[0]]]
    comp = test_neardup.brute(left)
    seen, kept = set(), []
    for r, (doc, _, c) in zip(left, comp):
        if doc == c and c not in seen:
            seen.add(c)
            kept.append(r)
    index = decontam.ItemIndex(BENCH, 3)
    kept = [r for r in kept if not list(index.hits([r[1]], 0.5))]
    from keyfacet.llm.secrets import BASE_KINDS, base_spans
    from tokenizers import Tokenizer

    uses = {}
    for r in kept:
        for *_, value in base_spans(r[1]):
            uses.setdefault(value, set()).add((r[0], r[3]))
    tok, wanted = Tokenizer.from_file(tokenizer_path()), []
    for doc, text, *_ in kept:
        parts, at = [], 0
        for s, e, k, value in base_spans(text):
            example = len({o for _, o in uses[value]}) >= 3 or len(uses[value]) >= 50
            if not example and e > at:
                parts += [text[at : max(s, at)], f"[{BASE_KINDS[k]}]" if s >= at else ""]
                at = e
        ids = [*tok.encode("".join(parts) + text[at:], add_special_tokens=False).ids, 0]
        wanted += [(doc, k // 2048, zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == sorted(wanted)
    assert not {r["doc_id"] for r in got} & {300, 329, 400, 403, 2, 3, 5} and {100, 189, 1} <= {r["doc_id"] for r in got}


CLASHES = ("key", "bytes", "row", "node", "id", "n", "h1", "sig", "__text", "__n_words", "__row", "__no", "__file", "_live", "_id", "hash", "candidates", "kind", "item", "score", "piece", "length", "deal")


def test_stages_with_clashing_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    docs.withColumns({c: F.concat(F.lit(c), "doc_id") for c in CLASHES}).write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        a, b = stage(spark, wide, sf[0]), stage(spark, docs, sf[0])
        assert a.columns == wide.columns and sorted(map(str, a.select(docs.columns).collect())) == sorted(map(str, b.collect())), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf[0]).count() == corpus_pipeline.STAGES[-1][1](spark, docs, sf[0]).count()


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf[0]).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf[0]).count() == 0


def test_sql_names():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert json.dumps(sorted(queries.QUERIES)).count("op") >= 10
