import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfacet.config import ChunkSettings
from keyfacet.functions import lang as lg
from keyfacet.functions import stem
from keyfacet.functions import text as tx
from keyfacet.functions.register import register
from keyfacet.operators import chunk

CASES = {
    "One. Two! Three?": ["One.", "Two!", "Three?"],
    "Первое. Второе! Третье?": ["Первое.", "Второе!", "Третье?"],
    "1. milk 2. bread": ["1. milk", "2. bread"],
    "": [],
    "  padded .  text ": ["padded .", "text"],
    "in 2024. Then": ["in", "2024. Then"],
    "a\nb": ["a", "b"],
    "1.": ["1."],
    "Pi is 3.14 exactly. ok": ["Pi is 3.14 exactly.", "ok"],
}


def column(spark, values, f, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").repartition(2)
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_sentences(spark):
    assert column(spark, list(CASES), tx.sentences) == list(CASES.values())


def folded(text):
    raw = re.split(r"(?<=\n)|(?<=[!.?])\x20+|(?=\s*(?<![0-9][!.?])(?<![0-9])[0-9]+\.\s)", text)
    out, held = [], None
    for p in (x.strip() for x in raw):
        if held is not None:
            out.append(f"{held} {p}".strip())
            held = None
        elif p and re.match(r"[!.?]?\s*[0-9]+\.", p):
            held = p
        elif p:
            out.append(p)
    return out + ([held] if held is not None else [])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1 .!?\n2", max_size=14), min_size=20, max_size=40))
def test_sentences_as_in_python(spark, texts):
    assert column(spark, texts, tx.sentences) == [folded(t) for t in texts]


def test_tokens(spark):
    assert column(spark, ["hello world", "", "a, b.", None], tx.token_count) == [2, 0, 4, 0]


def test_words_and_stems(spark):
    assert column(spark, ["Wi-Fi a - -- x_1 é Ä1", "", None], tx.stem_tokens) == [["wi-fi", "--", "x_1", "ä1"], [], []]
    assert column(spark, ["The the AND the"], tx.keypoint_stems) == [["the", "and"]]
    assert column(spark, ["One two. Two one two! . x"], tx.sentence_stems) == [[["one", "two"], ["two", "one"]]]
    assert column(spark, ["One two. Two three!"], lambda c: tx.stem_set(tx.sentence_stems(c))) == [["one", "two", "three"]]
    df = spark.createDataFrame([("Новые машины", "ru"), ("новая машина", "ru"), ("Балалар", "kk"), ("running", None)], "t string, l string")
    got = [r[0] for r in df.select(tx.stem_tokens(F.col("t"), F.col("l"))).collect()]
    assert got == [["нов", "машин"], ["нов", "машин"], ["балалар"], ["running"]]


@pytest.mark.parametrize(
    ("sentences", "required", "wanted"),
    [([["a", "b"], ["c"]], ["a", "b"], True), ([["a"], ["b"]], ["a", "b"], False), ([["a", "b", "c"]], ["b"], True), ([["a"]], [], True), ([], ["a"], False), ([], [], True)],
)
def test_proximity(spark, sentences, required, wanted):
    df = spark.createDataFrame([(sentences, required)], "s array<array<string>>, r array<string>")
    assert df.select(tx.contains_all(F.col("s"), F.col("r"))).first()[0] is wanted


def test_proximity_of_texts(spark):
    df = spark.createDataFrame(
        [("The car is old. New models come.", "new car"), ("A new car came.", "car new"), ("Newer carts.", "new car")], "t string, q string"
    ).withColumn("l", F.lit("en"))
    df = df.select(tx.sentence_stems(F.col("t"), F.col("l")).alias("s"), tx.keypoint_stems(F.col("q"), F.col("l")).alias("r"))
    got = df.select(tx.contains_all(F.col("s"), F.col("r"))).collect()
    assert [r[0] for r in got] == [False, True, False]


def test_published_stems():
    english = {"consistency": "consist", "knackeries": "knackeri", "generously": "generous", "relational": "relat", "hopping": "hop", "hoping": "hope", "skies": "sky", "dying": "die"}
    german = {"aufeinander": "aufeinand", "kategorie": "kategori", "häuser": "haus", "kategorischen": "kategor"}
    russian = {"важнейшая": "важн", "вычисление": "вычислен", "машины": "машин", "новая": "нов"}
    spanish = {"chicos": "chic", "torear": "tor", "cheques": "chequ", "rápidamente": "rapid"}
    french = {"continuellement": "continuel", "majestueusement": "majestu", "chevaux": "cheval", "mangeons": "mangeon"}
    for code, words in (("en", english), ("de", german), ("ru", russian), ("es", spanish), ("fr", french)):
        assert {w: stem.stem(w, code) for w in words} == words
    assert stem.stem("words", "tlh") == stem.stem("words", None) == "words"


def test_keypoints_and_headers(spark):
    assert column(spark, [[" a ", "", None, "a", " b"]], tx.clean_keypoints, "array<string>") == [["a", "b"]]
    assert column(spark, [["a", "a "]], lambda c: tx.clean_keypoints(c, False), "array<string>") == [["a", "a"]]
    assert column(spark, [["b", "a", "h"]], lambda c: tx.node_keypoints(F.lit("h"), c), "array<string>") == [["h", "b", "a"]]
    assert column(spark, [["A", "B"], []], tx.header_prefix, "array<string>") == ["# A\n## B", ""]
    assert column(spark, [["A", "B", "C"]], tx.header_path, "array<string>") == ["A > B > C"]
    assert column(spark, ["   x　y\x85"], tx.strip) == ["x　y"]


def test_languages(spark):
    assert column(spark, ["ru", "tlh"], lg.english_name) == ["Russian", "tlh"]
    assert column(spark, ["ru", "EN", "rus_Cyrl", "tlh"], lg.script_code) == ["rus_Cyrl", "eng_Latn", "rus_Cyrl", "tlh"]
    df = spark.createDataFrame([("en", "ru"), ("xx", "tlh"), ("en", "en"), (None, "en"), ("en", None), ("", "en")], "q string, c string")
    got = [r[0] for r in df.select(lg.mismatch(F.col("q"), F.col("c"))).collect()]
    assert "Русский" in got[0] and "tlh" in got[1] and got[2:] == [None] * 4
    texts = ["the cat is on the mat and it is not for you", "der Hund und die Katze sind nicht auf dem Tisch", "le chat et les chiens sont dans la maison pour qui", "это не то что он и она с ним", "これは日本語です", "", None, "zzz"]
    assert column(spark, texts, lg.detect) == ["en", "de", "fr", "ru", "ja", "en", "en", "en"]
    assert column(spark, ["zzz"], lambda c: lg.detect(c, asked=F.lit(" PL answer"))) == ["pl"]


def test_registered_names(spark):
    register(spark)
    assert spark.sql("select kf_stem('Running', 'en')").first()[0] == "run"
    rows = spark.sql("select * from kf_sections('# A\nx\n## B\ny')").collect()
    assert [(r["headers"], r["body"]) for r in rows] == [(["A"], "x"), (["A", "B"], "y")]
    cases = spark.createDataFrame([(t,) for t in [*CASES, "One. Two! 1. item goes on. 2.5 is one\nnext", " 3. \u00a0x.\n\n", "é? à! 12. ü", "a.1. b. 2.", ""]], "t string")
    assert all(r["a"] == r["b"] for r in cases.selectExpr("kf_sentences(t) a", "t").select("a", tx.sentences(F.col("t")).alias("b")).collect())
    text = "# A\nOne two three. Four five six. Seven.\n## B\nshort"
    rows = [tuple(r) for r in spark.sql(f"select * from kf_chunks('{text}', 5, 2)").collect()]
    cut = chunk.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), ChunkSettings(5, 2))
    assert sorted(r[3] for r in rows) == sorted(r["text"] for r in cut.collect()) and rows[0][:3] == (0, 0, ["A"])
    assert [r["word"] for r in spark.sql("select * from kf_tokens('a-b c')").collect()] == ["a-b", "c"]
    spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "v array<double>").createOrReplaceTempView("kf_v")
    assert [round(x, 4) for x in spark.sql("select kf_mean_vector(v) from kf_v").first()[0]] == [0.7071, 0.7071]


@pytest.mark.parametrize(
    "lang, words",
    [
        ("sv", {"jaktkarlarne": "jaktkarl", "jaktkarlens": "jaktkarl", "kloka": "klok", "klokheten": "klok", "friskt": "frisk"}),
        ("no", {"havnedistriktene": "havnedistrikt", "havnemyndigheten": "havnemynd", "oppdagelse": "oppdag", "opning": "opning"}),
        ("da", {"indtages": "indtag", "indtager": "indtag", "undersøgelser": "undersøg", "indtrykket": "indtryk"}),
        ("nl", {"lichamelijkheden": "licham", "lichaam": "licham", "brood": "brod", "opgooien": "opgooi", "opheffen": "opheff"}),
        ("it", {"abbandonata": "abbandon", "abbattimento": "abbatt", "abbellire": "abbell", "propriamente": "propr", "pronta": "pront"}),
        ("pt", {"boatos": "boat", "quilométricas": "quilométr", "químico": "químic", "quintuplicou": "quintuplic", "quinzena": "quinzen"}),
    ],
)
def test_stemmers_of_further_languages(lang, words):
    assert {w: stem.stem(w, lang) for w in words} == words


def test_detection_reads_a_text_once(spark):
    from keyfacet.functions import lang as lg

    texts = ["　 \x1c the cat and the dog  ", "der die das", "これはペンです the", "漢字", "   ", None, "qq zz", "x" * 1999 + " der", " " * 3000 + "le la les des"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", lg.detect(F.col("text")).alias("l"), lg.detect(F.col("text"), asked=F.lit("FR")).alias("a"), lg.needs_model(F.col("text")).alias("n"))
    assert [r["l"] for r in sorted(got.collect())] == ["en", "de", "ja", "zh", "en", "en", "en", "en", "fr"]
    assert [r["a"] for r in sorted(got.collect())][4:8] == ["fr"] * 4 and [r["n"] for r in sorted(got.collect())][4:8] == [True] * 4
    plan = df.select(lg.detect(F.col("text")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[\p{L}]+") == 1
