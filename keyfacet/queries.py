"""Registered queries of the retrieval operators and the DuckDB SQL they are checked against."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfacet.config import ChunkSettings, EngineSettings, GraphSettings
from keyfacet.functions import lang as lg
from keyfacet.functions import text as tx
from keyfacet.functions import vector as vx
from keyfacet.operators import chunk, dense, graph, lexical
from keyfacet.sources.corpus import markdown

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def vectors_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


WS = r"[\t\n\x0b\x0c\r\x1c-\x20]"
HEAD = r"regexp_matches({}, '^[.!?]?\s*[0-9]+\.')"
SENTENCES = f"""
raw AS (
  SELECT doc_id, list_transform(string_split(replace(regexp_replace(coalesce(text, ''), '([.!?]) +', '\\1' || chr(1), 'g'), chr(10), chr(10) || chr(1)), chr(1)),
    lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')) AS p FROM documents
), headed AS (SELECT doc_id, p FROM raw WHERE len(list_filter(p, lambda s: {HEAD.format('s')})) > 0
), glue AS (
  SELECT doc_id, 0::BIGINT AS i, NULL::VARCHAR AS held, NULL::VARCHAR AS made FROM headed
  UNION ALL
  SELECT g.doc_id, g.i + 1, CASE WHEN g.held IS NULL AND {HEAD.format('h.p[g.i + 1]')} THEN h.p[g.i + 1] END,
    CASE WHEN g.held IS NOT NULL THEN trim(g.held || ' ' || h.p[g.i + 1]) WHEN h.p[g.i + 1] <> '' AND NOT {HEAD.format('h.p[g.i + 1]')} THEN h.p[g.i + 1] END
  FROM glue g JOIN headed h USING (doc_id) WHERE g.i < len(h.p)
), glued AS (
  SELECT g.doc_id, list(coalesce(made, held) ORDER BY i) AS ss FROM glue g JOIN headed h USING (doc_id)
  WHERE made IS NOT NULL OR held IS NOT NULL AND i = len(h.p) GROUP BY g.doc_id
), sents AS (
  SELECT doc_id, list_filter(p, lambda s: s <> '') AS ss FROM raw WHERE doc_id NOT IN (SELECT doc_id FROM headed) UNION ALL SELECT doc_id, ss FROM glued
)"""
WORDS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_\-]+'), lambda w: length(w) > 1)"
TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'))"
DOT = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"


# ---- text --------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {SENTENCES} SELECT doc_id, unnest(range(len(ss)))::INT AS sentence_no, unnest(ss) AS sentence FROM sents")
def sentence_split(spark, d):
    """Every sentence of every document."""
    found = tx.sentences(F.coalesce("text", F.lit("")))
    return docs_of(spark, d).select("doc_id", F.posexplode(found).alias("sentence_no", "sentence"))


@query(f"SELECT doc_id, len(w)::INT AS n_stems, len(list_distinct(w))::INT AS n_distinct, md5(array_to_string(w, ' ')) AS stems_md5 FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)")
def stems_identity(spark, d):
    """Words of every document without stemming, of two characters or more."""
    return docs_of(spark, d).select("doc_id", tx.stem_tokens(F.col("text")).alias("w")).select(
        "doc_id", F.size("w").alias("n_stems"), F.size(F.array_distinct("w")).alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("stems_md5")
    )


@query(f"""WITH RECURSIVE {SENTENCES}, nested AS (
  SELECT doc_id, list_filter(list_transform(ss, lambda s: list_sort(list_distinct({WORDS.format('s')}))), lambda x: len(x) > 0) AS n FROM sents)
SELECT doc_id, len(n)::INT AS n_sentences, len(list_distinct(flatten(n)))::INT AS n_stems,
  md5(array_to_string(list_sort(list_distinct(flatten(n))), ' ')) AS stems_md5, md5(array_to_string(list_transform(n, lambda x: array_to_string(x, ' ')), '|')) AS nested_md5 FROM nested""")
def chunk_stems(spark, d):
    """Lexical payload of every document: stems of each sentence and of the whole."""
    lex = lexical.lexical_table(docs_of(spark, d).withColumnRenamed("doc_id", "node_id"))
    return lex.select(
        F.col("node_id").alias("doc_id"), F.size("sentence_stems").alias("n_sentences"), F.size("stems").alias("n_stems"),
        F.md5(F.array_join(F.array_sort("stems"), " ")).alias("stems_md5"),
        F.md5(F.array_join(F.transform("sentence_stems", lambda s: F.array_join(F.array_sort(s), " ")), "|")).alias("nested_md5"),
    )


@query(f"SELECT doc_id, n_tokens FROM (SELECT doc_id, {TOKENS.format('text')}::INT AS n_tokens FROM documents) WHERE n_tokens > 20")
def short_section_filter(spark, d):
    """Documents of more than 20 tokens."""
    return docs_of(spark, d).select("doc_id", tx.token_count(F.col("text")).cast("int").alias("n_tokens")).filter("n_tokens > 20")


PACK = f"""WITH RECURSIVE {SENTENCES}, s AS (
  SELECT doc_id, i, ss[i] AS t, {TOKENS.format('ss[i]')} AS n FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM sents)
), walk AS (
  SELECT doc_id, i, 0 AS chunk_no, n AS used FROM s WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN used + s.n > @MOST THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN used + s.n > @MOST THEN s.n ELSE used + s.n END
  FROM walk JOIN s ON s.doc_id = walk.doc_id AND s.i = walk.i + 1
)"""


@query(PACK.replace("@MOST", "64") + " SELECT doc_id, chunk_no, count(*)::INT AS n_sentences, max(used)::INT AS n_tokens FROM walk GROUP BY ALL")
def chunk_pack(spark, d):
    """Sentences of every document packed into chunks of 64 tokens; the fold inside Spark."""
    sized = docs_of(spark, d).select("doc_id", F.transform(tx.sentences(F.col("text")), lambda s: tx.token_count(s).cast("int")).alias("_t"))
    packed = chunk.add_chunk_numbers(sized.filter(F.size("_t") > 0), 64)
    flat = packed.select("doc_id", F.explode(F.arrays_zip("_t", "_c")).alias("x"))
    return flat.groupBy("doc_id", F.col("x._c").alias("chunk_no")).agg(F.count("*").cast("int").alias("n_sentences"), F.sum("x._t").cast("int").alias("n_tokens"))


@query(f"""SELECT doc_id, 0 AS section_no, source AS h1, doc_id::VARCHAR AS h2, md5(body) AS body_md5
FROM (SELECT *, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS body FROM documents) WHERE body <> ''""")
def header_sections(spark, d):
    """Sections of the documents written as markdown with two headers each."""
    found = chunk.sections(markdown(docs_of(spark, d)))
    return found.select("doc_id", "section_no", F.get("headers", F.lit(0)).alias("h1"), F.get("headers", F.lit(1)).alias("h2"), F.md5("body").alias("body_md5"))


@query(PACK.replace("@MOST", "512") + f""", kept AS (SELECT doc_id FROM documents WHERE {TOKENS.format('text')} > 20)
SELECT w.doc_id, chunk_no::INT AS chunk_no, md5('# ' || source || chr(10) || '## ' || w.doc_id || chr(10) || string_agg(t, ' ' ORDER BY i)) AS text_md5
FROM walk w JOIN s USING (doc_id, i) JOIN documents x ON x.doc_id = w.doc_id JOIN kept k ON k.doc_id = w.doc_id GROUP BY w.doc_id, source, chunk_no""")
def markdown_chunks(spark, d):
    """Chunks of the documents as markdown, with the default sizes and header prefixes."""
    cut = chunk.chunks(markdown(docs_of(spark, d)), ChunkSettings())
    return cut.select("doc_id", "chunk_no", F.md5("text").alias("text_md5"))


@query(PACK.replace("@MOST", "64") + f""", kept AS (SELECT doc_id FROM documents WHERE {TOKENS.format('text')} > 20), c AS (
  SELECT w.doc_id, chunk_no, '# ' || source || chr(10) || '## ' || w.doc_id || chr(10) || string_agg(t, ' ' ORDER BY i) AS text
  FROM walk w JOIN s USING (doc_id, i) JOIN documents x ON x.doc_id = w.doc_id JOIN kept k ON k.doc_id = w.doc_id GROUP BY w.doc_id, source, chunk_no)
SELECT doc_id, count(*)::INT AS n_chunks, md5(string_agg(text, ' ' ORDER BY chunk_no)) AS text_md5 FROM c GROUP BY doc_id""")
def paragraph_rebuild(spark, d):
    """Whole paragraphs put together again from all their chunks."""
    cut = chunk.chunks(markdown(docs_of(spark, d)), ChunkSettings(max_tokens=64))
    nodes = cut.select((F.col("doc_id") * 100_000 + F.col("chunk_no")).alias("node_id"), "doc_id", "paragraph_id", "text")
    hits = nodes.select("node_id", F.lit(0).alias("query_id"), F.lit(0).alias("channel"), F.col("node_id").cast("double").alias("ord"))
    whole = graph.paragraphs(hits, nodes)
    count = nodes.groupBy("paragraph_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").cast("int").alias("n_chunks"))
    return whole.join(count, "paragraph_id").select("doc_id", "n_chunks", F.md5("text").alias("text_md5"))


# ---- lexical ----------------------------------------------------------------------------------

#: query, keypoint number, text.
ASKED = [(1, 0, "the and"), (1, 1, "of tion"), (2, 0, "les des que"), (2, 1, "the and"), (3, 0, "und der die"), (4, 0, "con para los"), (5, 0, "-"), (6, 0, "The the AND of")]
ASKED_SQL = "(VALUES " + ", ".join(f"({q}::BIGINT, {k}, '{t}')" for q, k, t in ASKED) + ") AS kp(query_id, kp_no, keypoint)"
REQ = f"req AS (SELECT query_id, kp_no, list_distinct({WORDS.format('keypoint')}) AS r FROM {ASKED_SQL})"
NESTED = f"nested AS (SELECT doc_id, list_transform(ss, lambda s: list_distinct({WORDS.format('s')})) AS n FROM sents)"


def asked(spark):
    df = spark.createDataFrame(ASKED, "query_id long, kp_no int, keypoint string")
    return df.withColumn("stems", tx.keypoint_stems(F.col("keypoint")))


def lex_of(spark, d):
    return lexical.lexical_table(docs_of(spark, d).withColumnRenamed("doc_id", "node_id"))


@query(f"WITH RECURSIVE {SENTENCES}, {REQ}, {NESTED} SELECT query_id, kp_no, doc_id AS node_id FROM req JOIN nested ON list_has_all(flatten(n), r) WHERE len(r) > 0")
def lexical_and(spark, d):
    """Documents with all stems of a keypoint."""
    return lexical.and_search(asked(spark), lex_of(spark, d))


PROX = f"WITH RECURSIVE {SENTENCES}, {REQ}, {NESTED}, hits AS (SELECT query_id, kp_no, doc_id FROM req JOIN nested ON len(list_filter(n, lambda s: list_has_all(s, r))) > 0 WHERE len(r) > 0)"


@query(PROX + " SELECT query_id, kp_no, doc_id AS node_id FROM hits")
def lexical_proximity(spark, d):
    """Documents with all stems of a keypoint in one sentence."""
    return lexical.proximity_search(asked(spark), lex_of(spark, d), max_candidates=None)


@query(f"""WITH RECURSIVE {SENTENCES}, {REQ}, {NESTED}, c AS (
  SELECT query_id, kp_no, doc_id, n, r, row_number() OVER (PARTITION BY query_id, kp_no ORDER BY doc_id) AS rn FROM req JOIN nested ON list_has_all(flatten(n), r) WHERE len(r) > 0)
SELECT query_id, doc_id AS node_id, min(kp_no)::INT AS kp_no FROM c WHERE rn <= 4096 AND len(list_filter(n, lambda s: list_has_all(s, r))) > 0 GROUP BY ALL""")
def lexical_multi_keypoint(spark, d):
    """Union over keypoints with the reference's candidate cap before the sentence test."""
    return lexical.union_keypoints(lexical.proximity_search(asked(spark), lex_of(spark, d), max_candidates=4096))


# ---- dense -------------------------------------------------------------------------------------


def points_of(spark, d):
    return vectors_of(spark, d).select(F.col("vec_id").alias("point_id"), F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))


def asked_vectors(spark, d):
    v = vectors_of(spark, d).filter("vec_id % 100 = 0")
    return v.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("qv_no"), F.col("embedding").alias("vector"))


HITS = f"""hits AS (
  SELECT q.vec_id AS query_id, p.vec_id AS node_id, {DOT.format('q.embedding', 'p.embedding')} AS score, p.label
  FROM embeddings q JOIN embeddings p ON true WHERE q.vec_id % 100 = 0 {{where}}
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM hits), top AS (SELECT * FROM ranked WHERE r <= 10)"""


@query("WITH " + HITS.format(where="") + " SELECT query_id, node_id, round(score, 6) AS score FROM top")
def cosine_topk(spark, d):
    """The ten best vectors of every hundredth vector."""
    return dense.top_k(asked_vectors(spark, d), points_of(spark, d), 10).select("query_id", "node_id", F.round("score", 6).alias("score"))


@query("WITH " + HITS.format(where="AND p.label IN (1, 2, 3)") + " SELECT query_id, node_id, round(score, 6) AS score FROM top")
def restricted_topk(spark, d):
    """The same among the vectors of three labels."""
    some = vectors_of(spark, d).filter(F.col("label").isin(1, 2, 3)).select(F.col("vec_id").alias("node_id"))
    return dense.top_k(asked_vectors(spark, d), points_of(spark, d), 10, some).select("query_id", "node_id", F.round("score", 6).alias("score"))


@query("WITH " + HITS.format(where="") + ", cut AS (SELECT query_id, quantile_cont(score, 0.7::DOUBLE) AS c FROM top GROUP BY query_id) SELECT query_id, node_id, round(score, 6) AS score FROM top JOIN cut USING (query_id) WHERE score >= c")
def percentile_retrieval(spark, d):
    """Hits over the 70th percentile of each query's ten."""
    hits = dense.percentile_cut(dense.top_k(asked_vectors(spark, d), points_of(spark, d), 10), 70.0)
    return hits.select("query_id", "node_id", F.round("score", 6).alias("score"))


MEAN = """m AS (SELECT label, i, avg(x) AS a FROM (SELECT label, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL),
n AS (SELECT label, sqrt(sum(a * a)) AS l FROM m GROUP BY label)"""


@query(f"WITH {MEAN} SELECT label, i AS pos, round((a / l)::DOUBLE, 5) + 0.0 AS x FROM m JOIN n USING (label)")
def aggregate_unit_vector(spark, d):
    """Mean unit vector of each label."""
    mean = vx.average_unit_vector(vectors_of(spark, d), ["label"], "embedding")
    return mean.select("label", F.posexplode("vector").alias("pos", "x")).select("label", "pos", (F.round(F.col("x").cast("double"), 5) + F.lit(0.0)).alias("x"))


@query("""WITH p AS (SELECT vec_id * 2 + k AS point_id, label, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS key FROM embeddings, (VALUES (0), (1)) t(k))
SELECT label, count(*) AS n_points, sum(point_id)::BIGINT AS point_sum FROM (SELECT label, key, min(point_id) AS point_id FROM p GROUP BY label, key) GROUP BY label""")
def vector_dedup(spark, d):
    """Points of each label once, though every vector comes twice."""
    twice = vectors_of(spark, d).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    twice = twice.select((F.col("vec_id") * 2 + F.col("k")).alias("point_id"), F.col("label").alias("node_id"), F.col("embedding").alias("vector"))
    return dense.distinct_points(twice).groupBy(F.col("node_id").alias("label")).agg(F.count("*").alias("n_points"), F.sum("point_id").alias("point_sum"))


def nodes_of(spark, d):
    return vectors_of(spark, d).select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"), F.col("label"))


EDGES = f"""pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, {DOT.format('a.embedding', 'b.embedding')} AS score FROM embeddings a JOIN embeddings b ON true
), near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM pairs
), edges AS (SELECT src, dst, score FROM near WHERE r <= 6 AND src <> dst AND score >= 0.35)"""
MUTUAL = EDGES + ", both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def edges_of(spark, d):
    """The threshold fits these vectors; the default of 0.7 selects none of them."""
    return graph.knn_edges(nodes_of(spark, d), points_of(spark, d), 5, 0.35)


@query(f"WITH {EDGES} SELECT src, dst, round(score, 6) AS score FROM edges")
def knn_edges(spark, d):
    return edges_of(spark, d).select("src", "dst", F.round("score", 6).alias("score"))


@query(f"WITH {MUTUAL} SELECT src, dst FROM both_ways")
def mutual_edges(spark, d):
    return graph.mutual(edges_of(spark, d))


EXPAND = "WITH " + HITS.format(where="") + ", " + MUTUAL + f""", cut AS (SELECT query_id, quantile_cont(score, 0.7::DOUBLE) AS c FROM top GROUP BY query_id),
base AS (SELECT query_id, node_id, score FROM top JOIN cut USING (query_id) WHERE score >= c),
extra AS (SELECT DISTINCT b.query_id, e.dst AS node_id FROM base b JOIN both_ways e ON e.src = b.node_id
  JOIN embeddings n ON n.vec_id = e.dst JOIN embeddings q ON q.vec_id = b.query_id
  WHERE {DOT.format('n.embedding', 'q.embedding')} >= 0.2 AND (b.query_id, e.dst) NOT IN (SELECT query_id, node_id FROM base))"""


def found_of(spark, d):
    return dense.percentile_cut(dense.top_k(asked_vectors(spark, d), points_of(spark, d), 10), 70.0).select("query_id", "node_id", "score")


def expanded_of(spark, d):
    found, edges = found_of(spark, d), graph.mutual(edges_of(spark, d))
    return graph.expand(found, edges, nodes_of(spark, d), asked_vectors(spark, d), 0.2)


@query(EXPAND + " SELECT query_id, node_id, false AS is_extra FROM base UNION ALL SELECT query_id, node_id, true FROM extra")
def expand_neighbors(spark, d):
    return expanded_of(spark, d)


@query(EXPAND + """, lex AS (SELECT q.vec_id AS query_id, n.vec_id AS node_id FROM embeddings q JOIN embeddings n ON q.label = n.label WHERE q.vec_id % 100 = 0),
fused AS (SELECT query_id, node_id, 0 AS channel FROM base UNION ALL SELECT query_id, node_id, 1 FROM extra UNION ALL SELECT query_id, node_id, 2 FROM lex)
SELECT query_id, node_id, min(channel)::INT AS channel FROM fused GROUP BY ALL""")
def hybrid_union(spark, d):
    """Dense hits, then neighbours, then a second channel (vectors of the same label), each node once."""
    wide = expanded_of(spark, d).withColumn("ord", F.col("node_id"))
    same = asked_vectors(spark, d).select("query_id").join(nodes_of(spark, d).select(F.col("node_id").alias("query_id"), "label"), "query_id")
    lex = same.join(nodes_of(spark, d).select("node_id", "label"), "label").select("query_id", "node_id", F.col("node_id").alias("ord"))
    return graph.fuse(wide.filter("not is_extra"), wide.filter("is_extra"), lex).select("query_id", "node_id", "channel")


@query(f"WITH {MUTUAL} SELECT 'edges' AS name, count(*) AS n FROM both_ways WHERE src % 7 <> 0 AND dst % 7 <> 0 UNION ALL SELECT 'nodes', count(*) FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT 'points', count(*) FROM embeddings WHERE vec_id % 7 <> 0")
def delete_cascade(spark, d):
    """Deleting every seventh node from nodes, points and both ends of edges."""
    left = graph.delete(
        {"nodes": nodes_of(spark, d), "points": points_of(spark, d), "edges": graph.mutual(edges_of(spark, d))}, nodes_of(spark, d).filter("node_id % 7 = 0")
    )
    out = None
    for name in ("edges", "nodes", "points"):
        part = left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# ---- languages, keypoints -----------------------------------------------------------------------


def _case(at: int, code: str, missing: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN {quoted(v[at])}" for k, v in lg.LANGUAGES.items()) + f" ELSE {missing} END"


PAIRS = "(SELECT DISTINCT lang AS q FROM documents UNION SELECT 'xx' UNION SELECT NULL) a, (SELECT DISTINCT lang AS c FROM documents UNION SELECT 'tlh') b"


@query(f"""SELECT q, c, CASE WHEN q <> c THEN replace({_case(3, 'q', "'" + lg.LANGUAGES['en'][3] + "'")}, '{{}}', {_case(1, 'c', 'c')}) END AS message,
 {_case(0, 'c', 'c')} AS name, {_case(2, 'lower(c)', 'c')} AS code FROM {PAIRS}""")
def language_mismatch(spark, d):
    """Message, name and script code for every pair of question and corpus language."""
    langs = docs_of(spark, d).select("lang").distinct()
    q = langs.select(F.col("lang").alias("q")).unionByName(spark.createDataFrame([("xx",), (None,)], "q string")).distinct()
    c = langs.select(F.col("lang").alias("c")).unionByName(spark.createDataFrame([("tlh",)], "c string")).distinct()
    both = q.join(c, F.lit(True))
    return both.select("q", "c", lg.mismatch(F.col("q"), F.col("c")).alias("message"), lg.english_name(F.col("c")).alias("name"), lg.script_code(F.col("c")).alias("code"))


def _detect_sql() -> str:
    order = list(lg.FREQUENT)
    lists = {k: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(v.split()))) + "]" for k, v in lg.FREQUENT.items()}
    cols = ", ".join(f"len(list_filter(w, lambda x: list_contains({lists[k]}, x))) AS n_{k}" for k in order)
    names = [f"n_{k}" for k in order]
    best = "greatest(" + ", ".join(names) + ")"
    pick = "CASE " + " ".join(f"WHEN n_{k} = {best} THEN '{k}'" for k in order) + " END"
    return f"""WITH h AS (SELECT doc_id, regexp_extract_all(lower(substring(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), 1, 2000)), '[\\p{{L}}]+') AS w FROM documents),
c AS (SELECT doc_id, {cols} FROM h) SELECT doc_id, CASE WHEN {best} > 0 THEN {pick} ELSE 'en' END AS detected FROM c"""


@query(_detect_sql())
def language_detect(spark, d):
    """Language of every document by the frequent words in its first 2000 characters."""
    return docs_of(spark, d).select("doc_id", lg.detect(F.col("text")).alias("detected"))


@query(f"""SELECT conv_id, md5(array_to_string(list_filter(list_transform(l, lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> ''), '|')) AS kept_md5,
 len(list_distinct(list_filter(list_transform(l, lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '')))::INT AS n_distinct
FROM (SELECT conv_id, flatten(list(string_split(text, ',') ORDER BY turn)) AS l FROM conversations GROUP BY conv_id)""")
def keypoint_dedup(spark, d):
    """Comma-separated pieces of conversations, stripped, without blanks, and distinct."""
    conv = spark.read.parquet(f"{d}/conversations.parquet")
    lists = conv.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.split(t["text"], ",", -1))).alias("l"))
    return lists.select(
        "conv_id", F.md5(F.array_join(tx.clean_keypoints(F.col("l"), distinct=False), "|")).alias("kept_md5"), F.size(tx.clean_keypoints(F.col("l"))).alias("n_distinct")
    )


@query(f"""SELECT md5(string_agg(line, chr(10) ORDER BY doc_id)) AS lines_md5, count(*) AS n FROM (
 SELECT doc_id, source || ': ' || array_to_string(list_slice({WORDS.format('text')}, 1, 5), ', ') AS line FROM documents)""")
def corpus_thumbnails(spark, d):
    """Lines of name and first five keypoints of all documents, as one text."""
    nodes = docs_of(spark, d).select(F.col("doc_id").alias("node_id"), F.col("source").alias("name"), tx.stem_tokens(F.col("text")).alias("keypoints"))
    lines = graph.thumbnails(nodes)
    return lines.select(F.md5("thumbnails").alias("lines_md5"), F.size(F.split("thumbnails", "\n")).cast("long").alias("n"))


# ---- models: no SQL -----------------------------------------------------------------------------


@query()
def stems_snowball(spark, d):
    """Stems of every document by its own language."""
    return docs_of(spark, d).select("doc_id", tx.stem_tokens(F.col("text"), F.col("lang")).alias("w")).select(
        "doc_id", F.size("w").alias("n_stems"), F.size(F.array_distinct("w")).alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("stems_md5")
    )


@query()
def hash_embed_search(spark, d):
    """Hashed embeddings of all documents and the best ten for every hundredth document."""
    from keyfacet.plans.models import HashingEmbedder

    made = docs_of(spark, d).select(F.col("doc_id").alias("node_id"), HashingEmbedder(128).column(F.col("text")).alias("vector"))
    points = made.withColumn("point_id", F.col("node_id"))
    asked_ = made.filter("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), F.lit(0).alias("qv_no"), "vector")
    return dense.top_k(asked_, points, 10).select("query_id", "node_id", F.round("score", 5).alias("score"))


ENGINE_QUERIES = [(1, "thanan theshe reinou", None), (2, "", None), (3, "?", None), (4, "Was ist das", "de"), (5, None, None)]


def _engine(spark, d):
    from keyfacet.plans.engine import Engine

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keyfacet-index-")
    import uuid

    settings = EngineSettings(graph=GraphSettings(edge_score=0.5, expand_score=0.5), language="en")
    engine = Engine(spark, f"{base}/index-{uuid.uuid4().hex}", settings=settings)
    engine.ingest(markdown(docs_of(spark, d)).select("doc_id", "text"))
    return engine, spark.createDataFrame(ENGINE_QUERIES, "query_id long, query string, query_language string")


@query()
def search_e2e(spark, d):
    """All documents into an index, then a batch of questions."""
    engine, asked_ = _engine(spark, d)
    found = engine.search(asked_)
    return found.select("query_id", F.size("keypoints").alias("n_keypoints"), F.size("paragraphs").alias("n_paragraphs"), F.size("node_ids").alias("n_nodes"), "note")


@query()
def answer_e2e(spark, d):
    """The same questions answered."""
    engine, asked_ = _engine(spark, d)
    return engine.answer(asked_).select("query_id", F.col("answer").isNotNull().alias("answered"), "final_summary", "note")
