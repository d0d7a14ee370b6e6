"""Near duplicates by an inverted join over MinHash signature coordinates.

Documents with equal shingle sets form a class. A class is posted under pairs of coordinate and
value of its signature. Two classes over the Jaccard threshold agree in at least ``matches`` of the
``coords`` coordinates (short of a chance under 1 in 100,000 at the threshold itself), so they share
``common`` pairs among the ``coords - matches + common`` rarest of either: only that prefix is posted, and
frequent pairs, such as those of function words, are skipped.

Lists aren't expanded into all pairs. A list links its members to its lowest one; such pairs that meet in
``common`` lists are compared, links are confirmed on full sets and joined into components. Then only members
outside the component of a list's lowest member are counted against the members of other
components. Lists of up to ``BIG`` members are counted as pairs; of longer ones, members outside are compared
with all members by signature, in blocks of bounded size spread over tasks. So a list of copies costs one
comparison a member, and no link between components is lost.

Rows are known by their place in the table (:class:`~keyfacet.llm.common.Located`): signatures and texts
are picked where they are read, and only texts of classes with a candidate travel.

Defined results: words are runs of other than ASCII white space, A to Z lower-cased; null, empty and
blank texts have no shingles and link with nothing; a text of one word has that word as its set;
repeated rows are one class; a null id sorts after all others; an empty table gives no rows; columns besides
id and text, whatever their names, don't count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfacet.llm.common import Located, Marks, column, components, discard, join_hot, materialize, mix64, sliced, spare, word_hashes

COORDS, MATCHES, COMMON = 48, 22, 4
RANKS, PART = 1 << 20, 1 << 12
LEFTS, RIGHTS, CHUNKS = 64, 512, 256
BIG, BLOCK = 64, 2048
ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.Generator(np.random.PCG64(20240229))
MULT = (_RNG.integers(1, 1 << 63, COORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
PLUS = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 2-word shingles of the lower-cased text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    pairs = h[:-1] * ODD + mix64(h[1:]) if len(h) > 1 else h
    return np.unique(mix64(pairs))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least value of each of ``COORDS`` hash functions over the set."""
    least = np.full(COORDS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        np.minimum(least, (MULT[:, None] * part + PLUS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def signed(at: Located, id_col: str, text_col: str) -> DataFrame:
    """Number and id of each row, size and 128-bit hash of its set, signature."""
    import xxhash

    id_type = at.docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in sliced(batches):
            rows = []
            for text in b.column("text").to_pylist():
                s = shingle_set(text)
                raw = s.tobytes()
                rows.append((
                    len(s), xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63), xxhash.xxh3_64_intdigest(raw, 2) - (1 << 63),
                    signature(s).tobytes() if len(s) else b"",
                ))
            n, h1, h2, sig = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())],
                names=["row", "id", "n", "h1", "h2", "sig"],
            )

    return _texts(at, id_col, text_col).mapInArrow(run, f"row long, id {id_type}, n int, h1 long, h2 long, sig binary")


def _texts(at: Located, id_col: str, text_col: str, marks: Marks | None = None) -> DataFrame:
    row = spare(at.columns, "row")[0]
    rows = at.numbered(row) if marks is None else at.pick(marks, row)
    return rows.select(column(row).alias("row"), column(id_col).alias("id"), column(text_col).alias("text"))


def _tokens(sigs: list[bytes]) -> np.ndarray:
    """One 64-bit token for each coordinate and value, a row a signature."""
    values = np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, COORDS)
    return mix64(values.astype(np.uint64) * np.uint64(COORDS) + np.arange(COORDS, dtype=np.uint64))


def _token_counts(classes: DataFrame) -> np.ndarray:
    """Uses of the tokens of each of ``RANKS`` hash buckets: an order from rare to frequent.

    The order only has to be the same everywhere; its size doesn't depend on the input. A task
    sends its counts in parts of ``PART`` buckets.
    """

    def count(batches):
        total = np.zeros(RANKS, np.int32)
        for b in batches:
            if b.num_rows:
                np.add.at(total, (_tokens(b.column(0).to_pylist()).ravel() % RANKS).astype(np.int64), 1)
        parts = total.reshape(-1, PART)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "uses"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, uses in zip(b.column("part").to_pylist(), b.column("uses").to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(uses, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "uses"])

    schema, out = "part int, uses binary", np.zeros(RANKS, np.int64)
    counted = classes.select("sig").mapInArrow(count, schema).repartition(RANKS // PART // 16, "part").mapInArrow(add, schema)
    for r in counted.collect():  # RANKS numbers in all
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["uses"], np.int64)
    return out


def _postings(classes: DataFrame, prefix: int) -> DataFrame:
    """token, node and n: each class under the rarest ``prefix`` of its tokens."""
    uses = _token_counts(classes)
    rank = np.empty(RANKS, np.int64)
    rank[np.argsort(uses, kind="stable")] = np.arange(RANKS)
    shared = classes.sparkSession.sparkContext.broadcast(rank.astype(np.int32))

    def run(batches):
        order = shared.value
        for b in batches:
            if b.num_rows:
                tokens = _tokens(b.column(2).to_pylist())
                # Rank first, then the token itself, so that equal ranks have one order everywhere.
                weight = (order[(tokens % RANKS).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (tokens >> np.uint64(24))
                first = np.argsort(weight, axis=1, kind="stable")[:, :prefix]
                picked = np.take_along_axis(tokens, first, 1).ravel().view(np.int64)
                repeated = [pa.array(np.repeat(b.column(i).to_numpy(), prefix)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(picked), *repeated], names=["token", "node", "n"])

    return classes.select("node", "n", "sig").mapInArrow(run, "token long, node long, n int")


def _sigs(at: Located, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n and signature of ``nodes``, picked where the signatures are read."""
    marks = Marks(at, nodes, "node")
    return marks.of(rows, "row").select(F.col("row").alias("node"), "n", "sig")


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, COORDS)


def _near(pairs: DataFrame, at: Located, rows: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs (f, a, b) whose sizes allow a link and whose signatures agree in ``matches`` places. ``pairs`` is written."""
    sigs = materialize(_sigs(at, rows, _nodes(pairs)), "pair-sigs")
    side = lambda x: sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    both = join_hot(join_hot(pairs, side("a"), "a"), side("b"), "b", counted=pairs)
    both = both.filter(100 * F.least("n_a", "n_b").cast("long") >= percent * F.greatest("n_a", "n_b").cast("long"))

    def agree(batches):
        for b in batches:
            if b.num_rows:
                x, y = (_matrix(b.column(c).to_pylist()) for c in ("sig_a", "sig_b"))
                hit = pa.array((x == y).sum(axis=1) >= matches)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(hit) for c in "fab"], names=["f", "a", "b"])

    return both.select("f", "a", "b", "sig_a", "sig_b").mapInArrow(agree, "f long, a long, b long")


def _near_in_blocks(members: DataFrame, at: Located, rows: DataFrame, matches: int, percent: int) -> DataFrame:
    """Near pairs (f, a, b) of long lists: members outside the main component against all others, by signature.

    ``members``: token, node, c, main; written. Each side of a list is dealt to blocks of about ``BLOCK`` members,
    and a task compares one block of a list with another.
    """
    out = F.col("c") != F.col("main")
    blocks = members.groupBy("token").agg(
        F.ceil(F.sum(out.cast("int")) / BLOCK).cast("int").alias("nl"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nr")
    )
    sigs = materialize(_sigs(at, rows, members.select("node").distinct()), "block-sigs")
    named = materialize(join_hot(members, blocks, "token"), "block-members")
    full = join_hot(named, sigs, "node").withColumn("deal", F.xxhash64("node"))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = full.filter(out).withColumns({"i": F.pmod("deal", "nl").cast("int"), "side": F.lit(0)}).withColumn("j", grid("nr"))
    right = full.withColumns({"j": F.pmod("deal", "nr").cast("int"), "side": F.lit(1)}).withColumn("i", grid("nl"))
    spread = left.unionByName(right).select("token", "i", "j", "side", "node", "c", "main", "n", "sig")
    spread = spread.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "side")

    def run(batches):
        block, held = None, []
        lx = None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("token", "i", "j", "side"))))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                part = b.slice(s, e - s)
                if keys[s][:3] != block:
                    block, held = keys[s][:3], []
                if keys[s][3] == 0:
                    held.append(part)
                    lx = None
                    continue
                if not held:
                    continue
                if lx is None:
                    t = pa.Table.from_batches(held)
                    lx = [t.column(c).to_numpy() for c in ("node", "c", "n")] + [_matrix(t.column("sig").to_pylist())]
                for k in range(0, e - s, 64):
                    yield _block(lx, part.slice(k, 64), matches, percent)

    return spread.mapInArrow(run, "f long, a long, b long").distinct()


def _block(left: list, part: pa.RecordBatch, matches: int, percent: int) -> pa.RecordBatch:
    node, c, n, sig = left
    y_node, y_c, y_n, main = (part.column(x).to_numpy() for x in ("node", "c", "n", "main"))
    y_sig = _matrix(part.column("sig").to_pylist())
    fit = (c[:, None] != y_c) & ((y_c == main) | (node[:, None] < y_node))
    low, high = np.minimum(n[:, None], y_n), np.maximum(n[:, None], y_n)
    x, y = np.nonzero(fit & (100 * low.astype(np.int64) >= percent * high.astype(np.int64)))
    hit = (sig[x] == y_sig[y]).sum(axis=1) >= matches if len(x) else np.empty(0, bool)
    x, y = x[hit], y[hit]
    return pa.RecordBatch.from_arrays([pa.array(main[y]), pa.array(node[x]), pa.array(y_node[y])], names=["f", "a", "b"])


def _nodes(near: DataFrame) -> DataFrame:
    return near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()


def _confirm(near: DataFrame, at: Located, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets. ``near`` is written.

    Pairs are gathered by family ``f``. Up to about ``LEFTS`` left texts of a family share a block, each right
    text goes to a block once however many of them it is compared with, and blocks are cut into chunks of about
    ``RIGHTS`` right texts. So texts travel by the block and no task holds a whole family.
    """
    blocks = near.select("f", "a").distinct().groupBy("f").agg(F.ceil(F.count("*") / LEFTS).cast("int").alias("blocks"))
    keyed = join_hot(near, blocks, "f").select(
        F.xxhash64("f", F.pmod(F.xxhash64("a"), F.col("blocks"))).alias("k"), "a", "b"
    )
    rights = materialize(keyed.groupBy("k", "b").agg(F.collect_set("a").alias("lefts")), "near-rights")
    chunks = rights.groupBy("k").agg(F.ceil(F.count("*") / RIGHTS).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")
    right = join_hot(rights, chunks, "k").select("k", chunk.alias("chunk"), F.col("b").alias("node"), "lefts")
    left = rights.select("k", F.explode("lefts").alias("node")).distinct().join(chunks, "k")
    left = left.select("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", F.lit(None).cast("array<bigint>").alias("lefts"))
    places = materialize(left.unionByName(right), "near-places")
    texts = _texts(at, id_col, text_col, Marks(at, places.select("node").distinct(), "node")).select(F.col("row").alias("node"), "text")
    rows = join_hot(places, texts, "node", most=1 << 14, least=CHUNKS)

    def compare(batches):
        block, own = None, {}
        for batch in sliced(batches):
            a_out, b_out = [], []
            for k, c, node, lefts, text in zip(*(batch.column(x).to_pylist() for x in ("k", "chunk", "node", "lefts", "text"))):
                if block != (k, c):
                    block, own = (k, c), {}
                s = shingle_set(text)
                if lefts is None:
                    own[node] = s
                    continue
                for a in lefts:
                    if linked(own[a], s, percent):
                        a_out.append(a)
                        b_out.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    ordered = rows.repartition("k", "chunk").sortWithinPartitions("k", "chunk", F.col("lefts").isNotNull())
    return materialize(ordered.select("k", "chunk", "node", "lefts", "text").mapInArrow(compare, "a long, b long"), "near-links")


def _members(listed: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (token, node, n, c, main) of the lists that span components: of short lists, and of long ones.

    ``main`` is the component of a list's lowest member, ``c`` a member's own.
    """
    labelled = listed.join(comps.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    labelled = materialize(labelled, "labelled")
    main = F.max(F.when(F.col("node") == F.col("head"), F.col("c"))).alias("main")
    short = labelled.filter(F.col("size") <= BIG).groupBy("token").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), main, F.collect_list(F.struct("node", "c", "n")).alias("all")  # at most BIG
    )
    long = labelled.filter(F.col("size") > BIG).select("token", "node", "c", "head")
    mains = long.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), main).filter("lo <> hi")
    long = materialize(join_hot(long.drop("head"), mains.select("token", "main"), "token"), "long-lists")
    return short.filter("lo <> hi").select("all", "main"), long


def _collisions(short: DataFrame, percent: int) -> DataFrame:
    """Pairs (f, a, b) of different components that meet in ``COMMON`` short lists."""
    # A list gives a pair once: an outside member with one of the main component, or with a higher outside one.
    outside = short.select("all", "main", F.explode(F.filter("all", lambda m: m["c"] != F.col("main"))).alias("x"))
    met = outside.select("main", "x", F.explode("all").alias("y")).filter(
        (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("main")) | (F.col("x.node") < F.col("y.node")))
        & (100 * F.least("x.n", "y.n").cast("long") >= percent * F.greatest("x.n", "y.n").cast("long"))
    )
    return (
        met.groupBy(F.least("x.node", "y.node").alias("lo"), F.greatest("x.node", "y.node").alias("hi"))
        .agg(F.count("*").alias("met"), F.min("main").alias("f"), F.min("x.node").alias("a"))
        .filter(F.col("met") >= COMMON)
        .select("f", "a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
    )


def near_duplicates(
    docs: DataFrame | Located, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, matches: int = MATCHES
) -> DataFrame:
    """``row`` (its number in the table), ``id_col``, ``n_shingles``, ``component_id``, ``kept`` and ``first_row`` of every row.

    ``kept``: the id is its component's smallest. ``first_row``: exactly one row of each component.
    ``matches`` trades posted pairs for recall; 22 of 48 misses a pair at 75 % less than once in 100,000.
    """
    at = docs if isinstance(docs, Located) else Located(docs)
    rows = materialize(signed(at, id_col, text_col), "signatures")
    full = rows.filter("n > 0")
    # Sets of equal hashes are one class, known by its first row.
    heads = materialize(full.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("id").alias("least_id")), "heads")
    classes = Marks(at, heads, "node").of(full, "row").withColumnRenamed("row", "node")
    posts = materialize(_postings(classes, COORDS - matches + COMMON), "postings")
    lists = posts.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("size")).filter("size > 1")
    listed = materialize(join_hot(posts, lists, "token"), "lists")
    discard(posts)
    # Copies and templates first: members that often meet the lowest one of their lists.
    stars = listed.filter("node <> head").groupBy("head", "node").count().filter(F.col("count") >= COMMON)
    stars = materialize(stars.select(F.col("head").alias("f"), F.col("head").alias("a"), F.col("node").alias("b")), "stars")
    links = _confirm(materialize(_near(stars, at, rows, matches, percent), "near-pairs"), at, id_col, text_col, percent)
    comps = materialize(components(links), "labels")

    # Lists that still span components.
    short, long = _members(listed, comps)
    cross = materialize(_collisions(short, percent), "cross")
    discard(listed)
    more = _near(cross, at, rows, matches, percent).unionByName(_near_in_blocks(long, at, rows, matches, percent))
    more = more.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("f").alias("f"), F.min("a").alias("a"))
    more = more.select("f", "a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
    tested = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = materialize(more.join(tested, ["a", "b"], "left_anti"), "more-pairs")
    found = _confirm(more, at, id_col, text_col, percent)
    if not found.isEmpty():
        comps = materialize(components(links.unionByName(found)), "labels2")

    named = heads.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named.withColumn("hh", F.xxhash64("h1", "h2")), "named")
    by_comp = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = materialize(join_hot(named, by_comp, "component").select("hh", F.col("h1").alias("_1"), F.col("h2").alias("_2"), "component", "component_id"), "class-ids")
    slim = materialize(full.select("row", "id", "n", "h1", "h2", F.xxhash64("h1", "h2").alias("hh")), "slim")
    out = join_hot(slim, of_class, "hh").filter("h1 = _1 and h2 = _2").select("row", "id", "n", "component", "component_id")
    out = out.unionByName(rows.filter("n = 0").select("row", "id", "n", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id")))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    firsts = out.filter(kept & F.col("component").isNotNull()).groupBy("component").agg(F.min("row").alias("first")).select("first")
    out = out.join(firsts, F.col("row") == F.col("first"), "left")
    first = F.col("component").isNull() | F.col("first").isNotNull()
    # With a clashing id name, ``row`` gives way.
    row = spare([id_col, "n_shingles", "component_id", "kept", "first_row"], "row")[0]
    return out.select(
        F.col("row").alias(row), F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", kept.alias("kept"), first.alias("first_row")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs``, with its columns, for each component: the one of the smallest id.

    Of several such rows, equal in id, the first of the table stays. Texts without words are all kept. The
    rows that go are known by their numbers and left out where they are read.
    """
    at = Located(docs)
    found = materialize(near_duplicates(at, id_col, text_col, **how), "near-found")
    row = next(c for c in found.columns if c.endswith("row"))
    name = spare(at.columns, "row")[0]
    marks = Marks(at, found.filter("not first_row").select(F.col(row).alias(name)), name)
    return at.pick(marks, name, on=False).select(*map(column, docs.columns))
