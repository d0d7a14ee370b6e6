"""Substring dedup by a log-structured fingerprint index.

A window is ``size`` consecutive words. Every run of equal windows holds the same minimizer, the least
hash among the short grams inside the window, so two documents that share a window share
its fingerprint. The index keeps sorted immutable runs, one a batch, of two kinds of entries: a fingerprint (about two
of nine words) that one document alone has, with its id; or a fingerprint that several have, which is open, and
then the hashes of the windows around it. A batch's fingerprints are merge-joined with the runs before it, bucket by
bucket; windows around shared ones are compared by 96 bits of their own hashes with each other and with the
windows in the index. Only the texts of documents with a shared fingerprint travel: of the batch's, and of an earlier one
when its fingerprint is met for the first time. All others are settled where they are read. Runs of one level are
compacted into one of the next, where an open fingerprint replaces its single entries.

A window is removed from a document if a document of a smaller id has it; batches come in the order of ids.
Whole copies of a text are settled by the text's hash, without fingerprints. What a task can settle among
its own rows doesn't travel.

Defined results: ids are whole numbers (others are an error); null, empty and short texts lose nothing; rows
with a null id lose nothing and count for no one; rows that share an id are one document to the rule (neither
takes from the other); an empty table gives no rows; columns besides id and text don't count.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfacet.llm.common import Located, Marks, column, gathered, join_hot, materialize, mix64, release_memory, shared_dir, sliced, spare, text_parts, word_hashes

SIZE, GRAM = 13, 6
BATCH = 2_000
BUCKET_BYTES = 16 << 20
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
RUN = "bucket int, fps binary, docs binary"
NEW, MANY, OLD = np.uint8(0), np.uint8(1), np.uint8(2)
OPEN = np.iinfo(np.int64).min
PART = 2 << 20
BLANKS = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def window_hashes(h: np.ndarray, size: int, prime: np.uint64) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` word hashes."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j in range(size):
            out = out * prime + h[j : j + n]
    return mix64(out)


def minimizers(h: np.ndarray, size: int = SIZE, gram: int = GRAM) -> np.ndarray:
    """The fingerprint of each window: the least gram hash inside it."""
    g = window_hashes(h, gram, P1)
    span = size - gram + 1
    if len(g) < span:
        return np.empty(0, np.uint64)
    out = g[: len(g) - span + 1].copy()
    for j in range(1, span):
        np.minimum(out, g[j : j + len(out)], out=out)
    return out


class Text:
    """A text's bytes, the hashes of its words and, of a long one, the fingerprint of each window."""

    __slots__ = ("raw", "h", "least", "single")

    def __init__(self, raw: bytes, h: np.ndarray, least: np.ndarray, single: bool):
        self.raw, self.h, self.least, self.single = raw, h, least, single

    def words(self) -> list[bytes]:
        return self.raw.split()

    def joined(self) -> bytes:
        """The words with a blank between them."""
        return self.raw.translate(BLANKS) if self.single else b" ".join(self.words())


def read_texts(column_: pa.Array, fingerprints: bool = True):
    """A :class:`Text` for each text of an Arrow column, null as an empty one, some MB at a time.

    Each distinct word of a part is hashed once. Windows over the end of a text are computed too, and left out.
    """
    none = np.empty(0, np.uint64)
    for part in text_parts(column_, PART):
        part = pc.fill_null(part, "")
        lists = pc.ascii_split_whitespace(part)
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        h = word_hashes(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        size = pc.binary_length(flat).to_numpy().astype(np.int64)
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        letters = np.concatenate([[0], np.cumsum(size)])[at]
        full = size > 0
        if not full.all():  # blanks at the ends of a text
            h, at = h[full], np.concatenate([[0], np.cumsum(full)])[at]
        least = minimizers(h) if fingerprints else none
        raws = part.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        for raw, a, b, word_bytes in zip(raws, at.tolist(), at[1:].tolist(), np.diff(letters).tolist()):
            yield Text(raw, h[a:b], least[a : b - SIZE + 1] if b - a >= SIZE else none, b > a and word_bytes + b - a - 1 == len(raw))


def distinct(fps: np.ndarray) -> np.ndarray:
    """The distinct ones of a text's fingerprints, most of which repeat the one before."""
    return np.unique(fps[np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]]))]) if len(fps) else fps


def covered(starts: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """Which of ``n`` words some window that begins in ``starts`` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _by_bucket(keys: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """The slices of sorted keys that fall into each of ``n`` (a power of two) buckets."""
    bits = n.bit_length() - 1
    at = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    found, first = np.unique(at, return_index=True)
    return [(int(b), slice(i, j)) for b, i, j in zip(found, first.tolist(), [*first[1:].tolist(), len(keys)])]


def bucket_count(docs: DataFrame, text_col: str) -> int:
    """A power of two with about ``BUCKET_BYTES`` of text a bucket."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return 1 << max(2, (-(-total // BUCKET_BYTES) - 1).bit_length())


def _merge_rows(df: DataFrame, n: int, merge, schema: str, *names: str) -> DataFrame:
    """Bring the rows of each bucket together and call ``merge(bucket, columns)`` on its blobs."""

    def run(batches):
        at, held = None, []
        for b in sliced(batches, 100):
            columns = [b.column(c).to_pylist() for c in ("bucket", *names)]
            for bucket, *blobs in zip(*columns):
                if bucket != at and held:
                    yield from merge(at, [b"".join(x) for x in zip(*held)])
                    held = []
                at = bucket
                held.append(blobs)
        if held:
            yield from merge(at, [b"".join(x) for x in zip(*held)])
        held.clear()
        release_memory()

    return df.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def make_run(texts: DataFrame, buckets: int) -> DataFrame:
    """The run of (id, text) rows: sorted pieces, each with fingerprints of one bucket and their documents' ids.

    A piece comes from one Arrow batch of documents, so its size is bounded and nothing is shuffled.
    """

    def entries(batches):
        for b in gathered(batches, BATCH):
            fps, owner = [], []
            for doc, text in zip(b.column(0).to_pylist(), read_texts(b.column(1))):
                if len(text.least):
                    own = distinct(text.least)
                    fps.append(own)
                    owner.append(np.full(len(own), doc, np.int64))
            if fps:
                yield from _pieces(np.concatenate(fps), np.concatenate(owner), buckets)

    return texts.select("id", "text").mapInArrow(entries, RUN)


def _pieces(fps: np.ndarray, docs: np.ndarray, buckets: int, most: int = 1 << 18):
    """Record batches of sorted pieces of at most ``most`` entries."""
    order = np.argsort(fps)
    fps, docs = fps[order], docs[order]
    for bucket, part in _by_bucket(fps, buckets):
        for i in range(part.start, part.stop, most):
            at = slice(i, min(i + most, part.stop))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([fps[at].tobytes()], pa.binary()), pa.array([docs[at].tobytes()], pa.binary())], names=["bucket", "fps", "docs"]
            )


def merge_runs(runs: DataFrame, buckets: int) -> DataFrame:
    """Fingerprints of several runs as one: each entry once, and of an open fingerprint only that it is open."""

    def merge(bucket, columns):
        fps, docs = np.frombuffer(columns[0], np.uint64), np.frombuffer(columns[1], np.int64)
        order = np.lexsort((docs, fps))
        fps, docs = fps[order], docs[order]
        start, group = _groups(fps)
        first = np.zeros(len(fps), bool)
        first[start] = True
        fresh = first | (docs != np.roll(docs, 1))
        keep = fresh & (first | (docs[start] != OPEN)[group])  # OPEN sorts before all ids
        yield from _pieces(fps[keep], docs[keep], buckets, 1 << 20)

    return _merge_rows(runs, buckets, merge, RUN, "fps", "docs")


def merge_windows(runs: DataFrame, buckets: int) -> DataFrame:
    """Windows of several runs, which have none in common, as one."""

    def merge(bucket, columns):
        h1, h2 = np.frombuffer(columns[0], np.uint64), np.frombuffer(columns[1], np.uint32)
        order = np.argsort(h1, kind="stable")
        yield _window_piece(bucket, h1[order], h2[order])

    return _merge_rows(runs, buckets, merge, "bucket int, h1 binary, h2 binary", "h1", "h2")


def _window_piece(bucket: int, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([h1.tobytes()], pa.binary()), pa.array([h2.tobytes()], pa.binary())], names=["bucket", "h1", "h2"])


def _by_doc(docs: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A row a document with its values as a blob."""
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    ids, first = np.unique(docs, return_index=True)
    ends = [*first[1:].tolist(), len(docs)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array([values[i:j].tobytes() for i, j in zip(first.tolist(), ends)], pa.binary())], names=["id", "blob"]
    )


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the groups of sorted keys, and each entry's group."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def shared_fingerprints(run: DataFrame, old: DataFrame | None, buckets: int) -> DataFrame:
    """Merge-join of a batch's run with earlier ones: id, the fingerprints that the batch and another document share, ``old``.

    Rows with ``old`` name earlier documents that alone had a fingerprint, and under the id ``OPEN`` the fingerprints opened now.

    A piece settles the fingerprints that several of its own documents have, and sends each fingerprint
    once, with one document and whether there are more: so one that a third of all documents hold
    costs an entry a piece. ``run`` should be written: it is read twice.
    """

    def local(batches):
        for b in batches:
            for f, d in zip(b.column("fps").to_pylist(), b.column("docs").to_pylist()):
                fps, docs = np.frombuffer(f, np.uint64), np.frombuffer(d, np.int64)
                start, group = _groups(fps)
                hit = (np.minimum.reduceat(docs, start) != np.maximum.reduceat(docs, start))[group]
                if hit.any():
                    yield _by_doc(docs[hit], fps[hit])

    def heads(batches):
        for b in batches:
            for bucket, f, d in zip(*(b.column(c).to_pylist() for c in ("bucket", "fps", "docs"))):
                fps, docs = np.frombuffer(f, np.uint64), np.frombuffer(d, np.int64)
                start, _ = _groups(fps)
                low, high = np.minimum.reduceat(docs, start), np.maximum.reduceat(docs, start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([fps[start].tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary()), pa.array([np.where(low != high, MANY, NEW).tobytes()], pa.binary())],
                    names=["bucket", "fps", "docs", "kind"],
                )

    def plain(batches):
        for b in batches:
            for bucket, f, d in zip(*(b.column(c).to_pylist() for c in ("bucket", "fps", "docs"))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([f], pa.binary()), pa.array([d], pa.binary()), pa.array([np.full(len(f) // 8, OLD).tobytes()], pa.binary())], names=["bucket", "fps", "docs", "kind"]
                )

    def merge(bucket, columns):
        fps, docs, kind = np.frombuffer(columns[0], np.uint64), np.frombuffer(columns[1], np.int64), np.frombuffer(columns[2], np.uint8)
        order = np.argsort(fps, kind="stable")
        fps, docs, kind = fps[order], docs[order], kind[order]
        start, group = _groups(fps)
        least, most = np.minimum.reduceat(docs, start), np.maximum.reduceat(docs, start)
        was_open = least == OPEN
        several = np.logical_or.reduceat(kind == MANY, start) | (least != most)
        shared = several & np.logical_or.reduceat(kind != OLD, start)
        for old, wanted in ((False, shared), (True, shared & ~was_open)):
            hit = wanted[group] & (kind == (OLD if old else NEW))
            if hit.any():
                found = _by_doc(docs[hit], fps[hit])
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array([old] * found.num_rows)], names=["id", "blob", "old"])
        opened = fps[start][shared & ~was_open]
        if len(opened):
            yield pa.RecordBatch.from_arrays([pa.array([OPEN], pa.int64()), pa.array([opened.tobytes()], pa.binary()), pa.array([True])], names=["id", "blob", "old"])

    sent = run.mapInArrow(heads, "bucket int, fps binary, docs binary, kind binary")
    if old is not None:
        sent = sent.unionByName(old.mapInArrow(plain, "bucket int, fps binary, docs binary, kind binary"))
    merged = _merge_rows(sent, buckets, merge, "id long, blob binary, old boolean", "fps", "docs", "kind")
    return run.mapInArrow(local, "id long, blob binary").withColumn("old", F.lit(False)).unionByName(merged)


def _first_owner(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For windows sorted by h1: the smallest document of each entry's window."""
    start, group = _groups(h1)
    if (h2 != h2[start][group]).any():  # equal in 64 bits but not in 96: sort by both
        order = np.lexsort((h2, h1))
        new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        group = np.empty(len(h1), np.int64)
        group[order] = np.cumsum(new) - 1
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, docs)
        return least[group]
    return np.minimum.reduceat(docs, start)[group]


#: Rows of the tables between the steps: windows to compare (kind 0), documents with such windows (1), results (2), run pieces (3).
STAGE = "kind int, bucket int, h1 binary, h2 binary, docs binary, row long, id long, text string, done binary, n long, removed long, kept string"
STAGE_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
STAGE_NAMES = [x.split()[0] for x in STAGE.split(", ")]


class _Rows:
    """Rows of the mixed table and the fingerprints to index, of one Arrow batch."""

    def __init__(self, buckets: int, want_text: bool):
        self.columns: dict[str, list] = {c: [] for c in STAGE_NAMES}
        self.buckets, self.want_text = buckets, want_text
        self.fps: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []

    def add(self, kind: int, **values) -> None:
        for c, column_ in self.columns.items():
            column_.append(kind if c == "kind" else values.get(c))

    def result(self, row: int | None, doc: int | None, read: Text, gone: np.ndarray | None = None) -> None:
        """n, removed and the kept words (or their digest) of a document."""
        removed = 0 if gone is None else int(gone.sum())
        joined = b" ".join([w for w, g in zip(read.words(), gone.tolist()) if not g]) if removed else read.joined()
        text = joined.decode("utf-8", "surrogatepass") if self.want_text else hashlib.sha256(joined).hexdigest()
        self.add(2, row=row, id=doc, n=len(read.h), removed=removed, kept=text)

    def index(self, doc: int, fps: np.ndarray) -> None:
        own = distinct(fps)
        self.fps.append(own)
        self.owners.append(np.full(len(own), doc, np.int64))

    def batches(self):
        """Record batches of few rows, as some hold whole texts and some long blobs."""
        if self.fps:
            for piece in _pieces(np.concatenate(self.fps), np.concatenate(self.owners), self.buckets):
                self.add(3, bucket=piece.column(0)[0].as_py(), h1=piece.column(1)[0].as_py(), docs=piece.column(2)[0].as_py())
        for i in range(0, len(self.columns["kind"]), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 500], t) for c, t in zip(self.columns.values(), STAGE_TYPES)], names=STAGE_NAMES)


def _with_hints(texts: DataFrame, hints: DataFrame) -> DataFrame:
    """Hints of a document and then its rows, sorted in one partition; hot ids are spread.

    ``texts``: row, id, text, done, own; ``hints``: id, blob.
    """
    keys = materialize(texts.select("id"), "hinted-ids")
    total = keys.count()
    hot = [r[0] for r in keys.groupBy("id").count().filter(F.col("count") > max(10_000, total // 1024)).select("id").collect()]
    is_hot = F.col("id").isin(hot) if hot else F.lit(False)
    salts = 64 if hot else 1
    t = texts.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    h = hints.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    null = lambda kind: F.lit(None).cast(kind)
    rows = h.select("id", "salt", "blob", null("long").alias("row"), null("string").alias("text"), null("binary").alias("done"), F.lit(False).alias("own"), F.lit(0).alias("side")).unionByName(
        t.select("id", "salt", null("binary").alias("blob"), "row", "text", "done", "own", F.lit(1).alias("side"))
    )
    return rows.repartition("id", "salt").sortWithinPartitions("id", "salt", "side")


def _compare(rows: DataFrame, buckets: int, want_text: bool) -> DataFrame:
    """Settle documents without shared windows; others give window rows and themselves. Earlier owners give windows only."""

    def run(batches):
        at, hint = None, []
        for b in gathered(batches, BATCH):
            out, h1s, h2s, owners, places, texts = _Rows(buckets, want_text), [], [], [], [], []
            for id_, blob, row, own, side, read in zip(*(b.column(c).to_pylist() for c in ("id", "blob", "row", "own", "side")), read_texts(b.column("text"))):
                if id_ != at:
                    at, hint = id_, []
                if side == 0:
                    hint.append(np.frombuffer(blob, np.uint64))
                    continue
                h, least, cand = read.h, read.least, np.empty(0, np.int64)
                if len(least) and hint:
                    cand = np.flatnonzero(np.isin(least, np.concatenate(hint)))
                if not len(cand):
                    if own:
                        out.result(row, id_, read)
                        if len(least):
                            out.index(id_, least)
                    continue
                if own and len(cand) < len(least):
                    out.index(id_, np.delete(least, cand))
                h1s.append(window_hashes(h, SIZE, P1)[cand])
                h2s.append((window_hashes(h, SIZE, P2)[cand] >> np.uint64(32)).astype(np.uint32))
                owners.append(np.full(len(cand), id_, np.int64))
                places.append(cand)
                texts.append((row, id_, read.raw if own else None, own))
            if texts:
                h1, h2, owner = np.concatenate(h1s), np.concatenate(h2s), np.concatenate(owners)
                order = np.argsort(h1, kind="stable")
                first = np.empty(len(h1), np.int64)
                first[order] = _first_owner(h1[order], h2[order], owner[order])
                beaten = first < owner
                # A window that a smaller id of this batch has is settled here; of equal ones one entry travels.
                ends = np.cumsum([len(p) for p in places])
                for (row, id_, text, own), place, lost in zip(texts, places, np.split(beaten, ends[:-1])):
                    if own:
                        out.add(1, row=row, id=id_, text=text.decode("utf-8", "surrogatepass"), done=place[lost].astype(np.uint32).tobytes())
                go = order[~beaten[order]]
                h1, h2, owner = h1[go], h2[go], owner[go]
                fresh = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (owner[1:] != owner[:-1])]) if len(h1) else np.empty(0, bool)
                h1, h2, owner = h1[fresh], h2[fresh], owner[fresh]
                for bucket, s in _by_bucket(h1, buckets):
                    out.add(0, bucket=bucket, h1=h1[s].tobytes(), h2=h2[s].tobytes(), docs=owner[s].tobytes())
            yield from out.batches()

    return rows.mapInArrow(run, STAGE)


def _finish(rows: DataFrame, buckets: int, want_text: bool) -> DataFrame:
    """Take the lost windows out of documents."""

    def run(batches):
        at, hint = None, []
        for b in gathered(batches, BATCH):
            out = _Rows(buckets, want_text)
            for id_, blob, row, done, side, read in zip(*(b.column(c).to_pylist() for c in ("id", "blob", "row", "done", "side")), read_texts(b.column("text"), False)):
                if id_ != at:
                    at, hint = id_, []
                if side == 0:
                    hint.append(np.frombuffer(blob, np.uint64))
                    continue
                n = len(read.h)
                fresh = np.ones(n - SIZE + 1, bool)
                fresh[np.frombuffer(done, np.uint32)] = False
                if hint:
                    fresh &= ~np.isin(window_hashes(read.h, SIZE, P1), np.concatenate(hint))
                out.result(row, id_, read, covered(np.flatnonzero(~fresh), n) if not fresh.all() else None)
            yield from out.batches()

    return rows.mapInArrow(run, STAGE)


def _settle(texts: DataFrame, buckets: int, want_text: bool, copies: bool = False, index: bool = True) -> DataFrame:
    """Results of (row, id, text) rows where they are read: whole copies lose all words, others none."""

    def run(batches):
        for b in gathered(batches, BATCH):
            out = _Rows(buckets, want_text)
            for row, id_, read in zip(*(b.column(c).to_pylist() for c in ("row", "id")), read_texts(b.column("text"), index and not copies)):
                out.result(row, id_, read, np.ones(len(read.h), bool) if copies and len(read.h) >= SIZE else None)
                if len(read.least):
                    out.index(id_, read.least)
            yield from out.batches()

    return texts.select("row", "id", "text").mapInArrow(run, STAGE)


def dedup_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", want_text: bool = False, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``row``, ``id``, ``n``, ``removed`` and ``kept`` of one whole table, fed to an index in batches of about equal numbers of rows by id."""
    _whole_numbers(docs, id_col)
    at, spark, ids = Located(docs), docs.sparkSession, column(id_col)
    index = FingerprintIndex(spark, f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}", bucket_count(at.docs, text_col), fanout)
    cuts = [k / batches for k in range(1, batches)]
    ends = sorted(set(at.docs.agg(F.percentile_approx(ids, cuts, 10_000)).first()[0] or [])) if cuts else []
    out = None
    for low, high in zip([None, *ends], [*ends, None]):
        inside = (F.lit(True) if low is None else ids > low) & (F.lit(True) if high is None else ids <= high)
        batch = at.docs.filter(inside if low is not None else inside | ids.isNull())
        found = index.add(batch, None if low is None else at.docs.filter(ids <= low), id_col, text_col, want_text)
        out = found if out is None else out.unionByName(found)
    index.drop()
    return out


def _whole_numbers(docs: DataFrame, id_col: str) -> None:
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be a whole number")


def _as_open(batches):
    for b in batches:
        docs = [np.full(len(x) // 8, OPEN).tobytes() for x in b.column("h1").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("h1"), b.column("h2"), pa.array(docs, pa.binary())], names=["bucket", "h1", "h2", "docs"])


def _opened(buckets: int):
    def run(batches):
        for b in batches:
            for blob in b.column("blob").to_pylist():
                fps = np.frombuffer(blob, np.uint64)
                for p in _pieces(fps, np.full(len(fps), OPEN), buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), *p.columns], names=["kind", "bucket", "h1", "docs"])

    return run


class FingerprintIndex:
    """Runs of fingerprints on disk, in levels: ``path/runs/level-number``; the newest file of ``path/versions`` lists those that count.

    Batches come in the order of their ids; there is one writer at a time. A run is never changed: compaction writes a merged one and a
    new version, and deletes runs that neither this version nor the one before lists, so a reader of either finds its files.
    ``buckets`` is set when the index is made (a power of two; size it for the corpus it will hold).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, fanout: int = 4):
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.spark, self.path, self.buckets, self.fanout = spark, path, buckets, fanout
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _listed(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _version(self, back: int = 0) -> list[str]:
        """Names of the runs of the newest version, or of one ``back`` before."""
        names = [n for n in self._listed("versions") if n.isdigit()]
        if len(names) <= back:
            return []
        stream = self._fs.open(self._at("versions", names[-1 - back]))
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def _commit(self, runs: list[str]) -> None:
        number = int(([n for n in self._listed("versions") if n.isdigit()] or ["0"])[-1]) + 1
        part = self._at("versions", f".{number}")
        stream = self._fs.create(part, True)
        stream.write("\n".join(runs).encode())
        stream.close()
        self._fs.rename(part, self._at("versions", f"{number:09d}"))
        for name in set(self._listed("runs")) - set(runs) - set(self._version(1)):
            self._fs.delete(self._at("runs", name), True)

    def runs(self) -> list[tuple[int, int]]:
        """(level, number) of each run."""
        return sorted(tuple(map(int, n.split("-"))) for n in self._version())

    def _folders(self, names: list[str], windows: bool) -> list[str]:
        return [f"{self.path}/runs/{n}/{k}" for n in names for k in self._listed(f"runs/{n}") if k.startswith("w") == windows]

    def fingerprints(self, names: list[str] | None = None) -> DataFrame | None:
        """The pieces (bucket, fps, docs) of all runs, or of some."""
        at = self._folders(self._version() if names is None else names, False)
        return self.spark.read.schema("bucket int, h1 binary, docs binary").parquet(*at).withColumnRenamed("h1", "fps") if at else None

    def windows(self, names: list[str] | None = None) -> DataFrame | None:
        """The pieces (bucket, h1, h2) of all runs, or of some."""
        at = self._folders(self._version() if names is None else names, True)
        return self.spark.read.schema("bucket int, h1 binary, h2 binary").parquet(*at) if at else None

    def drop(self) -> None:
        self._fs.delete(self._at(), True)

    def _stage(self, df: DataFrame) -> str:
        """Write a mixed table, a folder for each kind of row."""
        path = f"{self.path}/stage/{uuid.uuid4().hex}"
        df.write.partitionBy("kind").option("compression", "zstd").parquet(path)
        return path

    def _kind(self, paths: list[str], kind: int, *columns: str) -> DataFrame:
        schema = ", ".join(x for x in STAGE.split(", ") if x.split()[0] in columns)
        there = [f"{p}/kind={kind}" for p in paths if self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(f"{p}/kind={kind}"))]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*there)

    def _copies(self, keys: DataFrame) -> DataFrame:
        """``row`` of each row whose text an earlier batch or a smaller id has; notes the batch's texts."""
        texts = keys.filter("th is not null and tl > 0").groupBy("th", "th2", "tl").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        if self._fs.exists(self._at("texts")):
            seen = self.spark.read.schema("th long, th2 int, tl int").parquet(f"{self.path}/texts/*").distinct()
            texts = texts.join(seen.withColumn("seen", F.lit(True)), ["th", "th2", "tl"], "left")
        else:
            texts = texts.withColumn("seen", F.lit(None).cast("boolean"))
        texts = materialize(texts, "texts")
        texts.filter("seen is null").select("th", "th2", "tl").write.parquet(f"{self.path}/texts/{uuid.uuid4().hex}")
        several = texts.filter("seen or first < last").withColumnsRenamed({"th2": "_2", "tl": "_l"})
        return join_hot(keys, several, "th").filter("th2 = _2 and tl = _l and (seen or id > first)").select("row")

    def add(self, batch: DataFrame, history: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", want_text: bool = False) -> DataFrame:
        """Dedup a batch against ``history`` (all documents of earlier batches) and itself, and index it.

        Gives ``row`` (its number in the batch's table), ``id``, ``n``, ``removed`` and ``kept``: the words, or their digest.
        """
        _whole_numbers(batch, id_col)
        shape = lambda rows, row: rows.select(column(row).alias("row"), column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
        at = Located(batch)
        row = spare(at.columns, "row")[0]
        hashed = (F.xxhash64("text").alias("th"), F.hash("text").alias("th2"), F.octet_length("text").alias("tl"))
        keys = materialize(shape(at.numbered(row), row).filter("id is not null").select("id", "row", F.when(F.col("text").isNotNull(), hashed[0]).alias("th"), *hashed[1:]), "keys")
        copies = materialize(self._copies(keys), "copies")
        copied = Marks(at, copies, "row")
        rest = shape(at.pick(copied, row, on=False), row).filter("id is not null")
        run = materialize(make_run(rest, self.buckets), "run")
        hints = materialize(shared_fingerprints(run, self.fingerprints(), self.buckets), "hints")

        # Rows of the batch with a hint, and earlier documents that own a shared fingerprint.
        own = keys.join(hints.filter("not old").select("id").distinct(), "id").select("row").join(copies, "row", "left_anti")
        hinted = Marks(at, own, "row")
        null = F.lit(None).cast("binary").alias("done")
        texts = shape(at.pick(hinted, row), row).select("row", "id", "text", null, F.lit(True).alias("own"))
        if history is not None:
            past = Located(history)
            old = past.numbered(row).select(column(row).alias("row"), column(id_col).cast("long").alias("id"))
            owners = Marks(past, old.join(hints.filter("old").filter(F.col("id") != OPEN).select("id").distinct(), "id").select("row"), "row")
            texts = texts.unionByName(shape(past.pick(owners, row), row).select("row", "id", "text", null, F.lit(False).alias("own")))
        staged = self._stage(_compare(_with_hints(texts, hints.select("id", "blob")), self.buckets, want_text))

        def merge(bucket, columns):
            h1, h2, owner = np.frombuffer(columns[0], np.uint64), np.frombuffer(columns[1], np.uint32), np.frombuffer(columns[2], np.int64)
            order = np.lexsort((owner, h2, h1))
            h1, h2, owner = h1[order], h2[order], owner[order]
            new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            first = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
            lost = first < owner
            if lost.any():
                for b in (_by_doc(owner[lost], h1[lost]),):
                    yield pa.RecordBatch.from_arrays([pa.array([2] * b.num_rows, pa.int32()), pa.array([None] * b.num_rows, pa.int32()), b.column(1), pa.array([None] * b.num_rows, pa.binary()), b.column(0)], names=["kind", "bucket", "h1", "h2", "id"])
            fresh = new & (first != OPEN)  # not in the index yet
            if fresh.any():
                piece = _window_piece(bucket, h1[fresh], h2[fresh])
                yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), *piece.columns, pa.array([None], pa.int64())], names=["kind", "bucket", "h1", "h2", "id"])

        # Windows of the index come before all documents; of equal windows the least document keeps its own.
        compared, known = self._kind([staged], 0, "bucket", "h1", "h2", "docs"), self.windows()
        if known is not None:
            compared = compared.unionByName(known.mapInArrow(_as_open, "bucket int, h1 binary, h2 binary, docs binary"))
        merged = self._stage(_merge_rows(compared, self.buckets, merge, "kind int, bucket int, h1 binary, h2 binary, id long", "h1", "h2", "docs"))
        lost = self._kind([merged], 2, "id", "h1").withColumnRenamed("h1", "blob")
        open_docs = self._kind([staged], 1, "row", "id", "text", "done").withColumn("own", F.lit(True))
        finished = self._stage(_finish(_with_hints(open_docs, lost), self.buckets, want_text))

        # All other rows are settled where they are read.
        settled = self._stage(
            _settle(hinted.of(rest.select("row", "id", "text"), "row", on=False), self.buckets, want_text)
            .unionByName(_settle(shape(at.pick(copied, row), row), self.buckets, want_text, copies=True))
            .unionByName(_settle(shape(at.numbered(row), row).filter("id is null"), self.buckets, want_text, index=False))
        )
        opened = self._stage(hints.filter(F.col("id") == OPEN).select("blob").mapInArrow(_opened(self.buckets), "kind int, bucket int, h1 binary, docs binary"))
        self._keep({"f0": staged, "f1": settled, "f2": opened, "w": merged})
        result = materialize(self._kind([staged, finished, settled], 2, "row", "id", "n", "removed", "kept"), "batch")
        self._fs.delete(self._at("stage"), True)
        self.compact()
        return result

    def _keep(self, stages: dict[str, str]) -> None:
        """Move the run pieces of mixed tables to folders of a run of the lowest level, and commit it."""
        have = self._version()
        name = f"0-{max((n for _, n in self.runs()), default=-1) + 1}"
        self._fs.delete(self._at("runs", name), True)  # what a lost writer left
        self._fs.mkdirs(self._at("runs", name))
        for folder, path in stages.items():
            at = self._jvm.org.apache.hadoop.fs.Path(f"{path}/kind=3")
            if self._fs.exists(at):
                self._fs.rename(at, self._at("runs", name, folder))
        if self._listed(f"runs/{name}"):
            self._commit([*have, name])

    def compact(self) -> None:
        """Merge the runs of each level that has ``fanout`` of them into one of the next level."""
        level = 0
        while True:
            have = self.runs()
            own = [n for lv, n in have if lv == level]
            if len(own) < self.fanout:
                if all(lv <= level for lv, _ in have):
                    return
                level += 1
                continue
            gone = [f"{level}-{n}" for n in own]
            name = f"{level + 1}-{max(n for _, n in have) + 1}"
            if (fps := self.fingerprints(gone)) is not None:
                merge_runs(fps, self.buckets).withColumnRenamed("fps", "h1").write.mode("overwrite").parquet(f"{self.path}/runs/{name}/f0")
            if (windows := self.windows(gone)) is not None:
                merge_windows(windows, self.buckets).write.mode("overwrite").parquet(f"{self.path}/runs/{name}/w")
            self._commit([n for n in self._version() if n not in gone] + [name])
            level += 1
