"""Shared helpers: table reading, written intermediate tables, word splitting."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

WORD_SQL = r"[^\x20\x09-\x0D]+"
_OWN_DIR: dict[str, str] = {}


BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send texts to Python in smaller Arrow batches than Spark's 10,000 rows, unless the session sets a number.

    A batch is built outside the heap of each running task; 10,000 long texts take more than a task's share.
    """
    if spark.conf.get(BATCH_KEY) == "10000" and not spark.sparkContext.getConf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a temporary folder; on a cluster a
    missing setting is an error, because executors need a folder that they all see.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = tempfile.mkdtemp(prefix="keyfacet-")
        import shutil

        atexit.register(shutil.rmtree, _OWN_DIR["dir"], True)
    return "file://" + _OWN_DIR["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage at a table that survives the loss of executors.
    """
    spark = df.sparkSession
    text_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table written by :func:`materialize` that no later plan reads."""
    spark = df.sparkSession
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    base = shared_dir(spark).replace("file://", "")
    jvm = spark.sparkContext._jvm
    for root in roots:
        if base in root:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def worker_cache(name: str) -> dict:
    """A dict that lives in the Python worker until :func:`forget` drops it, whatever task uses it."""
    return sys.__dict__.setdefault("_keyfacet_cache", {}).setdefault(name, {})


def forget(keep: str | None = None) -> None:
    """Drop the worker's caches but ``keep``, and give their memory back: the tasks that used them are over."""
    held = sys.__dict__.get("_keyfacet_cache", {})
    if over := [name for name in held if name != keep]:
        for name in over:
            del held[name]
        release_memory()


def sliced(batches, rows: int = 1000, text: int | None = None, most: int = 1 << 20, keep: str | None = None):
    """Arrow batches in parts of at most ``rows`` rows; at the end of a task its free memory is given back.

    A worker outlives its tasks and keeps what they touched, so unreturned memory of one stage
    would add to that of the next. For the same reason caches of other stages are dropped, all but ``keep``.
    ``text``: the column of which a part holds at most ``most`` bytes, or one row.
    """
    forget(keep)
    try:
        for b in batches:
            i, size = 0, _ends(b.column(text)) if text is not None else None
            while i < b.num_rows:
                end = i + rows
                if size is not None:
                    end = min(end, _fits(size, i, most))
                yield b.slice(i, end - i)
                i = end
    finally:
        release_memory()


def _ends(texts: pa.Array) -> np.ndarray:
    """Bytes of the texts up to and with each; null: none."""
    return np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))


def _fits(size: np.ndarray, i: int, most: int) -> int:
    """The end of the part from ``i`` on that holds at most ``most`` bytes, or one text."""
    return max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))


def text_parts(texts: pa.Array, most: int):
    """A column of texts in parts of at most ``most`` bytes, or one text."""
    i, size = 0, _ends(texts)
    while i < len(texts):
        end = _fits(size, i, most)
        yield texts.slice(i, end - i)
        i = end


def gathered(batches, rows: int):
    """Arrow batches put together to ``rows`` rows or a little more; memory as in :func:`sliced`."""
    held: list[pa.RecordBatch] = []
    try:
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= rows:
                yield pa.concat_batches(held)
                held = []
        if held:
            yield pa.concat_batches(held)
    finally:
        release_memory()


def release_memory() -> None:
    import ctypes
    import gc

    gc.collect()
    if not sys.__dict__.setdefault("_keyfacet_frozen", False):
        gc.freeze()  # imported modules: later collections, a few a task, leave them out; what isn't in a cycle is freed as ever
        sys.__dict__["_keyfacet_frozen"] = True
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; null: none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def crc32_of(text: str) -> int:
    return zlib.crc32(text.encode())


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64 on uint64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit xxh3 of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def binary_array(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


def n_buckets(n_rows: int, per_bucket: int, least: int = 1) -> int:
    """Buckets of about ``per_bucket`` rows; grows with the input."""
    return max(least, -(-int(n_rows) // per_bucket))


def with_columns_like(df: DataFrame, template: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) for c in template.columns])


def join_hot(left: DataFrame, right: DataFrame, key: str, most: int = 1024, least: int = 100_000, counted: DataFrame | None = None, salts: int = 256) -> DataFrame:
    """Inner join on ``key`` where ``left`` may have hot keys and ``right`` has each key once.

    Keys with more than 1 in ``most`` of the left rows (there are fewer than ``most`` of them, whatever the
    data) are spread: their left rows over ``salts`` parts by a hash, their row of ``right`` copied to each.
    Keys are counted in ``counted``, a written table with the same keys, or in ``left`` itself.
    """
    counted = left if counted is None else counted
    total = counted.count()
    hot = []
    if total > least:
        hot = [r[0] for r in counted.groupBy(key).count().filter(F.col("count") > max(least, total // most)).select(key).collect()]
    if not hot:
        return left.join(right, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salt = spare([*left.columns, *right.columns], "__salt")[0]
    # The other columns decide, so equal rows share a part.
    dealt = left.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(*map(column, left.columns)), F.lit(salts)).cast("int")).otherwise(0))
    copies = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return dealt.join(right.withColumn(salt, copies), [key, salt]).drop(salt)


def spare(columns, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has that name."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain_scan(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` is a row of one Parquet table: a scan under deterministic columns and filters."""

    def fits(plan) -> bool:
        children = plan.children()
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation") or not plan.deterministic() or children.size() > 1:
            return False
        return all(fits(children.apply(i)) for i in range(children.size()))

    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
        return fits(docs._jdf.queryExecution().analyzed())
    except AnalysisException:
        return False


class Located:
    """A table whose rows have numbers that any later scan gives again: file and place in the file.

    Later steps then send row numbers instead of texts, and rows are chosen where they are read. A table
    that isn't a plain scan of Parquet files (columns and filters apart) is written once first.
    """

    def __init__(self, docs: DataFrame):
        self.docs = docs if plain_scan(docs) else materialize(docs, "located")
        self.columns = self.docs.columns
        paths = sorted({f.replace(":///", ":/") for f in self.docs.inputFiles()})
        # From Arrow: rows given as Python objects would start a second set of Python workers on every executor.
        listed = pa.table({"__no": pa.array(range(len(paths)), pa.int64()), "__path": pa.array(paths, pa.string())})
        self.files = docs.sparkSession.createDataFrame(listed)

    def path(self) -> Column:
        return F.replace(self.docs.metadataColumn("_metadata")["file_path"], F.lit(":///"), F.lit(":/"))

    def numbered(self, name: str, part: Column | None = None) -> DataFrame:
        """All columns and each row's number. ``part``: a condition on :meth:`path`, by which files are left unread."""
        docs = self.docs if part is None else self.docs.filter(part)
        path, at = spare([*self.columns, name, "__no", "__path"], "__file", "__at")
        rows = docs.select(*map(column, self.columns), self.path().alias(path), self.docs.metadataColumn("_metadata")["row_index"].alias(at))
        files = self.files.withColumnsRenamed(dict(zip(("__no", "__path"), spare(rows.columns, "__no", "__path"))))
        no = files.columns[0]
        # One row a file is broadcast.
        named = rows.join(F.broadcast(files), rows[path] == files[files.columns[1]], "left")
        number = F.coalesce(F.shiftleft(no, 40), F.raise_error(F.lit("a file that wasn't listed")).cast("long"))
        return named.select(*map(column, self.columns), number.bitwiseOR(F.col(at)).alias(name))

    def pick(self, marks: Marks, name: str, on: bool = True) -> DataFrame:
        """The marked rows, or the others, with all columns and their number."""
        group = F.pmod(F.xxhash64(self.path()), F.lit(marks.groups))
        parts = [None] if marks.groups == 1 else [group == k for k in range(marks.groups)]
        return _union(marks.choose(self.numbered(name, part), name, on, k) for k, part in enumerate(parts))


class Marks:
    """A set of row numbers of a :class:`Located` table as bits, 4096 rows a record.

    The bits are broadcast, at most ``most`` records at once (75 MB for half a billion rows): beyond that, the
    table's files are taken in groups, each with its own bits. The plan of a group is the same at every size.
    """

    def __init__(self, at: Located, rows: DataFrame, name: str, most: int = 1 << 17):
        long = lambda n: F.lit(n).cast("long")
        word = F.shiftright(column(name), 6)
        bit = F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))")
        words = rows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
        chunks = words.groupBy(F.shiftright("word", 6).alias("chunk")).agg(
            F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(long(63)), "bits"))).alias("m")
        )
        bits = F.transform(F.sequence(long(0), long(63)), lambda i: F.coalesce(F.try_element_at("m", i), long(0)))
        self.table = materialize(chunks.select("chunk", bits.alias("bits")), "marks")
        self.groups = max(1, -(-self.table.count() // most))
        self.at = at

    def choose(self, rows: DataFrame, name: str, on: bool = True, group: int = 0) -> DataFrame:
        """The rows of one group of files whose number ``name`` is marked, or isn't."""
        table = self.table
        if self.groups > 1:
            own = self.at.files.filter(F.pmod(F.xxhash64("__path"), F.lit(self.groups)) == group).select("__no")
            table = table.join(F.broadcast(own), F.shiftright("chunk", 28) == F.col("__no"), "left_semi")
        chunk, bits = spare(rows.columns, "__chunk", "__bits")
        table = table.select(F.col("chunk").alias(chunk), F.col("bits").alias(bits))
        number = column(name)
        joined = rows.join(F.broadcast(table), F.shiftright(number, 12) == F.col(chunk), "inner" if on else "left")
        bit = F.expr(f"getbit(get(`{bits}`, cast(shiftright(`{name}`, 6) & 63 as int)), cast(`{name}` & 63 as int))")
        return joined.filter(bit == 1 if on else F.coalesce(bit, F.lit(0).cast("tinyint")) == 0).select(*map(column, rows.columns))

    def of(self, rows: DataFrame, name: str, on: bool = True) -> DataFrame:
        """The rows of any table with a column of row numbers that are marked, or aren't."""
        if self.groups == 1:
            return self.choose(rows, name, on)
        no, group = spare(rows.columns, "__no", "__group")
        files = self.at.files.select(F.col("__no").alias(no), F.pmod(F.xxhash64("__path"), F.lit(self.groups)).alias(group))
        named = rows.join(F.broadcast(files), F.shiftright(column(name), 40) == F.col(no))
        return _union(self.choose(named.filter(F.col(group) == k).select(*map(column, rows.columns)), name, on, k) for k in range(self.groups))


def _union(parts) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component``, its smallest node, for undirected ``edges`` (a, b); by alternating stars.

    Each round rewires every node to its least neighbour (large star, then small star) and writes the
    edges; it ends when a round changes nothing. Rounds grow with the logarithm of the diameter.
    """

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, small: bool, label: str) -> DataFrame:
        if small:  # a above b: link a and its lower neighbours to the least of them
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        else:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        e = materialize(e, name)
        least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = join_hot(e, least, "a")
        if small:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        else:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return materialize(out.filter("a <> b").distinct(), name + label)

    current = materialize(edges.filter("a <> b").select("a", "b").distinct(), name)
    seen = digest(current)
    while True:
        after = star(star(current, False, "-large"), True, "-small")
        now = digest(after)
        discard(current)
        current = after
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
