"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased and freed of punctuation. Every n-gram of a test item is a seed, however many
documents hold it: a verdict rests on the document and the item alone, not on how often others
copied the item. A scan aligns each item with the passages around its seeds, unless too few of its
words are there to reach the threshold; what scores over it is a copy, edited ones included.

No text is shuffled. The test items are broadcast in blocks of a set size, one scan a block.

Defined results: null or blank texts and items match nothing; items of fewer words than ``n`` can't be
seeded and match nothing, nor does an edited copy that keeps no ``n`` words in a row; equal items are scored apart; repeated documents give repeated rows; of places that tie in
score the first counts; whole texts are scanned, however long; an empty table of documents or items gives no rows; other columns don't count.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from keyfacet.llm.common import column, sliced

PUNCT = bytes(c for c in range(128) if not chr(c).isalnum())
TO_SPACE = bytes.maketrans(PUNCT, b" " * len(PUNCT))
WIDE_PUNCT = "«»“”‘’„…–—¿¡ "
MATCH, MISS, GAP = 2, -1, -1
ALONE = -1
GROUP = 256


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        for c in WIDE_PUNCT:
            if c in low:
                low = low.replace(c, " ")
    return low.encode("utf-8", "surrogatepass").translate(TO_SPACE).split()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of two word-id arrays and where it ends and about begins in ``passage``.

    A row of the table at a time; the gap along the row is a running maximum.
    """
    n = len(passage)
    steps = np.arange(n + 1) * -GAP
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, best_end, best_begin = 0, 0, 0
    for w in item.tolist():
        step = np.where(passage == w, MATCH, MISS) if w != ALONE else np.full(n, MISS)
        diag, up = row[:-1] + step, row[1:] + GAP
        new, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = diag >= up
        new[1:], origin[1:] = np.where(take, diag, up), np.where(take, begin[:-1], begin[1:])
        low = new < 0
        new[low], origin[low] = 0, np.flatnonzero(low)
        lifted = new + steps
        top = np.maximum.accumulate(lifted)
        along = top > lifted
        if along.any():
            source = np.maximum.accumulate(np.where(along, 0, np.arange(n + 1)))
            better = along & (top - steps > 0)
            origin = np.where(better, origin[source], origin)
            new = np.where(better, top - steps, new)
        at = int(np.argmax(new))
        if new[at] > best:
            best, best_end, best_begin = int(new[at]), at, int(origin[at])
        row, begin = new, origin
    return best, best_begin, best_end


class ItemIndex:
    """Word ids, n-grams and places of one block of test items."""

    def __init__(self, items: list[tuple], n: int):
        self.n, self.vocab = n, {}
        self.ids, self.names = [], []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        texts = [(name, plain_words(text)) for name, text in items]
        for _, words in texts:
            for w in words:
                self.vocab.setdefault(w, len(self.vocab))
        self.base = len(self.vocab) + 1
        if self.base**n >= 1 << 62:
            raise ValueError("too many distinct words for exact n-gram keys: use smaller blocks of items")
        for name, words in texts:
            ids = np.array([self.vocab[w] for w in words], np.int64)
            keys = self.keys(ids)
            if len(keys):
                for at, key in enumerate(keys.tolist()):
                    self.places[key].append((len(self.ids), at))
                self.ids.append(ids)
                self.names.append(name)
        self.grams = np.array(sorted(self.places), np.int64)

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """An exact key for each n-gram; -1 where it holds a word that no item has."""
        m = len(ids) - self.n + 1
        if m <= 0:
            return np.empty(0, np.int64)
        out, ok = np.zeros(m, np.int64), np.ones(m, bool)
        for j in range(self.n):
            part = ids[j : j + m]
            ok &= part >= 0
            out = out * self.base + part
        return np.where(ok, out, -1)

    def scan(self, texts: list[str | None]):
        """(document number, word position, key) of every n-gram of the items, and the word ids with their starts."""
        get, flat, starts = self.vocab.get, [], [0]
        for t in texts:
            flat.extend(map(get, plain_words(t), repeat(ALONE)))
            flat.append(ALONE)
            starts.append(len(flat))
        ids = np.array(flat, np.int64)
        keys = self.keys(ids)
        at = np.flatnonzero(keys >= 0)
        if len(at) and len(self.grams):
            place = np.minimum(np.searchsorted(self.grams, keys[at]), len(self.grams) - 1)
            at = at[self.grams[place] == keys[at]]
        else:
            at = at[:0]
        starts = np.array(starts, np.int64)
        return np.searchsorted(starts, at, side="right") - 1, at, keys[at], ids, starts

    def hits(self, texts: list[str | None], least: float):
        """(document number, item, score, seeds, begin, end) of every copy."""
        doc, at, key, ids, starts = self.scan(texts)
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for d, p, k in zip(doc.tolist(), at.tolist(), key.tolist()):
            for item, q in self.places[k]:
                found[d, item].append((p, q))
        for (d, item), seen in sorted(found.items()):
            own, lo, hi = self.ids[item], int(starts[d]), int(starts[d + 1]) - 1
            pad = len(own) // 2 + 4
            spans: list[list[int]] = []
            for p, q in sorted(seen, key=lambda s: s[0] - s[1]):
                a, b = max(lo, p - q - pad), min(hi, p - q + len(own) + pad)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            best = (0, 0, 0)
            need = least * MATCH * len(own)
            size = np.bincount(own, minlength=self.base)
            for a, b in spans:
                part = ids[a:b]
                common = np.minimum(np.bincount(part[part >= 0], minlength=self.base), size).sum()
                if common * MATCH >= need:
                    score, begin, end = align(own, part)
                    if score > best[0]:
                        best = (score, a + begin - lo, a + end - lo)
            if best[0] >= need and best[0]:
                yield d, self.names[item], best[0] / (MATCH * len(own)), len(seen), best[1], best[2]


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = 3, least: float = 0.5, block_items: int = 5_000, block_chars: int = 20_000_000,
) -> DataFrame:
    """One row for each document and item it holds a copy of: score from ``least`` to 1, seeds, words from and to.

    ``block_items`` and ``block_chars`` bound what is gathered and broadcast at once; more items than that are
    taken in several blocks, each against all documents.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_col].dataType
    texts, out = docs.select(column(id_col).alias("id"), column(text_col).alias("text")), None
    for index in _blocks(texts.sparkSession, items, item_col, item_text_col, n, block_items, block_chars):
        part = _aligned(texts, index, least, id_type, item_type)
        out = part if out is None else out.unionByName(part)
    return out.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.round("score", 6).alias("score"), "n_seeds", "word_from", "word_to"
    )


def _blocks(spark: SparkSession, items: DataFrame, item_col: str, item_text_col: str, n: int, block_items: int, block_chars: int):
    """The broadcast index of each block of items, one block at a time."""
    context = spark.sparkContext
    wanted = items.select(column(item_col).alias("item"), column(item_text_col).alias("text")).filter("text is not null")
    count, chars = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // block_items), -(-chars // block_chars))
    for k in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").collect()
        yield context.broadcast(ItemIndex([tuple(r) for r in block], n))


def _aligned(texts: DataFrame, index, least: float, id_type: str, item_type: DataType) -> DataFrame:
    kind = to_arrow_type(item_type)

    def run(batches):
        own = index.value
        for part in sliced(batches, GROUP):
            rows = list(own.hits(part.column(1).to_pylist(), least))
            if rows:
                doc, item, score, count, start, end = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc, pa.int64())), pa.array(item, kind), pa.array(score, pa.float64()),
                     pa.array(count, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                    names=["id", "item", "score", "n_seeds", "word_from", "word_to"],
                )

    return texts.mapInArrow(run, f"id {id_type}, item {item_type.simpleString()}, score double, n_seeds int, word_from int, word_to int")


def drop_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3,
    least: float = 0.5, block_items: int = 5_000, block_chars: int = 20_000_000,
) -> DataFrame:
    """The rows of ``docs`` that hold no copy of any item, as :func:`find_leaks` finds them; decided where a row is read."""
    schema = docs.schema
    for index in _blocks(docs.sparkSession, items, item_col, item_text_col, n, block_items, block_chars):

        def run(batches, index=index):
            own = index.value
            at = schema.fieldNames().index(text_col)
            for part in sliced(batches, GROUP):
                bad = {h[0] for h in own.hits(part.column(at).to_pylist(), least)}
                yield part.filter(pa.array([k not in bad for k in range(part.num_rows)], pa.bool_())) if bad else part

        docs = docs.mapInArrow(run, schema)
    return docs
