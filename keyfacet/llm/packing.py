"""Best-fit packing of token sequences with bounds that certify each partition.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to partitions of a set
size; each is packed best-fit decreasing and its bin count is compared with a lower bound from
dual feasible functions. A partition that meets its bound is proven minimal and closed. The
others release their emptiest bins; those exchange pieces in new, fewer partitions and are
packed again, until every partition is certified or no bin is gained.

Only numbers travel: token ids are reduced to length and CRC-32 where the text is read.

Defined results: null or empty text is one piece with the closing id alone; repeated rows are
separate documents; pieces of one length keep their order; an empty table packs into nothing; other columns don't count.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfacet.llm.common import materialize, mix64, n_buckets, sliced, worker_cache

TAIL = b".,|!?;:$%&*#-"
LATIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+").fullmatch  # letters whose lower case is one letter of this range, in NFC
LETTERS = frozenset(chr(c) for c in range(256) if chr(c).isalpha())
KINDS = np.array([1 if chr(c) in LETTERS else 2 if 48 <= c < 58 else 3 if 32 < c < 127 and c != 39 else 0 for c in range(256)], np.uint8)
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE_WORDS = 250_000
SEEN = 1 << 24
SLICE = 1000


class WordTokenizer:
    """Token ids of whole texts, by a cache of words.

    The tokenizer drops white space and never merges across it, so the ids of a text are the ids of
    its words one after another. Each distinct word is encoded once a worker while the cache lasts;
    plain words are encoded many at a time and cut apart at the word-end tokens. A word stays in the
    cache from its second use on, so the many words that never return take no memory; a full cache
    keeps the words of the texts at hand.

    Lower-case Latin words skip the normalizer, over a third of the tokenizer's time, if the file's
    normalizer is known to leave them as they are.

    If the file's pre-tokenizer is known too, Latin-1 texts are lowered and cut between letters, digits and
    punctuation before they are looked up, so that a word has one entry whatever its case and what it stands next to. These
    entries are strings, the others bytes of UTF-8.
    """

    def __init__(self, path: str):
        state = worker_cache(cache_name(path))
        if not state:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            ends = np.zeros(tok.get_vocab_size(with_added_tokens=True) + 1, bool)
            for token, i in tok.get_vocab(with_added_tokens=True).items():
                ends[i] = token.endswith("</w>")
            bare = None
            if lowers_only(tok.normalizer):
                bare = Tokenizer(tok.model)  # shares the model
                bare.pre_tokenizer = tok.pre_tokenizer
            whole = None
            if bare and splits_kinds(tok.pre_tokenizer):  # what a text that is cut must not hold: added tokens, and the mark between texts
                whole = [*(t.content.lower() for t in tok.get_added_tokens_decoder().values()), "\x1c"]
            state |= {"tok": tok, "bare": bare, "whole": whole, "ends": ends, "ids": {}, "seen": bytearray(SEEN)}
        self.tok, self.bare, self.whole, self.ends, self.ids, self.seen = (state[k] for k in ("tok", "bare", "whole", "ends", "ids", "seen"))

    def _one(self, words: list[str], tok=None) -> list[bytes]:
        return [
            np.array(e.ids, "<u4").tobytes()
            for i in range(0, len(words), 500)  # what the tokenizer returns takes far more than the ids
            for e in (tok or self.tok).encode_batch_fast(words[i : i + 500], add_special_tokens=False)
        ]

    def _plain(self, words: list[str], tok) -> list[bytes]:
        """Ids of words of letters only: one pre-token each, closed by a word-end token."""
        out: list[bytes] = []
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            ids = np.array(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or (len(stops) and stops[-1] != len(ids)):
                out += self._one(part, tok)
            else:
                raw = ids.tobytes()
                out += [raw[a * 4 : b * 4] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
        return out

    def learn(self, new: set) -> set:
        """Add words to the cache: a word of letters and what it may end in, or any other word.

        Returns all that was added, the parts of words included.
        """
        lowered = {w for w in new if type(w) is str}
        if lowered:
            plain = [w for w in lowered if w.isalpha()]
            odd = [w for w in lowered if not w.isalpha()]
            self.ids.update(zip(plain, self._plain(plain, self.bare)))
            self.ids.update(zip(odd, self._one(odd, self.bare)))
        return lowered | self._learn_raw(new - lowered) if len(lowered) < len(new) else lowered

    def _learn_raw(self, new: set[bytes]) -> set[bytes]:
        ids, made, cores, letters, tails, odd = self.ids, [], set(), set(), set(), []
        for raw in new:
            core = raw.rstrip(TAIL)
            if core.isalpha():  # of bytes: ASCII letters only
                low = core.lower()
                cores.add(low)
            elif core and not core.isascii() and (text := core.decode("utf-8", "surrogatepass")).isalpha():
                if self.bare and LATIN(text):
                    low = text.lower().encode()
                    cores.add(low)
                else:
                    low = core
                    letters.add(low)
            else:
                odd.append(raw)
                continue
            if len(core) < len(raw):
                tail = raw[len(core) :]
                tails.add(tail)
                made.append((raw, low, tail))
            elif low != raw:
                made.append((raw, low, b""))
        cores, letters, tails = list(cores.difference(ids)), list(letters.difference(ids)), list(tails.difference(ids))
        ids.update(zip(cores, self._plain([c.decode() for c in cores], self.bare or self.tok)))
        ids.update(zip(letters, self._plain([c.decode("utf-8", "surrogatepass") for c in letters], self.tok)))
        ids.update(zip(tails, self._one([t.decode() for t in tails])))
        ids[b""] = b""
        for raw, low, tail in made:
            ids[raw] = ids[low] + ids[tail]
        ids.update(zip(odd, self._one([w.decode("utf-8", "surrogatepass") for w in odd])))
        return new.union(cores, letters, tails)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, seen = self.ids, self.seen
        cut = [(i, low) for i, t in enumerate(texts) if (low := self._lowered(t)) is not None]
        split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts] if len(cut) < len(texts) else []
        for i, _ in cut:
            if split:
                split[i] = []
        used = set().union(*split)
        if cut:
            words = pc.ascii_split_whitespace(pa.array(apart("\x1c".join(low for _, low in cut)).split("\x1c"), pa.string()))
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            used.update(distinct)
        new = used.difference(ids)
        added = self.learn(new) if new else ()
        out = [b"".join(map(ids.__getitem__, words)) for words in split] or [b""] * len(texts)
        if cut:
            found = pa.array([ids[w] for w in distinct], pa.large_binary()).take(coded.indices)
            ends = np.frombuffer(found.buffers()[1], np.int64)[words.offsets.to_numpy()].tolist()
            raw = memoryview(found.buffers()[2])
            for (i, _), a, b in zip(cut, ends, ends[1:]):
                out[i] = bytes(raw[a:b])
        for word in added:
            at = hash(word) % SEEN
            if not seen[at]:
                seen[at] = 1
                del ids[word]
        if len(ids) > CACHE_WORDS:
            kept = {word: ids[word] for word in used.intersection(ids)}
            ids.clear()
            ids.update(kept)
            seen[:] = bytes(SEEN)
        return out

    def _lowered(self, text: str | None) -> str | None:
        """The text in lower case if it may be cut."""
        if text and self.whole is not None and latin1(text):
            low = text.lower()
            if not any(x in low for x in self.whole):
                return low
        return None


def cache_name(path: str) -> str:
    return "tokenizer:" + path


def lowers_only(normalizer) -> bool:
    """Whether a normalizer does no more than NFC, lower case and white space to one blank."""
    state = json.loads(normalizer.__getstate__()) if normalizer else {}
    parts = state.get("normalizers", [state])
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    return {"type": "Lowercase"} in parts and all(p in ({"type": "NFC"}, {"type": "Lowercase"}, blank) for p in parts)


def splits_kinds(pre_tokenizer) -> bool:
    """Whether a pre-tokenizer is the one that parts letters, digits and other characters, but for letters after an apostrophe."""
    state = json.loads(pre_tokenizer.__getstate__()) if pre_tokenizer else {}
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    return state.get("pretokenizers") == [split, level]


def latin1(text: str) -> bool:
    """Whether all characters are below 256: NFC leaves them, and each has one lower-case letter of this range."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def apart(low: str) -> str:
    """A Latin-1 text with a blank wherever letters, digits or ASCII punctuation meet; none beside an apostrophe."""
    raw = np.frombuffer(low.encode("latin-1"), np.uint8)
    kind = KINDS[raw]
    at = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    out = np.full(len(raw) + len(at), 32, np.uint8)
    old = np.ones(len(out), bool)
    old[at + np.arange(len(at))] = False
    out[old] = raw
    return out.tobytes().decode("latin-1")


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and a ``deal`` number."""
    end = end_id.to_bytes(4, "little")
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, deal long"

    def run(batches):
        tok, task, seen = WordTokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        for part in sliced(batches, SLICE, text=1, keep=cache_name(tokenizer_path)):
            row, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(tok.encode(part.column(1).to_pylist())):
                raw += end
                for k in range(0, len(raw), 4 * capacity):
                    cut = raw[k : k + 4 * capacity]
                    row.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            deal = mix64(np.arange(seen, seen + len(row), dtype=np.uint64) + (np.uint64(task) << np.uint64(40)))
            seen += len(row)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array((deal >> np.uint64(1)).astype(np.int64))],
                names=[id_col, "piece", "start", "length", "ids_crc32", "deal"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Longest first, into the fullest bin that fits."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: a bin with room r is open
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        where[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return where, offset, n


def lower_bound(counts: np.ndarray, capacity: int, most_k: int = 60) -> int:
    """Bins that any packing needs; ``counts[s]``: items of size s, 0 to ``capacity``.

    The largest of: the sum of sizes; for each e up to half the capacity, the function that rounds
    sizes over ``capacity - e`` up to it and sizes under e down to 0; for each k, the function that
    rounds sizes to multiples of ``capacity / k``; each divided by the capacity.
    """
    c, size = counts.astype(np.int64), np.arange(capacity + 1, dtype=np.int64)
    number, total = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * size)])
    e = np.arange(capacity // 2 + 1)
    big = number[-1] - number[capacity - e + 1]  # sizes over capacity - e
    middle = total[capacity - e + 1] - total[e]  # sizes from e to capacity - e
    best = int(np.max(-(-(big * capacity + middle) // capacity)))
    for k in range(1, most_k + 1):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, scaled // capacity * capacity)  # times capacity * k
        best = max(best, -(-int((c * value).sum()) // (capacity * k)))
    return best


def pack(rows: DataFrame, capacity: int = 2048, per_partition: int = 50_000, least_open: int = 256) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``certified`` to rows with ``length`` and ``deal``.

    Partitions hold about ``per_partition`` pieces at any input size. Each round shuffles only
    the bins that uncertified partitions released, so later rounds are far smaller. Rounds end when all partitions
    are certified or one gains no bin.
    """
    carried = [c for c in rows.columns if c != "deal"]
    kept_types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    schema = f"{kept_types}, sequence_id long, offset long, certified boolean, open boolean"
    spark = rows.sparkSession

    def packer(round_no: int):
        def run(t: pa.Table) -> pa.Table:
            lengths = t.column("length").to_numpy()
            where, offset, n = best_fit_decreasing(lengths, capacity)
            bucket = t.column("_bucket")[0].as_py()
            base = (round_no << 52) + (bucket << 26)
            seq = base + where
            if round_no > 1:
                old = t.column("sequence_id").to_numpy()
                kept, local = np.unique(old, return_inverse=True)
                if len(kept) <= n:
                    seq, where, offset, n = old, local, t.column("offset").to_numpy(), len(kept)
            bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            open_rows = np.zeros(len(lengths), bool)
            if n > bound:
                fill = np.bincount(where, weights=lengths, minlength=n)
                most = min(n, max(least_open, 16 * (n - bound)))
                emptiest = np.argsort(fill, kind="stable")[:most]
                chosen = np.zeros(n, bool)
                chosen[emptiest] = fill[emptiest] < capacity
                open_rows = chosen[where]
            return pa.table(
                [t.column(c) for c in carried] + [pa.array(seq), pa.array(offset), pa.array(np.full(len(lengths), n <= bound)), pa.array(open_rows)],
                names=[*carried, "sequence_id", "offset", "certified", "open"],
            )

        return run

    count = rows.count()
    parts = n_buckets(count, per_partition)
    state = materialize(
        rows.withColumn("_bucket", F.pmod("deal", F.lit(parts))).groupBy("_bucket").applyInArrow(packer(1), schema), "packed1"
    )
    closed, round_no = [], 1
    bins = lambda rows: rows.filter("offset = 0").count()
    while n_open := (released := state.filter("open")).count():
        before, round_no = bins(released), round_no + 1
        closed.append(state.filter("not open"))
        parts = min(n_buckets(n_open, per_partition), max(1, parts // 2))
        state = materialize(
            released.withColumn("_bucket", F.pmod(F.xxhash64("sequence_id"), F.lit(parts)))
            .groupBy("_bucket").applyInArrow(packer(round_no), schema),
            f"packed{round_no}",
        )
        if bins(state) == before:
            break
    for part in closed:
        state = state.unionByName(part)
    return state.drop("open")


def certificate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """Bins used and the lower bound for the whole table, from at most ``capacity`` rows of counts."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return packed.filter("offset = 0").count(), lower_bound(counts, capacity)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    made = materialize(pieces(docs, tokenizer_path, capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(made, capacity, **how)
