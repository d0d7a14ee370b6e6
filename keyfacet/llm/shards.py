"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its id and text, out of a few thousand fixed slots. Bytes are
summed per slot, and the map from slots to shards is made from those sums alone: a table of
``n_slots`` rows whatever the input. Rebalancing edits the map and raises its version; records
whose slot keeps its shard stay where they are.

Defined results: null text has no bytes (size 1); null ids hash like any value; rows that are
equal in id and text share a slot; rows that tie in a slot (id and size) go by CRC-32; only a text's size and CRC-32 go on, however
long it is; an empty table has an empty layout; other columns don't count.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLOTS = 4096
CHUNK = 100_000


def slot_of(id_col: str, text_col: str, n_slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot, and the slots' bytes when that was decided."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    bytes_of: tuple[int, ...] = field(repr=False)

    @staticmethod
    def build(bytes_of: list[int], shards: int) -> SlotMap:
        """Largest slot first onto the lightest shard."""
        heap, where = [(0, s) for s in range(shards)], [0] * len(bytes_of)
        for slot in sorted(range(len(bytes_of)), key=lambda s: (-bytes_of[s], s)):
            load, shard = heapq.heappop(heap)
            where[slot] = shard
            heapq.heappush(heap, (load + bytes_of[slot], shard))
        return SlotMap(1, shards, tuple(where), tuple(bytes_of))

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += self.bytes_of[slot]
        return out

    def rebalance(self, bytes_of: list[int], shards: int, slack: float = 0.02) -> SlotMap:
        """The next version for new sums or another number of shards, moving few slots.

        Slots of removed shards move; then the fullest shard gives slots to the lightest one
        until all are within ``slack`` of the mean or no move helps.
        """
        where, load = list(self.shard_of), [0] * shards
        members: list[list[int]] = [[] for _ in range(shards)]
        homeless = []
        for slot, shard in enumerate(where):
            if shard < shards:
                load[shard] += bytes_of[slot]
                members[shard].append(slot)
            else:
                homeless.append(slot)
        for slot in sorted(homeless, key=lambda s: -bytes_of[s]):
            to = min(range(shards), key=lambda s: (load[s], s))
            where[slot], load[to] = to, load[to] + bytes_of[slot]
            members[to].append(slot)
        mean = sum(load) / shards
        for _ in range(len(where)):
            src, dst = max(range(shards), key=lambda s: load[s]), min(range(shards), key=lambda s: load[s])
            if load[src] <= mean * (1 + slack) and load[dst] >= mean * (1 - slack):
                break
            # The largest slot that takes neither past the mean, else the smallest that still helps.
            room = min(load[src] - mean, mean - load[dst])
            fit = [s for s in members[src] if 0 < bytes_of[s] < load[src] - load[dst]]
            if not fit:
                break
            inside = [s for s in fit if bytes_of[s] <= room]
            slot = max(inside, key=lambda s: (bytes_of[s], -s)) if inside else min(fit, key=lambda s: (bytes_of[s], s))
            members[src].remove(slot)
            members[dst].append(slot)
            where[slot], load[src], load[dst] = dst, load[src] - bytes_of[slot], load[dst] + bytes_of[slot]
        return SlotMap(self.version + 1, shards, tuple(where), tuple(bytes_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, i, s, b) for i, (s, b) in enumerate(zip(self.shard_of, self.bytes_of))]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int, bytes long")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map table; earlier versions stay readable."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        table = spark.read.parquet(path)
        version = version if version is not None else table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == version).orderBy("virtual_slot").collect()
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows), tuple(r["bytes"] for r in rows))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS) -> DataFrame:
    """Id, size, CRC-32, slot and number of equal rows; no text goes on.

    Equal rows are counted before anything is shuffled by slot, so copies of one row are one row.
    """
    return (
        docs.select(
            F.col(id_col),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            slot_of(id_col, text_col, n_slots).alias("virtual_slot"),
        )
        .groupBy(id_col, "size", "text_crc32", "virtual_slot")
        .agg(F.count("*").alias("copies"))
    )


def slot_totals(rows: DataFrame, n_slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: at most ``n_slots`` rows reach the driver."""
    n_bytes, n_rows = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.sum("copies").alias("n")).collect():
        n_bytes[r["virtual_slot"]], n_rows[r["virtual_slot"]] = r["b"], r["n"]
    return n_bytes, n_rows


def place(rows: DataFrame, slots: SlotMap, n_rows: list[int], id_col: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``slot``, the place in the shard, gapless from 0.

    Each slot starts where the slots before it in its shard end, so places need only a running
    sum inside a slot: thousands of tasks, not one a shard. Copies of a row are one row there.
    """
    start, at = [0] * len(n_rows), [0] * slots.shards
    for v, shard in enumerate(slots.shard_of):
        start[v] = at[shard]
        at[shard] += n_rows[v]
    spark = rows.sparkSession
    layout = spark.createDataFrame(
        [(v, s, start[v]) for v, s in enumerate(slots.shard_of)], "virtual_slot int, shard int, _start long"
    )
    before = W.partitionBy("virtual_slot").orderBy(F.col(id_col).asc_nulls_first(), "size", "text_crc32")
    numbered = rows.withColumn(
        "_before", F.coalesce(F.sum("copies").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    # The layout has n_slots rows, whatever the input.
    joined = numbered.join(F.broadcast(layout), "virtual_slot")
    parts = joined.withColumn("_k", F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / CHUNK).cast("int"))))
    first = F.col("_k").cast("long") * CHUNK
    copies = parts.withColumn(
        "_i", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("copies")) - 1))
    )
    return copies.withColumn("slot", F.col("_start") + F.col("_before") + F.col("_i"))
