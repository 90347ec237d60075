"""Sharding by fixed virtual slots (native DataFrame operations only).

Each record hashes into one of ``n_slots`` virtual slots.  The bytes of every slot are aggregated, and a
versioned slot-to-shard map says where a slot lives.  Rebalancing edits the map (a few slots move from heavy
shards to light ones) instead of rehashing records; adding shards moves slots into the new shards only.

The law is ``bytes``: only the shards' sums of sizes bind.  Equal texts are groups for reports; they may stand in
different shards.

Edge cases, each with a defined result: a null text has no bytes (size 1, CRC of the empty string); a null key hashes
to one fixed slot; a very long text moves as its size only; repeated rows share a slot and get successive positions,
ties in any order, which doesn't show; an empty table gives an empty result and keeps the map; columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

#: Thousands of slots: each holds about 1/4096 of the records, so bytes even out and the map stays small.
N_SLOTS = 4096
#: Rebalancing ends when the heaviest and the lightest shard differ by less than a shard's bytes over this.
EVEN = 20_000


def _literal(numbers, kind: str) -> Column:
    """An array of numbers as one literal, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


@dataclass(frozen=True)
class SlotMap:
    """Which shard each virtual slot belongs to; every edit makes a new version."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(1, n_shards, tuple(i % n_shards for i in range(n_slots)))

    def loads(self, slot_bytes: dict[int, int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, size in slot_bytes.items():
            out[self.shards[slot]] += size
        return out

    def rebalanced(self, slot_bytes: dict[int, int]) -> SlotMap:
        """The next version: slots move or swap between the heaviest and lightest shard while that helps."""
        shards = list(self.shards)
        load = self.loads(slot_bytes)
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for slot, size in sorted(slot_bytes.items()):
            if size:
                insort(held[shards[slot]], (size, slot))

        def shift(slot: int, size: int, a: int, b: int) -> None:
            held[a].remove((size, slot))
            insort(held[b], (size, slot))
            shards[slot], load[a], load[b] = b, load[a] - size, load[b] + size

        close = sum(load) // (self.n_shards * EVEN)
        for _ in range(8 * len(shards)):
            hi, lo = max(range(self.n_shards), key=load.__getitem__), min(range(self.n_shards), key=load.__getitem__)
            gap = load[hi] - load[lo]
            if gap <= close:
                break
            best = (gap, None, None)
            at = bisect_left(held[hi], (gap // 2, -1))
            for size, slot in held[hi][max(0, at - 1) : at + 1]:
                best = min(best, (abs(gap - 2 * size), (slot, size), None), key=lambda x: x[0])
            for size, slot in held[lo] if gap < 64 * len(held[hi]) or best[1] is None else held[lo][::8]:
                at = bisect_left(held[hi], (size + gap // 2, -1))
                for other, slot_hi in held[hi][max(0, at - 1) : at + 1]:
                    if other > size:
                        best = min(best, (abs(gap - 2 * (other - size)), (slot_hi, other), (slot, size)), key=lambda x: x[0])
            if best[1] is None or best[0] >= gap:
                break
            shift(*best[1], hi, lo)
            if best[2]:
                shift(*best[2], lo, hi)
        return SlotMap(self.version + 1, self.n_shards, tuple(shards))

    def grown(self, slot_bytes: dict[int, int], more: int = 1) -> SlotMap:
        """The next version with ``more`` shards; slots move only into the new ones."""
        n = self.n_shards + more
        shards, load = list(self.shards), self.loads(slot_bytes) + [0] * more
        target = sum(load) / n
        for new in range(self.n_shards, n):
            for slot, size in sorted(slot_bytes.items(), key=lambda x: (-x[1], x[0])):
                old = shards[slot]
                if old < self.n_shards and load[old] - size >= target * 0.98 and load[new] + size <= target * 1.01:
                    shards[slot], load[old], load[new] = new, load[old] - size, load[new] + size
        return SlotMap(self.version + 1, n, tuple(shards))

    def column(self, slot: Column) -> Column:
        """The shard of a slot, as a lookup in a literal of ``n_slots`` numbers (a fixed, small size)."""
        return F.element_at(_literal(self.shards, "int"), slot + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map table."""
        rows = [(self.version, self.n_shards, slot, shard) for slot, shard in enumerate(self.shards)]
        spark.createDataFrame(rows, "version int, n_shards int, slot int, shard int").coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest by default."""
        df = spark.read.parquet(path)
        version = version or df.agg(F.max("version")).first()[0]
        rows = df.filter(F.col("version") == version).orderBy("slot").collect()  # n_slots rows
        return cls(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))

    @staticmethod
    def stored(spark: SparkSession, path: str) -> bool:
        """Whether a map table is there."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    """The fixed slot of a record; independent of the number of shards."""
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, maps: str | None = None) -> tuple[DataFrame, SlotMap, SlotMap]:
    """Shard by bytes: the rows with their shard and position in it, the map used and the map with one more shard.

    ``maps`` is the path of the map table.  Where there is none, version 1 deals slots out in turn and is stored.
    The latest stored version is edited, the edited one is stored as the next, and rows follow what is stored.

    One scan of the texts; what moves between executors is a few numbers a row.  Rows of a slot are numbered
    within the slot, so no task needs more than one slot of rows; slot offsets come from the slot totals.
    """
    text = F.coalesce("text", F.lit(""))
    sized = materialise(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            virtual_slot(F.col("doc_id"), n_slots).alias("virtual_slot"),
        ),
        "shard-sizes",
    )
    totals = sized.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # n_slots rows at most
    slot_bytes = {r["virtual_slot"]: r["b"] for r in totals}
    spark = docs.sparkSession
    first = SlotMap.initial(n_slots, n_shards)
    if maps and not SlotMap.stored(spark, maps):
        first.save(spark, maps)
    last = SlotMap.load(spark, maps) if maps else first
    if len(last.shards) != n_slots or last.n_shards > n_shards:
        raise ValueError(f"the stored map has {len(last.shards)} slots and {last.n_shards} shards")
    current = last.grown(slot_bytes, n_shards - last.n_shards) if last.n_shards < n_shards else last.rebalanced(slot_bytes)
    if maps:
        current.save(spark, maps)
        current = SlotMap.load(spark, maps)
    grown = current.grown(slot_bytes)
    rows, offset, at = {r["virtual_slot"]: r["n"] for r in totals}, [0] * n_slots, [0] * n_shards
    for slot, shard in enumerate(current.shards):
        offset[slot] = at[shard]
        at[shard] += rows.get(slot, 0)
    slot = F.col("virtual_slot")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")) - 1
    out = sized.withColumn("place", place.cast("long")).select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        current.column(slot).alias("shard"),
        (F.col("place") + F.element_at(_literal(offset, "bigint"), slot + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        slot.alias("virtual_slot"),
        F.lit(current.version).alias("map_version"),
        grown.column(slot).alias("next_version_shard"),
    )
    return out, current, grown
