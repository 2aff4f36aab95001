"""Sharding through fixed virtual slots, in DataFrame expressions only.

A record belongs for good to one of some thousands of virtual slots, by the MD5 of
its id. Bytes and rows are added up per slot (partial sums, at most ``N_SLOTS``
rows reach the driver whatever the input), and a versioned map says which shard
holds each slot. Rebalancing edits the map: it moves slots, never single records.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.session import shared_dir

N_SLOTS = 4096  # three hex digits of the MD5


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot; ``edits`` are the moves since the last version."""

    n_shards: int
    shard_of: tuple[int, ...]
    version: int = 0
    edits: tuple[tuple[int, int, int], ...] = field(default=())  # slot, from, to

    @classmethod
    def initial(cls, n_shards: int) -> SlotMap:
        """Version 0: equal ranges of slots."""
        return cls(n_shards, tuple(s * n_shards // N_SLOTS for s in range(N_SLOTS)))

    def rebalanced(self, slot_bytes: dict[int, int]) -> SlotMap:
        """The next version: slots move from the fullest to the emptiest shard while that lowers the difference.

        Each move takes the slot nearest to half the difference, so the sum of
        squares falls with every move and the loop ends.
        """
        held = [sorted((slot_bytes.get(s, 0), s) for s in range(N_SLOTS) if self.shard_of[s] == k and slot_bytes.get(s, 0)) for k in range(self.n_shards)]
        load = [sum(b for b, _ in x) for x in held]
        shard_of, edits = list(self.shard_of), []
        while True:
            src = max(range(self.n_shards), key=lambda k: (load[k], -k))
            dst = min(range(self.n_shards), key=lambda k: (load[k], k))
            gap = load[src] - load[dst]
            at = bisect_left(held[src], (gap // 2, N_SLOTS))
            near = [x for x in held[src][max(0, at - 1) : at + 1] if x[0] < gap]
            if not near:
                break
            best = min(near, key=lambda x: (abs(gap - 2 * x[0]), x))
            held[src].remove(best)
            insort(held[dst], best)
            load[src], load[dst] = load[src] - best[0], load[dst] + best[0]
            edits.append((best[1], src, dst))
            shard_of[best[1]] = dst
        return SlotMap(self.n_shards, tuple(shard_of), self.version + 1, tuple(edits))

    def grown(self, slot_bytes: dict[int, int]) -> SlotMap:
        """The next version with one more shard, which takes slots only into itself."""
        new, shard_of, edits = self.n_shards, list(self.shard_of), []
        load = [0] * (new + 1)
        for s, k in enumerate(shard_of):
            load[k] += slot_bytes.get(s, 0)
        share = sum(load) / (new + 1)
        for s in sorted(range(N_SLOTS), key=lambda s: (-slot_bytes.get(s, 0), s)):
            b, k = slot_bytes.get(s, 0), shard_of[s]
            if b and k != new and load[k] - b >= share - b / 2 and load[new] + b <= share:
                load[k], load[new] = load[k] - b, load[new] + b
                shard_of[s] = new
                edits.append((s, k, new))
        return SlotMap(new + 1, tuple(shard_of), self.version + 1, tuple(edits))

    def save(self, spark: SparkSession, path: str) -> bool:
        """Writes this version and its edits below ``path``; false if the version is there already.

        A version is claimed by creating one file, which a file system does for one writer
        only, and counts from the moment that Spark marks its table as whole.
        """
        own = f"{path}/version={self.version:08d}"
        hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
        claim = hadoop.fs.Path(f"{path}/claims/{self.version:08d}")
        fs = claim.getFileSystem(conf)
        fs.mkdirs(claim.getParent())
        if not fs.createNewFile(claim) and fs.exists(hadoop.fs.Path(own, "_SUCCESS")):
            return False
        moved = spark.createDataFrame([*self.edits], "virtual_slot int, moved_from int, to int").drop("to")
        slots = spark.range(N_SLOTS).select(F.col("id").cast("int").alias("virtual_slot"), looked_up(self.shard_of, F.col("id").cast("int")).cast("int").alias("shard"), F.lit(self.n_shards).alias("n_shards"))
        slots.join(F.broadcast(moved), "virtual_slot", "left").coalesce(1).write.mode("overwrite").parquet(own)  # N_SLOTS rows at most
        return True

    @classmethod
    def versions(cls, spark: SparkSession, path: str) -> list[int]:
        """The versions at ``path`` that are whole."""
        hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
        root = hadoop.fs.Path(path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        names = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("version=")]
        return sorted(int(n.getName()[8:]) for n in names if fs.exists(hadoop.fs.Path(n, "_SUCCESS")))

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The newest whole version at ``path``, or the one asked for; raises if there is none."""
        known = cls.versions(spark, path)
        if not known or version is not None and version not in known:
            raise ValueError(f"{path} has no version {'at all' if version is None else version}")
        version = known[-1] if version is None else version
        rows = spark.read.parquet(f"{path}/version={version:08d}").orderBy("virtual_slot").collect()
        edits = tuple((r["virtual_slot"], r["moved_from"], r["shard"]) for r in rows if r["moved_from"] is not None)
        return cls(rows[0]["n_shards"], tuple(r["shard"] for r in rows), version, edits)


def looked_up(values: tuple[int, ...] | list[int], index: Column) -> Column:
    """``values[index]``, with the bounded list as one folded literal."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), index)


def virtual_slot(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 3), 16, 10).cast("int")


def sized(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, virtual_slot): what the placement needs of each record."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        virtual_slot(F.coalesce(F.col(key).cast("string"), body)).alias("virtual_slot"),
    )


def shard(df: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", current: SlotMap | None = None, store: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Every record with its shard and its gapless place in it, and the map used.

    ``current`` is the map in force; without one it is the newest version at ``store``, or
    version 0. It is edited where slots must move to keep bytes even, and the edited map is
    the next version, which is added to ``store``; if nothing has to move, the version in
    force stays. The law is ``bytes``.

    A record's slot is the hash of its id, for good. Equal texts of different ids so lie
    apart: a group of copies may hold a third of all bytes, which no shard could take whole.
    Records with a null id take the slot of their text; equal rows lie in one slot, side by
    side. The place of a record is the number of rows in earlier slots of its shard plus its
    rank in its slot by id, CRC and size, so no task sorts more than one slot. A null text
    has size 1 and the CRC of an empty text; a very long one is a record as others. Only id
    and text are read, so other columns cannot clash. An empty table gives no rows and moves
    nothing.
    """
    spark, records = df.sparkSession, sized(df, key, text)
    sums = {r["virtual_slot"]: (r["b"], r["n"]) for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}  # N_SLOTS rows at most
    if current is None and store is not None and SlotMap.versions(spark, store):
        current = SlotMap.load(spark, store)
    known = current or SlotMap.initial(n_shards)
    table = known.rebalanced({s: b for s, (b, _) in sums.items()})
    if current is not None and not table.edits:
        table = known
    elif store is not None:
        table.save(spark, store)
    first, filled = [0] * N_SLOTS, [0] * table.n_shards
    for s in range(N_SLOTS):
        first[s] = filled[table.shard_of[s]]
        filled[table.shard_of[s]] += sums.get(s, (0, 0))[1]
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size"))
    out = records.select(
        key,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        looked_up(table.shard_of, F.col("virtual_slot")).cast("int").alias("shard"),
        (looked_up(first, F.col("virtual_slot")) + rank - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(table.version).alias("map_version"),
    )
    return out, table


def map_store(spark: SparkSession, name: str) -> str:
    """Where the map of a table is kept: in the shared folder, under a digest of the table's name."""
    return f"{shared_dir(spark).rstrip('/')}/slot-maps/{hashlib.md5(name.encode()).hexdigest()}"
