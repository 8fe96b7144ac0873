"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
#: Virtual nodes of a shard, and equal cells into which the ring is cut for look-ups.
NODES = 128
CELLS = 1 << 14
_RING_BITS = 60
_CELL_BITS = _RING_BITS - 14


def ring_position(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise."""
    spots = {
        int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:15], 16): s
        for s in range(shards)
        for v in range(nodes)
    }
    return sorted(spots.items())


def _pieces(spots: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(cell, low, high, arc): where each cell of the ring meets each arc, in ring order.

    An arc ends at its node, exclusive; what lies past the last node belongs to the first.
    """
    places = [p for p, _ in spots]
    cuts = sorted({*places, *(c << _CELL_BITS for c in range(CELLS + 1))})
    out = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        out.append((low >> _CELL_BITS, low, high, bisect_left(places, low + 1) % len(places)))
    return out


def _flow(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot) of every run of keys that goes one way.

    Round by round each arc's keys that have no place yet try the next node clockwise; arcs take
    turns in ring order and a full shard passes the higher ranks on. Loads are bounded by
    the mean: the first ``total % shards`` shards hold one more.
    """
    whole = sum(counts)
    free = [whole // shards + (s < whole % shards) for s in range(shards)]
    slots, at, runs = [0] * shards, [0] * len(counts), []
    waiting, hop = [a for a, n in enumerate(counts) if n], 0
    while waiting:
        still = []
        for a in waiting:
            shard = owners[(a + hop) % len(owners)]
            n = min(counts[a] - at[a], free[shard])
            if n:
                runs.append((a, at[a], at[a] + n, shard, slots[shard]))
                at[a], free[shard], slots[shard] = at[a] + n, free[shard] - n, slots[shard] + n
            if at[a] < counts[a]:
                still.append(a)
        waiting, hop = still, hop + 1
    return runs


def assign(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """``docs`` plus ``shard`` int and ``slot`` long; needs ``doc_id`` and ``text``.

    A row's place on the ring comes from its id. It belongs to the next virtual node clockwise;
    rows that overflow a full shard go on clockwise, so shards differ by one row at most. Ranks
    within an arc go by place, id and text; rows without id share one place, and rows
    equal in id and text are interchangeable. ``slot`` counts a shard's rows from 0 without gaps.
    Existing columns of these names are replaced. An empty table stays empty.

    The driver sees one count per piece of the ring: shards x nodes + cells rows at most, whatever
    the input. Look-ups join that many rows, and ranks are taken within a cell, not a shard.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    row = F.struct(*docs.columns).alias("_row")  # packed, so that no name can clash
    spots = ring(shards, nodes)
    pieces = _pieces(spots)
    lookup = F.broadcast(  # as many rows as the ring has pieces: a constant
        spark.createDataFrame(
            [(i, *p) for i, p in enumerate(pieces)], "_piece int, _cell long, _low long, _high long, _arc int"
        )
    )
    marks = [F.crc32("text").alias("_crc"), F.xxhash64("text").alias("_mark")]
    placed = docs.select(row, ring_position(F.col("doc_id")).alias("_at"), *marks).withColumn(
        "_cell", F.shiftright("_at", _CELL_BITS)
    )
    placed = placed.join(lookup, "_cell").where("_at >= _low AND _at < _high")
    counts = dict(placed.groupBy("_piece").count().collect())
    arcs, starts = [0] * len(spots), []
    for i, (_, _, _, arc) in enumerate(pieces):
        starts.append((i, arcs[arc]))
        arcs[arc] += counts.get(i, 0)
    runs = _flow(arcs, [s for _, s in spots], shards)
    offsets = F.broadcast(spark.createDataFrame(starts, "_piece int, _start long"))
    ways = F.broadcast(  # at most one run per arc and one per shard that fills up
        spark.createDataFrame(runs, "_arc int, _from long, _to long, shard int, _slot long")
    )
    order = Window.partitionBy("_piece").orderBy("_at", "_row.doc_id", "_crc", "_mark")
    ranked = placed.withColumn("_rank", F.row_number().over(order) - 1).join(offsets, "_piece")
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_start"))
    found = ranked.join(ways, "_arc").where("_rank >= _from AND _rank < _to")
    slot = F.col("_slot") + F.col("_rank") - F.col("_from")
    return found.select("_row.*", "shard", slot.alias("slot"))


def manifest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One narrow row per document: sizes, checksum, shard and slot.

    ``size`` is the UTF-8 length of the text (null: 0) plus 8; the checksum of null is 0.
    """
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").cast("string").alias("text"),
    )
    return assign(narrow, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
