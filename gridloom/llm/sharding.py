"""Sharding by histogram sort.

A 63-bit key orders the rows.  Each round counts the exact bytes in every
candidate key interval over all partitions and narrows the intervals around the
wanted cuts, until each splitter meets the tolerance; then the rows are
exchanged once, by shard and key interval.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

KEY_BITS = 63
#: Key bits that a round of probes resolves: 4,096 counts for each open interval.
ROUND_BITS = 12
#: Rows meant for one key interval of the exchange.
INTERVAL_ROWS = 20_000
MAX_INTERVAL_BITS = 24


def order_key(*columns: Column) -> Column:
    """A uniform, non-negative 63-bit key; equal values have equal keys."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def splitters(sized: DataFrame, shards: int, tolerance: float = 0.001) -> tuple[list[int], int]:
    """Keys that cut ``sized`` (key, size) into ``shards`` runs of near-equal size, and its rows.

    A cut is good if the bytes below it miss the target by at most ``tolerance``
    of a shard.  A cut inside one key's rows goes to that key's nearer edge, so
    rows with equal keys stay together.  At most ``shards - 1`` intervals of
    4,096 counts come to the driver in a round, however large the table is.
    """
    open_, cuts, total, rows = {0: list(range(1, shards))}, {}, 0, 0
    below = {0: 0}
    for bits in range(ROUND_BITS, KEY_BITS + ROUND_BITS, ROUND_BITS):
        bits = min(bits, KEY_BITS)
        step = min(ROUND_BITS, bits if bits < KEY_BITS else KEY_BITS - (KEY_BITS - 1) // ROUND_BITS * ROUND_BITS)
        bin_ = F.shiftright("key", KEY_BITS - bits)
        part = sized if bits == ROUND_BITS else sized.where(F.shiftright("key", KEY_BITS - bits + step).isin(*open_))
        counts = part.groupBy(bin_.alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        if bits == ROUND_BITS:
            total, rows = sum(r.bytes for r in counts), sum(r.n for r in counts)
        by_parent: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: r.bin):
            by_parent.setdefault(r.bin >> step, []).append(r)
        narrower: dict[int, list[int]] = {}
        start: dict[int, int] = {}
        for parent, wanted in open_.items():
            for j in wanted:
                at, target = below[parent], total * j / shards
                for r in by_parent.get(parent, []):
                    if at + r.bytes >= target:
                        edges = ((abs(at - target), r.bin), (abs(at + r.bytes - target), r.bin + 1))
                        miss, edge = min(edges)
                        if miss <= tolerance * total / shards or bits == KEY_BITS:
                            cuts[j] = edge << (KEY_BITS - bits)
                        else:
                            narrower.setdefault(r.bin, []).append(j)
                            start[r.bin] = at
                        break
                    at += r.bytes
                else:
                    cuts[j] = (parent + 1) << (KEY_BITS - bits + step)
        open_, below = narrower, start
        if not open_:
            break
    return [min(cuts[j], (1 << KEY_BITS) - 1) for j in range(1, shards)], rows


def shard(df: DataFrame, key: Column, size: Column, shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """``df`` with shard (0 to ``shards - 1``) and slot (gapless from 0 in each shard).

    Shards are runs of the key order with near-equal sums of ``size``; a null
    size counts as 0.  ``df`` should be a stored table: it is read once for each
    round of probes.  Slots follow the key, then every column that can be
    ordered.  Repeated rows have equal keys and get slots of their own, in the
    same shard; an empty table stays empty.  Columns of ``df`` named shard or
    slot are replaced.
    """
    df = df.drop("shard", "slot").withColumns({"__key": key, "__size": F.coalesce(size, F.lit(0)).cast("long")})
    cuts, rows = splitters(df.select(F.col("__key").alias("key"), F.col("__size").alias("size")), shards, tolerance)
    bits = min(MAX_INTERVAL_BITS, max(6, math.ceil(math.log2(max(1, rows) / INTERVAL_ROWS + 1))))
    df = df.withColumns(
        {
            "shard": sum(((F.col("__key") >= F.lit(c)).cast("int") for c in cuts), F.lit(0)),
            "__interval": F.shiftright("__key", KEY_BITS - bits),
        }
    )
    before = Window.partitionBy("shard").orderBy("__interval").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("shard", "__interval").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select("shard", "__interval", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    ordered = [F.col(c) for c, kind in df.dtypes if not c.startswith("__") and c != "shard" and "map<" not in kind and kind != "variant"]
    inside = Window.partitionBy("shard", "__interval").orderBy("__key", *ordered)
    placed = df.withColumn("__at", F.row_number().over(inside) - 1).join(small(first, 2**bits + shards), ["shard", "__interval"])
    return placed.withColumn("slot", F.col("__first") + F.col("__at")).drop("__key", "__size", "__interval", "__at", "__first")


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Stored ``columns`` of documents with __bytes, the text's UTF-8 bytes (null: none)
    plus 1, and __order, the key."""
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")
    return stored(docs.select(*columns, size.alias("__bytes"), order_key(F.col("doc_id"), F.col("text")).alias("__order")), "sized")


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """Law ``bytes``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    The key is a hash of doc_id and text.  So equal texts of different documents
    are spread like any others: a group of copies may hold a third of all bytes,
    and kept together it would break the law.  Rows that agree in doc_id and text
    have one key and stay together.  A null text has the size 1; a null doc_id is
    a value like any other; an empty table stays empty; long texts count whole.
    Other columns are ignored.
    """
    crc = F.crc32(F.coalesce("text", F.lit("")))
    placed = shard(_sized(docs.select("doc_id", "text", crc.alias("text_crc32")), ["doc_id", "text_crc32"]), F.col("__order"), F.col("__bytes"), shards, tolerance)
    return placed.select("doc_id", F.col("__bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_rows(docs: DataFrame, shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """All columns of ``docs`` plus shard and slot, sharded by the bytes of text.

    Columns of ``docs`` named shard or slot are replaced, all others pass through.
    Nulls, copies, long texts and empty tables are as in ``shard_documents``.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    return shard(_sized(docs, kept), F.col("__order"), F.col("__bytes"), shards, tolerance).select(*kept, F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
