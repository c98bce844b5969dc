"""Histogram sort: documents into shards of near equal bytes with one exchange.

Every row gets a 62-bit key: the upper bits come from the text, so equal texts are neighbours, the lower 24 bits from the
id, so that a large group of copies can still be cut. Splitters are found by counting exact bytes between probes and
probing again only inside the intervals that hold a target; what reaches the driver is one row per probe. Afterwards one
range exchange puts rows in place, and positions follow from the row counts of its partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.llm.common import store, whole

KEY_BITS = 62
_LOW = (1 << 24) - 1


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one), text_crc32 and the sort key of every row."""
    t = whole(text)
    high = F.shiftrightunsigned(F.xxhash64(t), 2).bitwiseAND(F.lit(((1 << KEY_BITS) - 1) & ~_LOW))
    low = F.xxhash64(F.col(doc_id)).bitwiseAND(F.lit(_LOW))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        high.bitwiseOR(low).alias("key"),
    )


def splitters(rows: DataFrame, shards: int, tolerance: float, probes: int = 256) -> list[int]:
    """Keys at which shards 1, 2, … begin: the bytes below each are within `tolerance` of a shard from the ideal, or as
    near as whole keys allow.

    Each round keeps, for every unsettled splitter, an interval of keys that holds it and the exact bytes below its ends.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return [0] * (shards - 1)
    targets = [total * s / shards for s in range(1, shards)]
    slack = tolerance * total / shards
    state = [(0, 1 << KEY_BITS, 0, total)] * (shards - 1)  # from, to, bytes below from, bytes below to
    found: dict[int, int] = {}
    while len(found) < shards - 1:
        spans = sorted({state[s] for s in range(shards - 1) if s not in found})
        slot, base = F.lit(None).cast("long"), 0
        bounds = []
        for lo, hi, below, _ in spans:
            step = max(1, -(-(hi - lo) // probes))
            slot = F.when((F.col("key") >= lo) & (F.col("key") <= hi - 1), F.expr(f"(key - {lo}L) div {step}L") + base).otherwise(slot)
            bounds.append((lo, hi, below, step, base))
            base += probes
        counted = rows.select(slot.alias("slot"), "size", "key").where("slot IS NOT NULL")
        histogram = {r.slot: r for r in counted.groupBy("slot").agg(F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        refined = {}
        for lo, hi, below, step, base in bounds:
            filled = []
            for k in range(base, base + probes):
                if k in histogram:
                    r = histogram[k]
                    filled.append((r.lo, r.hi + 1, below, below + r.b))
                    below += r.b
            refined[(lo, hi)] = filled
        for s, target in enumerate(targets):
            if s in found:
                continue
            cell = next(c for c in refined[state[s][:2]] if target <= c[3])
            lo, hi, b_lo, b_hi = cell
            near = lo if target - b_lo <= b_hi - target else hi
            if min(target - b_lo, b_hi - target) <= slack or hi - lo == 1:
                found[s] = near
            else:
                state[s] = cell
    return [found[s] for s in range(shards - 1)]


def histogram_sort(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    The law is `bytes`: shard sizes are equal up to `tolerance` of a shard or one row. A null text has size 1; rows with a
    null id and repeated rows are kept and placed like all others; an empty table gives no rows. Slots run from 0 without
    gaps in key order inside a shard. Other columns of `docs` are not read.
    """
    rows = store(sized(docs, doc_id, text), "shard-keys")
    shard = F.lit(0)
    for cut in splitters(rows, shards, tolerance):
        shard = shard + F.when(F.col("key") >= cut, 1).otherwise(0)
    placed = (
        rows.withColumn("shard", shard)
        .repartitionByRange("shard", "key", "doc_id")
        .sortWithinPartitions("shard", "key", "doc_id")
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id())
    )
    placed = store(placed, "shard-places")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "part")
        .agg(F.min("at").alias("first"), F.count("*").alias("n"))
        .select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    # One row per shard and exchange partition: bounded by the configured number of partitions.
    return placed.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.col("first") + F.col("offset")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
