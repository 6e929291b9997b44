"""Sharding by a Feistel permutation with cycle walking over global row numbers. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the round function, computed modulo the prime 2 ** 31 - 1.
PRIME = 2**31 - 1
MULTIPLIERS = (1103515245, 1664525, 22695477, 69069, 134775813, 214013, 1140671485, 48271)

#: Row numbers are given out within so many hash buckets: each is sorted by one task, and only their counts are summed by one.
BUCKETS = 1 << 16

#: Points outside 0..rows-1 that one walk may meet. The Feistel domain has fewer than sqrt(rows) + 1 such points, so small tables can't need more and for larger ones the chance is below 64 ** -64 a row.
WALK = 64


def global_row_numbers(df: DataFrame, key: str, tie: list[str], number: str = "row_no", rows: str = "row_count") -> DataFrame:
    """Adds gapless row numbers from 0 and the number of rows.

    The order is that of (crc32 of the key modulo BUCKETS, key, tie columns): it depends on the rows alone, not on
    their partitions. Rows without a key are spread by their tie columns. One shuffle of the rows by bucket; the BUCKETS
    counts at most are summed by one task.
    """
    spread = F.coalesce(F.col(key).cast("string"), F.concat_ws(":", *[F.col(c).cast("string") for c in tie]))
    bucketed = df.withColumn("_bucket", (F.crc32(spread.cast("binary")) % BUCKETS).cast("int"))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # at most BUCKETS rows of three numbers, whatever the input: safe to broadcast
    offsets = F.broadcast(counts.select("_bucket", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"), F.sum("_n").over(everything).alias(rows)))
    within = Window.partitionBy("_bucket").orderBy(*[F.col(c) for c in [key, *tie]])
    return (
        bucketed.withColumn("_place", F.row_number().over(within) - 1)
        .join(offsets, "_bucket")
        .withColumn(number, F.col("_before") + F.col("_place"))
        .drop("_bucket", "_place", "_before")
    )


def _scrambled(half: F.Column, seed: int, step: F.Column) -> F.Column:
    """The round function: two quadratic steps modulo PRIME; every product fits 63 bits."""
    factors = F.array(*[F.lit(m) for m in MULTIPLIERS])
    a = (half % PRIME * F.element_at(factors, step + 1) + (seed + 1) * 7919 + step * 104729) % PRIME
    b = (a * a + a * 40503 + 12345) % PRIME
    return (b * b + b * 69621 + a) % PRIME


def feistel(x: F.Column, wide: F.Column, high: F.Column, seed: int) -> F.Column:
    """A permutation of 0..wide*high-1: x = left * high + right, and one half at a time is shifted by a function of the other."""
    start = F.struct(F.floor(x / high).cast("long").alias("l"), (x % high).cast("long").alias("r"))

    def one(s: F.Column, step: F.Column) -> F.Column:
        left = F.when(step % 2 == 0, (s["l"] + _scrambled(s["r"], seed, step)) % wide).otherwise(s["l"])
        right = F.when(step % 2 == 1, (s["r"] + _scrambled(s["l"], seed, step)) % high).otherwise(s["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    steps = F.array(*[F.lit(i) for i in range(len(MULTIPLIERS))])
    return F.aggregate(steps, start, one, lambda s: s["l"] * high + s["r"])


def permuted(number: F.Column, rows: F.Column, seed: int) -> F.Column:
    """The place of a row number after the shuffle: Feistel steps until the value is below `rows`."""
    wide = F.greatest(F.ceil(F.sqrt(rows.cast("double"))).cast("long"), F.lit(1).cast("long"))
    high = F.greatest(F.ceil(rows / wide).cast("long"), F.lit(1).cast("long"))
    first = feistel(number, wide, high, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda y, _: F.when(y < rows, y).otherwise(feistel(y, wide, high, seed)))
    value = F.when(first < rows, first).otherwise(walked)
    return F.when(value < rows, value).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def shard(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Adds row_no, row_count, shard (int) and slot (long): place = permutation(row_no), shard = place mod shards, slot = place div shards.

    So shards differ by one row at most, slots run without a gap from 0, and anyone who knows the row count, the seed
    and a row number can compute shard and slot. Null ids and texts sort first; rows that are equal in doc_id and text
    are interchangeable; an empty table stays empty; columns of these names in the input are replaced.
    """
    own = ["row_no", "row_count", "shard", "slot", "_bucket", "_place", "_before", "_n", "_one", "_two"]
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.drop(*own).withColumn("_one", F.xxhash64(text)).withColumn("_two", F.xxhash64(F.lit("two"), text))
    numbered = global_row_numbers(df, "doc_id", ["_one", "_two"]).withColumn("_place", permuted(F.col("row_no"), F.col("row_count"), seed))
    return (
        numbered.withColumn("shard", (F.col("_place") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("_place") / shards).cast("long"))
        .drop("_place", "_one", "_two")
    )


def digest(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Rows of the contract: the permutation is the same as shard()'s, but only sizes and checksums are shuffled, no texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("_one"), F.xxhash64(F.lit("two"), text).alias("_two"))
    numbered = global_row_numbers(small, "doc_id", ["_one", "_two"])
    placed = numbered.withColumn("_at", permuted(F.col("row_no"), F.col("row_count"), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_at") % shards).cast("int").alias("shard"),
        F.floor(F.col("_at") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )
