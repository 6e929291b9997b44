"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

#: Rates above this are split: a Poisson variable is the sum of independent ones of at most this mean, each inverted on its own.
PART_RATE = 16.0

#: Up to so many sources the rates are broadcast (two numbers and a name each); beyond, both sides are salted and shuffled.
BROADCAST_SOURCES = 100_000
SALTS = 32

#: Sources with a greater rate are replicated in two steps: a document is first dealt out as blocks of this many copies at most.
DIRECT_RATE = 200.0
BLOCK = 1024

#: The inverted distribution is cut where less than 2 ** -52 is left; for a mean of at most PART_RATE this is before 80.
MOST = 80


def _uniform(*parts: F.Column) -> F.Column:
    """In (0, 1), from 52 bits of an md5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def _poisson(rate: F.Column, u: F.Column) -> F.Column:
    """The smallest k with P(X <= k) >= u."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))

    def step(s: F.Column, k: F.Column) -> F.Column:
        p = s["p"] * rate / k
        more = F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["k"] + 1).alias("k"))
        return F.when(s["c"] < u, more).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate): the mean number of copies of a source's documents.

    rate = weight / sum of weights * bytes of all texts * epochs / bytes of the source's texts, over the sources that
    have bytes; weights None: equal ones. Sources without a weight get rate 0, and so do sources without any text.
    A null source is a source of its own, named by the empty string.
    """
    sizes = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("_source")).agg(F.sum(F.octet_length(F.coalesce(F.col("text"), F.lit("")))).alias("_bytes"))
    if weights is None:
        weighted = sizes.withColumn("_weight", F.when(F.col("_bytes") > 0, 1.0).otherwise(0.0))
    else:
        pairs = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.lit(None).cast("map<string,double>")
        weighted = sizes.withColumn("_weight", F.when(F.col("_bytes") > 0, F.coalesce(F.try_element_at(pairs, F.col("_source")), F.lit(0.0))).otherwise(0.0))
    weighted = materialize(docs.sparkSession, weighted)
    total = weighted.agg(F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("_weight"), F.lit(0.0)).alias("weights")).first()
    rate = F.when(F.col("_weight") > 0, F.col("_weight") / total.weights * total.bytes * epochs / F.col("_bytes")).otherwise(0.0)
    return weighted.select("_source", rate.alias("_rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """Replicates each document a Poisson number of times with its source's rate and shuffles the copies globally.

    The count inverts the Poisson distribution at a hash of (seed, doc_id), so it is the same on every run. Adds rate,
    n_copies, copy_no (from 0) and mix_key, a hash of (seed, doc_id, copy_no); rows are dealt to partitions by mix_key
    and sorted by it there, which is a global shuffle: the rates are computed from two numbers a source and joined as
    a table, broadcast up to BROADCAST_SOURCES rows and joined on salted keys beyond, so a hot source's rows are never
    brought together. The sums are made once and stored in the shared folder.
    A document of a source with a great rate is dealt out in blocks of copies, so no task makes all of them.
    Documents without an id are hashed by their text; null texts count 0 bytes; rows of one id get the same count each;
    an empty table stays empty; columns of the added names in the input are replaced.
    """
    own = ["rate", "n_copies", "copy_no", "mix_key", "_source", "_rate", "_salt", "_key", "_block"]
    df = docs.drop(*own).withColumn("_source", F.coalesce(F.col("source"), F.lit("")))
    df = df.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    key = F.col("_key")
    parts = F.greatest(F.ceil(F.col("_rate") / PART_RATE).cast("int"), F.lit(1))
    one = _poisson(F.col("_rate"), _uniform(F.lit(str(seed)), key, F.lit("0")))
    many = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, i: n + _poisson(F.col("_rate") / parts, _uniform(F.lit(str(seed)), key, i.cast("string"))))
    by_source = rates(docs, weights, epochs)
    if by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = df.join(F.broadcast(by_source), "_source")
    else:
        salted = by_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = df.withColumn("_salt", F.pmod(F.crc32(key.cast("binary")), F.lit(SALTS)).cast("int")).join(salted, ["_source", "_salt"]).drop("_salt")
    counted = joined.withColumn("n_copies", F.when(F.col("_rate") <= PART_RATE, one).otherwise(many))
    copied = counted.where("n_copies > 0")
    direct = lambda df: df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    if (by_source.agg(F.max("_rate").alias("most")).first().most or 0.0) <= DIRECT_RATE:
        copies = direct(copied)
    else:
        blocks = copied.where(F.col("_rate") > DIRECT_RATE).withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_copies") - 1) / BLOCK).cast("int"))))
        first = F.col("_block") * BLOCK
        many = blocks.repartition("_key", "_block").withColumn("copy_no", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("n_copies")) - 1))).drop("_block")
        copies = direct(copied.where(F.col("_rate") <= DIRECT_RATE)).unionByName(many)
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:place"), key, F.col("copy_no").cast("string"))))
    return keyed.withColumnRenamed("_rate", "rate").drop("_source", "_key").repartition("mix_key").sortWithinPartitions("mix_key", "copy_no")
