"""Joins of texts by what they contain or nearly equal, through an inverted index of their q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column | str, q: int) -> Column:
    """The distinct runs of q characters; of a shorter text, none."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.length(t) - q + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(t, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def containing(patterns: DataFrame, texts: DataFrame, pattern: str, text: str, q: int = 3, rare: int = 4) -> DataFrame:
    """(pattern, text) of distinct patterns and texts that contain them.

    An equi-join on q-grams: each pattern asks for the `rare` of its grams that are in the fewest texts, a text must have
    all of them, and only such pairs are compared. A gram that most texts have is joined only for patterns that have no
    other. Patterns shorter than q are one gram of their length. Null and empty patterns are contained in none.
    """
    asked = patterns.where(F.length(pattern) > 0).select(F.col(pattern).alias("p")).distinct().withColumn("q", F.least(F.length("p"), F.lit(q)))
    sizes = sorted(r.q for r in asked.select("q").distinct().collect())  # q numbers at most
    own = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).distinct()
    held = own.select("t", F.explode(F.concat(F.array().cast("array<string>"), *[grams("t", n) for n in sizes])).alias("g"))
    often = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    each = F.coalesce(*[F.when(F.col("q") == n, grams("p", n)) for n in sizes], F.array().cast("array<string>"))
    wanted = asked.select("p", F.explode(each).alias("g")).join(often, "g", "left")
    # a gram in no text decides at once: its pattern finds nothing
    best = wanted.groupBy("p").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))), 1, rare).alias("gs"))
    chosen = best.where(F.col("gs")[0]["n"] > 0).select("p", F.size("gs").alias("k"), F.explode("gs").alias("x")).select("p", "k", F.col("x.g").alias("g"))
    met = chosen.join(held, "g").groupBy("p", "t").agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k")).where("n = k")
    return met.where(F.contains("t", F.col("p"))).select(F.col("p").alias(pattern), F.col("t").alias(text))


def similar(left: DataFrame, right: DataFrame, a: str, b: str, edits: int = 2, q: int = 3) -> DataFrame:
    """(a, b, distance) of distinct texts within so many edits of each other.

    Count filter: each edit changes q grams at most, so of the (padded, numbered) grams of the longer text all but
    edits * q are shared. Lengths differ by the edits at most; only pairs that pass are compared.
    """
    pad = F.lit("\u0001" * (q - 1))

    def numbered(df: DataFrame, c: str, name: str) -> DataFrame:
        t = df.where(F.col(c).isNotNull()).select(F.col(c).alias(name)).distinct()
        whole = t.withColumn("_t", F.concat(pad, F.col(name), pad))
        gs = F.transform(F.sequence(F.lit(1), F.length("_t") - q + 1), lambda i: F.substring(F.col("_t"), i, F.lit(q)))
        counted = whole.select(name, F.explode(gs).alias("g")).groupBy(name, "g").agg(F.count(F.lit(1)).alias("n"))
        return counted.select(name, "g", F.col("n").alias(f"{name}_n"))

    met = numbered(left, a, "_a").join(numbered(right, b, "_b"), "g").where(F.abs(F.length("_a") - F.length("_b")) <= edits)
    shared = met.groupBy("_a", "_b").agg(F.sum(F.least("_a_n", "_b_n")).alias("n"))
    enough = F.greatest(F.length("_a"), F.length("_b")) + (q - 1) - edits * q
    # pairs of short texts may share no gram: they meet by length
    short = lambda df, c, name: df.where(F.length(c) <= edits * q - q + 1).select(F.col(c).alias(name), F.explode(F.sequence(F.greatest(F.length(c) - edits, F.lit(0)), F.length(c) + edits)).alias("_l")).distinct()
    few = short(left, a, "_a").join(right.where(F.length(b) <= edits * q - q + 1).select(F.col(b).alias("_b"), F.length(b).alias("_l")).distinct(), "_l").select("_a", "_b")
    pairs = shared.where(F.col("n") >= enough).select("_a", "_b").unionByName(few).distinct()
    return pairs.select(F.col("_a").alias(a), F.col("_b").alias(b), F.levenshtein("_a", "_b").alias("distance")).where(F.col("distance") <= edits)
