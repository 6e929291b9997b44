"""Order-dependent operators as window functions: list order is a column, and ties end with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.sources.scratch import materialize


def first_by(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def top_by(df: DataFrame, keys: list[Column | str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, n).where(F.col(rank) <= k)


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], rank: str = "rank") -> DataFrame:
    """All rows with their rank among those of their keys, however many a key has; the order must be total.

    Rows are sorted once by ranges of (keys, order), which cut a key with many rows into several; ranks are counted
    within ranges, and a row for each key and range tells how many come before.
    """
    spark = df.sparkSession
    by = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(spark, df.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return rows.withColumn("_place", place).join(counts.drop("_n"), [*keys, "_range"]).withColumn(rank, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def best_results(results: DataFrame) -> DataFrame:
    """Of each book's chapter the result with the highest score, the first of equal ones."""
    return first_by(results, ["book", "chapter"], [F.desc("score"), "pos"])


def dedup_by_stem(df: DataFrame, key: str, term: str, pos: str) -> DataFrame:
    """A document's terms, of those with one stem the first."""
    return first_by(df, [key, F.lower(T.stem(term))], [pos])


def shortest_per_cluster(df: DataFrame, label: str, term: str, pos: str, key: list[str] | None = None) -> DataFrame:
    """All terms of label -1, and of every other cluster the shortest term, the first of equally short ones."""
    keys = key or []
    alone = df.where(F.col(label) == -1)
    return alone.unionByName(first_by(df.where(F.col(label) != -1), [*keys, label], [F.length(term), pos]))


def positional_score(pos: Column | str) -> Column:
    """1, 0.9 and so on by the place in the list, 0.1 at least."""
    return F.greatest(F.lit(0.1), 1 - T.col(pos) * 0.1)


def fallback_score(pos: Column | str, count: Column | str, term: Column | str) -> Column:
    """Mean of an early place and of length."""
    return ((1 - T.col(pos) / F.greatest(T.col(count), F.lit(1)) * 0.3) + F.least(F.length(T.col(term)) / 10, F.lit(1.0))) / 2


def rescored(score: Column | str, content: Column | str, query: Column | str) -> Column:
    """Half the score, half the share of the query's words in the content."""
    asked = F.array_distinct(T.split_words(F.lower(T.col(query))))
    share = F.size(F.array_intersect(asked, F.array_distinct(T.split_words(F.lower(T.col(content)))))) / F.greatest(F.size(asked), F.lit(1))
    return T.col(score) * 0.5 + share * 0.5


def middle_third(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Rows whose rank is in [n / 3, 2 n / 3) of their key's rows."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_c", F.count(F.lit(1)).over(w))
    return ranked.where((F.col("_r") >= F.floor(F.col("_c") / 3)) & (F.col("_r") < F.floor(2 * F.col("_c") / 3))).drop("_c")


def limit_then_filter(df: DataFrame, key: str, order: list[Column | str], k: int, condition: Column) -> DataFrame:
    """The first k rows of each key, and of these the ones that meet the condition: the two don't commute."""
    return top_by(df, [key], order, k, "_rank").where(condition)


def consensus(terms: DataFrame, agreement: int = 2, threshold: float = 0.5) -> DataFrame:
    """Adds models_agreed, accepted, score and reason: two of generator, validator and ranker must agree; the score is the mean of their scores, a missing one counting 0."""
    score = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in terms.columns else F.lit(0.0)
    agreed = (score("generator_score") >= threshold).cast("int") + F.coalesce(F.col("validator_approved"), F.lit(False)).cast("int") + (score("ranker_score") >= threshold).cast("int")
    mean = (score("generator_score") + score("validator_score") + score("ranker_score")) / 3
    counted = terms.withColumn("models_agreed", agreed).withColumn("accepted", F.col("models_agreed") >= agreement)
    reason = F.concat(F.lit("insufficient_agreement: "), F.col("models_agreed").cast("string"), F.lit(f"/{agreement}"))
    return counted.withColumn("score", F.when(F.col("accepted"), mean)).withColumn("reason", F.when(~F.col("accepted"), reason))


def curate(results: DataFrame, domain: str | None = None, least: float = 0.3) -> DataFrame:
    """Results of a domain, one a chapter, with a score of at least `least`."""
    own = results if domain is None else results.where(T.title_domain("book").isin(domain, "general"))
    return best_results(own).where(F.col("score") >= least)
