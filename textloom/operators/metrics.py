"""Retrieval and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import col
from textloom.operators import ranking


def recall(predicted: Column | str, relevant: Column | str, k: int) -> Column:
    """Share of a query's relevant items among its first k predictions; 0 if none is relevant."""
    rel = F.array_distinct(col(relevant))
    return F.when(F.size(rel) > 0, F.size(F.array_intersect(F.slice(col(predicted), 1, k), rel)) / F.size(rel)).otherwise(0.0)


def hit(predicted: Column | str, relevant: Column | str, k: int) -> Column:
    return (F.size(F.array_intersect(F.slice(col(predicted), 1, k), col(relevant))) > 0).cast("double")


def average_precision(ranked: DataFrame, query: str, rank: str, is_relevant: str, relevant_count: str) -> DataFrame:
    """(query, ap): the mean precision at the ranks of relevant items, over all relevant ones. Only relevant rows are numbered, in ranges that one task holds."""
    hits = ranking.ranked(ranked.where(F.col(is_relevant)).select(query, rank), [query], [rank], "_hit")
    sums = hits.groupBy(query).agg(F.sum(F.col("_hit") / F.col(rank)).alias("_p"))
    counts = ranked.groupBy(query).agg(F.max(relevant_count).alias("_n"))
    return counts.join(sums, query, "left").select(query, F.when(F.col("_n") > 0, F.coalesce("_p", F.lit(0.0)) / F.col("_n")).otherwise(0.0).alias("ap"))


def classification(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 weighted by label counts, from the confusion counts."""
    counts = df.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by_label = counts.groupBy("l").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    by_predicted = counts.groupBy(F.col("p").alias("l")).agg(F.sum("n").alias("said"))
    x = by_label.join(by_predicted, "l", "left")
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.col("tp") / F.col("support")
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    mean = lambda c: F.sum(c * F.col("support")) / F.sum("support")
    return x.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), mean(p).alias("precision"), mean(r).alias("recall"), mean(f).alias("f1"), F.sum("support").alias("n"))
