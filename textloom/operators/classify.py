"""The tiered classification of terms: aliases, a trained model, rules, and a model of last resort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.filters import heuristic_reason


def build_aliases(terms: DataFrame) -> DataFrame:
    """(alias, canonical_term, classification) of (term, kind, pos): concepts overwrite in order, keywords only fill what is free."""
    rows = terms.select(F.explode(T.aliases("term")).alias("alias"), T.canonical("term").alias("canonical_term"), F.col("kind").alias("classification"), "pos")
    concept = F.col("classification") == "concept"
    best = F.max(F.struct(concept.alias("c"), F.when(concept, F.col("pos")).otherwise(-F.col("pos")).alias("p"), "canonical_term", "classification")).alias("b")
    return rows.groupBy("alias").agg(best).select("alias", "b.canonical_term", "b.classification")


def lookup_aliases(df: DataFrame, term: str, aliases: DataFrame) -> DataFrame:
    """df with canonical_term and classification of known terms, null otherwise."""
    return df.join(aliases, T.strip(F.lower(F.col(term))) == F.col("alias"), "left").drop("alias")


def train(df: DataFrame, features: str, label: str):
    """Logistic regression with balanced class weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    stats = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))  # one row
    weighted = df.join(counts, label).join(F.broadcast(stats)).withColumn("_w", F.col("_all") / (F.col("_k") * F.col("_n")))
    prepared = weighted.select(F.col(label).cast("double").alias("label"), "_w", array_to_vector(F.transform(F.col(features), lambda x: x.cast("double"))).alias("features"))
    return LogisticRegression(weightCol="_w", maxIter=100, regParam=0.01).fit(prepared)


def predict(df: DataFrame, features: str, model, names: list[str], least: float = 0.7) -> DataFrame:
    """df with predicted and confidence: the likeliest class, or unknown below `least`. A linear model is one expression, so it stays in generated code."""
    weights, bias = [float(x) for x in model.coefficients], float(model.intercept)
    z = F.aggregate(F.zip_with(F.col(features), F.array(*[F.lit(w) for w in weights]), lambda x, w: x.cast("double") * w), F.lit(bias), lambda s, v: s + v)
    p = 1 / (1 + F.exp(-z))
    best = F.greatest(p, 1 - p)
    return df.withColumn("confidence", best).withColumn("predicted", F.when(best < least, "unknown").when(p >= 0.5, names[1]).otherwise(names[0]))


def cascade(terms: DataFrame, term: str, aliases: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, last: Column | None = None) -> DataFrame:
    """terms with canonical_term, classification, confidence, tier and rejection_reason.

    Tier 1 joins aliases; only rows it leaves go through the model of tier 2 (a function that adds predicted and
    confidence), only those it leaves open through the rules of tier 3, and the rest get `last` (a struct of
    classification and confidence) or unknown. Tiers are branches of rows, so no model sees a row that is decided.
    """
    known = lookup_aliases(terms, term, aliases)
    out = ["canonical_term", "classification", "confidence", "tier", "rejection_reason"]
    cols = terms.columns
    one = known.where("classification is not null").withColumn("confidence", F.lit(1.0)).withColumn("tier", F.lit(1)).withColumn("rejection_reason", F.lit(None).cast("string"))
    rest = known.where("classification is null").select(*cols)
    scored = model(rest) if model else rest.withColumn("predicted", F.lit("unknown")).withColumn("confidence", F.lit(0.0))
    reason = heuristic_reason(term)
    decided = F.col("predicted") != "unknown"
    end = last if last is not None else F.struct(F.lit("unknown").alias("classification"), F.lit(0.0).alias("confidence"))
    tier = F.when(decided, 2).when(reason.isNotNull(), 3).otherwise(3 if last is None else 4)
    others = scored.select(
        *cols, T.canonical(term).alias("canonical_term"),
        F.when(decided, F.col("predicted")).when(reason.isNotNull(), "rejected").otherwise(end["classification"]).alias("classification"),
        F.when(decided, F.col("confidence")).when(reason.isNotNull(), 1.0).otherwise(end["confidence"]).alias("confidence"),
        tier.alias("tier"), F.when(~decided, reason).alias("rejection_reason"),
    )
    return one.select(*cols, *out).unionByName(others)
