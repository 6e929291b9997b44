"""A stated set of vectors against all rows: products of packs give what the expressions give, and no plan multiplies a pair at a time."""

import math

import pytest
from pyspark.sql import functions as F

import textloom.queries as library
from textloom.operators import vectors as X
from textloom.plans import pipelines

ODD = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.6, 0.8], 2), (3, [0.0, 0.0], None), (4, None, 1), (5, [-1.0, 0.0], 2), (6, [1.0, None], 1), (7, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 1), (8, [0.0, 2.0], None)]


def odd(spark):
    return spark.createDataFrame(ODD, "vec_id long, embedding array<float>, label int")


def pair(spark):
    e = odd(spark)
    a, b = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("i"), F.col("embedding").alias("a")), e.select(F.col("vec_id").alias("j"), F.col("embedding").alias("b"))
    want = a.crossJoin(b).where("i != j").select("i", "j", X.dot("a", "b").alias("dot"), X.cosine("a", "b").alias("cosine"))
    return X.all_pairs(e.where("vec_id % 2 = 0"), e, "vec_id", "embedding", lambda dot, cos: [X.rounded(dot), X.rounded(cos)], "dot, cosine"), want


@pytest.mark.parametrize("most", [X.MOST_BYTES, 1])
def test_all_pairs_is_the_expression(spark, monkeypatch, most):
    monkeypatch.setattr(X.compared, "__defaults__", (most, 7))  # several tasks, and blocks of queries that are not broadcast
    got, want = pair(spark)
    rows = lambda df: sorted((r.i, r.j, None if r.dot is None else round(r.dot, 6), None if r.cosine is None else round(r.cosine, 6)) for r in df.collect())
    assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]


def test_equal_vectors_tie_by_id(spark):
    rows = spark.createDataFrame([(i, [math.sin(j + 1.0) for j in range(64)], i % 3) for i in range(3000)], "k long, v array<double>, t int")
    got = X.top_similar(rows.where("k = 100"), rows, "k", "k", "v", 5).orderBy("rank").collect()
    assert [r.match for r in got] == [0, 1, 2, 3, 4]
    got = pipelines.cross_references(rows, rows.where("k = 100"), "k", "v", "t").orderBy("rank").collect()
    assert [(r.match, r.boost) for r in got] == [(1, 0.15), (4, 0.15), (7, 0.15), (10, 0.15), (13, 0.15)]


@pytest.mark.parametrize("name", ["a09_recall_at_k", "a10_average_precision", "a11_code_query_recall", "a12_retrieval_benchmark", "a15_max_over_pairs", "j08_pairwise_similarity", "o09_cross_references", "v04_cosine_variants", "v06_similarity_matrix", "v23_contrastive_loss", "w02_similarity_top_k", "w04_relevance_ranking", "w14_term_expansion"])
def test_no_plan_multiplies_a_pair_at_a_time(spark, sf_dir, name):
    plan = library.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


def test_pairs_leave_in_order_of_their_cosine(spark):
    rows = spark.createDataFrame([(i, [math.sin(i * i + j) for j in range(8)]) for i in range(600)], "k long, v array<double>").coalesce(1)
    made = X.all_pairs(rows.where("k % 2 = 0"), rows, "k", "v", lambda dot, cos: [X.rounded(cos, 4)], "score")
    scores = [r.score for r in made.collect()]
    assert len(scores) == 300 * 599 and scores == sorted(scores)
