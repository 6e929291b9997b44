"""TF-IDF by chunks of documents gives the rows of the joins, and shuffles no row of a document and a term."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import lexical

ROWS = [(1, "alpha beta gamma alpha"), (2, "alpha beta delta"), (2, "gamma ALPHA"), (None, "beta gamma"), (None, "beta gamma"), (3, ""), (4, None), (5, "x y"), (100, "delta alpha beta"), (200, "omega")]


@pytest.mark.parametrize("chunk", [lexical.CHUNK, 8])
@pytest.mark.parametrize("scope", ["corpus", "document"])
def test_weighted_is_tfidf(spark, chunk, scope):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    want = lexical.tfidf(lexical.terms(d, stopwords=["beta"]), d, max_df=0.95, min_df=2 if scope == "corpus" else 1, scope=scope)
    made = lexical.weighted(d, stopwords=["beta"], max_df=0.95, min_df=2, scope=scope, chunk=chunk)
    got = made.select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.*")
    rows = lambda x: sorted((str(r.doc_id), r.term, r.tf, r.df, round(r.weight, 9)) for r in x.collect())
    assert rows(got) == rows(want) and made.groupBy("doc_id").count().where("count > 1").count() == 0
    assert "Explode" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_cosine_pairs_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(lexical, "STEP", 2)
    d = spark.createDataFrame(ROWS, "doc_id long, text string").where("doc_id is not null")
    w = lexical.weighted(d)
    flat = w.select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.*")
    a, b = flat.select(F.col("doc_id").alias("a"), "term", F.col("weight").alias("x")), flat.select(F.col("doc_id").alias("b"), "term", F.col("weight").alias("y"))
    want = a.where("a % 100 = 0").join(b, "term").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    made = lexical.cosine_pairs(w.where("doc_id % 100 = 0"), w)
    rows = lambda x: sorted((r.a, r.b, round(r.score, 9)) for r in x.collect())
    assert rows(made) == rows(want) and len(rows(made)) > 3
    assert "Aggregate" not in made.select("a", "b", "score")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_similar_documents_keeps_and_shuffles_no_weights(spark):
    rows = [(i, " ".join(f"w{(i * j * j + j) % (11 + i % 7)}" for j in range(2 + i % 40))) for i in range(230)] + ROWS
    d = spark.createDataFrame(rows, "doc_id long, text string")
    w = lexical.weighted(d, max_df=0.95, min_df=2)
    flat = w.select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.*")
    a, b = flat.select(F.col("doc_id").alias("a"), "term", F.col("weight").alias("x")), flat.select(F.col("doc_id").alias("b"), "term", F.col("weight").alias("y"))
    want = a.where("a % 100 = 0").join(b, "term").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    pairs = lambda x: sorted((r.a, str(r.b), round(r.score, 9)) for r in x.collect())
    expected = pairs(want)
    for chunk, broadcast in ((lexical.CHUNK, None), (300, None), (300, 1)):
        made = lexical.similar_documents(d, F.col("doc_id") % 100 == 0, max_df=0.95, min_df=2, chunk=chunk, broadcast=broadcast)
        assert pairs(made) == expected and len(expected) > 400
    assert "weight" not in made._jdf.queryExecution().optimizedPlan().toString()
    # in order of score, files have about half the bytes
    scores = [r.score for r in lexical.similar_documents(d, F.col("doc_id") % 100 == 0, max_df=0.95, min_df=2).collect()]
    assert sum(x > y for x, y in zip(scores, scores[1:], strict=False)) <= 1  # the chunk of asked documents, and the others
