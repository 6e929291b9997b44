"""Steps that grew faster than their input: the same rows by plans that don't."""

from pyspark.sql import functions as F

import textloom.queries as library
from textloom.functions import text as T
from textloom.operators import concepts, lexical, training
from textloom.sources import models


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merge_words_is_merge_terms(spark):
    d = spark.createDataFrame([(1, "Alpha beta ALPHA Gammadelta gammaDelta a"), (None, "Beta beta"), (2, ""), (3, None), (4, "x abc Abc")], "doc_id long, text string")
    w = d.select("doc_id", F.posexplode(T.split_words("text")).alias("pos", "term"))
    want = concepts.merge_terms(w.where("length(term) <= 7").withColumn("score", F.col("pos") / 100), w.where("length(term) >= 4"))
    got = concepts.merge_words(d, 7, 4, chunk=5)
    rows = lambda x: sorted(map(repr, x.select("doc_id", "term", "score", "source").collect()))
    assert rows(got) == rows(want)
    assert "Window" not in plan(got) and "Join" not in plan(got)


def test_triplets_in_blocks(spark, sf_dir, monkeypatch):
    rows = lambda: sorted(map(repr, library.QUERIES["j14_intra_concept_pairs"](spark, sf_dir).collect()))
    want = rows()
    assert "broadcast" in plan(library.QUERIES["j14_intra_concept_pairs"](spark, sf_dir))  # no task for each concept
    monkeypatch.setattr(training, "MOST_BYTES", 40)
    assert rows() == want and want


def test_pairs_of_a_snippet_follow_those_of_the_one_before(spark, sf_dir):
    assert "Sort [concept" in plan(library.QUERIES["j14_intra_concept_pairs"](spark, sf_dir))  # Spark drops a plain sort below a join
    s = spark.createDataFrame([(f"c{i * 7 % 5}", i, f"code {i}") for i in range(3000)], "concept string, pos long, code string").repartition(3)
    made = training.code_triplets(s, anchors=F.col("pos") % 20 == 0)
    got = [(r.concept, r.j) for r in made.select("concept", "j").collect()]
    assert got == sorted(got) and len(got) > 40_000


def test_triplet_ranks_have_no_window_over_all_rows_of_a_query(spark, sf_dir):
    assert "count(1) windowspecdefinition(query_id" not in plan(library.QUERIES["v29_triplets"](spark, sf_dir))


def test_words_are_embedded_once(monkeypatch):
    import hashlib

    asked, real = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda b: asked.append(b) or real(b))
    model = models.pooled_embedder(4).load()
    assert model(["a b a b a", "b a"])[1] == model(["b a"])[0]
    assert len(asked) == 2 * 4


def test_many_lists_of_terms_make_one_group(spark, sf_dir):
    assert "FlatMapGroupsInArrow" in plan(library.QUERIES["v14_density_clusters"](spark, sf_dir))


def test_topics_terms_are_made_once(spark, sf_dir):
    p = plan(library.QUERIES["v17_concept_discovery"](spark, sf_dir))
    assert "Generate" not in p and "FlatMap" not in p


def test_terms_are_read_once(spark, sf_dir):
    """No row for each word of a text, and the texts aren't read again for each use of the terms."""
    p = plan(library.QUERIES["s18_classify_client"](spark, sf_dir))
    assert "Generate" not in p and "documents.parquet" not in p and "regexp_extract_all" not in p


def test_word_counts(spark):
    d = spark.createDataFrame([("Ab ab x cd_1",), (None,), ("",), ("AB É cd_1 zz",)], "text string")
    for held in (1, 100):
        assert sorted(map(tuple, lexical.word_counts(d, held=held).collect())) == [("ab", 3), ("cd_1", 2), ("zz", 1)]


def test_metadata_has_no_row_for_each_word_of_a_document(spark, sf_dir):
    p = plan(library.QUERIES["o01_metadata_extraction"](spark, sf_dir))
    assert "Generate explode_outer" not in p and "collect_list(CASE" not in p


def test_judged_words_in_chunks(spark):
    d = spark.createDataFrame([(1, "bb aa bb 12 zz zz qq"), (None, "aa the"), (2, ""), (3, None), (4, "the")], "doc_id long, text string")
    judge = lambda t: t.withColumn("noise", F.when(F.col("term") == "12", "pure_number")).withColumn("reason", F.coalesce("noise", F.when(F.col("term") == "qq", "unknown")))
    for chunk in (5, 10**6):
        got = {r.doc_id: (r.length, r.n_words, r.n_noise, r.n_good, r.keywords, [tuple(x) for x in r.rejected]) for r in lexical.judged_words(d, judge, stopwords=["the"], top=2, chunk=chunk).collect()}
        assert got == {1: (20, 5, 1, 3, ["zz", "bb"], [("12", "pure_number"), ("qq", "unknown")]), None: (6, 1, 0, 1, ["aa"], []), 2: (0, 0, 0, 0, [], []), 3: (None, 0, 0, 0, [], []), 4: (3, 0, 0, 0, [], [])}


def test_heaviest_terms_is_the_join(spark):
    from textloom.operators import cluster

    rows = [(f"{i}", i % 4 - 1, " ".join(f"w{(i * j * j + j) % (5 + i % 7)} the" for j in range(i % 30))) for i in range(90)] + [("x", 0, "Aa bb cc"), ("x", 0, "aa BB"), ("y", 1, None), ("z", -1, "cc dd"), ("u", 5, "only one"), (None, 2, "aa"), (None, 2, "aa")]
    d = spark.createDataFrame(rows, "name string, topic int, text string")
    each = lexical.terms(d, "name", stopwords=["the"], most=3).withColumn("name", F.coalesce("name", F.lit("")))
    topics = d.select(F.coalesce("name", F.lit("")).alias("name"), "topic").distinct()
    often = each.groupBy("term").agg(F.count_distinct("name").alias("df")).where("df >= 2").select("term")
    tf = each.join(often, "term").join(topics, "name").where("topic >= 0").groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = lambda x: sorted((r.topic, r["rank"], r.term, round(r.weight, 9)) for r in x.collect())
    want = rows(cluster.heaviest(tf, "topic", 10))
    for chunk in (lexical.CHUNK, 100):
        assert rows(lexical.heaviest_terms(d, "name", "topic", stopwords=["the"], most=3, min_df=2, chunk=chunk)) == want and len(want) > 25


def test_texts_are_cut_into_words_once(spark):
    from textloom.operators import cluster

    d = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, ""), (4, None)], "doc_id long, text string")
    x = cluster.text_vectors(d, size=16)
    assert "regexp_extract_all" not in plan(x) and sorted(r.doc_id for r in x.collect()) == [1, 2]
