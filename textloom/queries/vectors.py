"""V: vectors, statistics and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import classify, cluster, concepts, density, lexical, text_index, training
from textloom.operators import vectors as X
from textloom.operators.filters import concept_reason
from textloom.queries.aggregates import embeddings, scored_pair
from textloom.queries.filters import TOPIC_NOISE
from textloom.queries.joins import COS, DOT, alias_dim, term_list
from textloom.queries.registry import BM25, TOKENS_SQL, docs, query, split, table, terms, tokens
from textloom.sources import models
from textloom.sources.scratch import scratch_path
from textloom.queries.windows import NGRAMS, STOP, TFIDF, weights

PAIRS = "embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id"


def pairs(spark, d, values, columns, apart=True):
    """Each hundredth vector against all others."""
    e = table(spark, d, "embeddings")
    return X.all_pairs(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", values, columns, apart)


@query("v01_tfidf", f"WITH {TFIDF} SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tf, max(df) AS max_df, round(sum(weight), 4) AS weight, round(max(weight), 6) AS top FROM tfidf GROUP BY doc_id")
def v01(spark, d):
    return weights(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tf"), F.max("df").alias("max_df"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.max("weight"), 6).alias("top"))


@query("v01_tfidf_document_scope", f"WITH {NGRAMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY ALL) SELECT doc_id, round(sum(w), 4) AS weight, round(max(w), 6) AS top FROM (SELECT doc_id, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS w FROM tf) GROUP BY doc_id")
def v01_document(spark, d):
    return weights(spark, d, "document").groupBy("doc_id").agg(F.round(F.sum("weight"), 4).alias("weight"), F.round(F.max("weight"), 6).alias("top"))


def hashed_sql(text: str, size: int = 8, seed: str = "") -> str:
    raw = f"list_transform(range({size}), lambda i: ('0x' || substr(md5('{seed}|' || {text} || '|' || i), 1, 8))::BIGINT / 2147483648.0 - 1.0)"
    return f"(SELECT list_transform(r, lambda x: x / sqrt(list_inner_product(r, r))) FROM (SELECT {raw} AS r))"


EMBEDDED = f"emb AS (SELECT conv_id, turn, {hashed_sql('text')} AS v FROM conversations)"


def embedded(spark, d, seed=""):
    return table(spark, d, "conversations").select("conv_id", "turn", X.hash_embedding("text", 8, seed).alias("v"))


@query("v02_embedding", f"WITH {EMBEDDED} SELECT conv_id, turn, round(v[1], 6) AS first, round(v[8], 6) AS last, round(sqrt(list_inner_product(v, v)), 6) AS length FROM emb")
def v02(spark, d):
    return embedded(spark, d).select("conv_id", "turn", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 7), 6).alias("last"), F.round(X.norm("v"), 6).alias("length"))


@query("v03_sparse_embedding_similarity", f"WITH {TFIDF} SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.weight * b.weight), 6) AS score FROM tfidf a JOIN tfidf b USING (term) WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL")
def v03(spark, d):
    found = lexical.similar_documents(docs(spark, d), F.col("doc_id") % 100 == 0, stopwords=STOP, max_df=0.95, min_df=2)
    return found.where("a != b").withColumn("score", F.round("score", 6))


@query("v04_cosine_variants", f"SELECT a.vec_id AS i, b.vec_id AS j, round({DOT}, 5) AS dot, round({COS}, 6) AS cosine, round(greatest(0.0, {COS}), 6) AS positive, round(least(1.0, greatest(0.0, {COS})), 6) AS unit FROM {PAIRS}")
def v04(spark, d):
    def values(dot, cos):
        import numpy as np

        positive = np.where(cos < 0, 0.0, cos)
        return [X.rounded(dot, 5), X.rounded(cos), X.rounded(positive), X.rounded(np.where(positive > 1, 1.0, positive))]

    return pairs(spark, d, values, "dot, cosine, positive, unit")


@query("v05_pair_list", f"WITH {EMBEDDED} SELECT a.conv_id, a.turn, round(list_inner_product(a.v, b.v), 6) AS score FROM emb a JOIN emb b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def v05(spark, d):
    texts = table(spark, d, "conversations").select("text").distinct().withColumn("v", X.hash_embedding("text", 8))  # each text once
    c = table(spark, d, "conversations").select("conv_id", "turn", "text").join(texts, "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("v").alias("w"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.dot("v", "w"), 6).alias("score"))


@query("v06_similarity_matrix", f"SELECT a.vec_id AS i, b.vec_id AS j, round(least(1.0, greatest(-1.0, {COS})), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0")
def v06(spark, d):
    def values(dot, cos):
        import numpy as np

        return [X.rounded(np.clip(cos, -1.0, 1.0))]

    return pairs(spark, d, values, "score", apart=False)


@query("v07_semantic_validity", f"""WITH ref AS (SELECT {hashed_sql("'general programming'")} AS r), t AS (SELECT DISTINCT p_name AS term FROM part), s AS (SELECT term, round_even(list_inner_product({hashed_sql('term')}, r), 4) AS score FROM t, ref)
SELECT term, score::DOUBLE AS score, score >= 0.15 AS valid, CASE WHEN score < 0.15 THEN 'low_similarity' END AS reason FROM s""")
def v07(spark, d):
    reference = X.hash_embedding(F.lit("general programming"), 8)
    score = F.bround(X.dot(X.hash_embedding("term", 8), reference), 4)
    t = table(spark, d, "part").select(F.col("p_name").alias("term")).distinct().withColumn("score", score)
    return t.select("term", "score", (F.col("score") >= 0.15).alias("valid"), F.when(F.col("score") < 0.15, "low_similarity").alias("reason"))


REFERENCES = {"first": [1.0, 0, 0, 0, 0, 0, 0, 0], "second": [0, 1.0, 0, 0, 0, 0, 0, 0], "third": [0, 0, 1.0, 0, 0, 0, 0, 0]}


@query("v08_nearest_reference", f"WITH {EMBEDDED} SELECT conv_id, turn, CASE WHEN greatest(v[1], v[2], v[3]) < 0.3 THEN 'general' WHEN v[1] >= greatest(v[2], v[3]) THEN 'first' WHEN v[2] >= v[3] THEN 'second' ELSE 'third' END AS domain FROM emb")
def v08(spark, d):
    return embedded(spark, d).select("conv_id", "turn", X.nearest_reference("v", REFERENCES).alias("domain"))


@query("v09_similarity_map", f"WITH {EMBEDDED}, f AS (SELECT conv_id, arg_min(v, turn) AS f FROM emb GROUP BY conv_id) SELECT conv_id, count(*) AS n, round(max(list_inner_product(v, f)), 6) AS best, round(min(list_inner_product(v, f)), 6) AS worst FROM emb JOIN f USING (conv_id) GROUP BY conv_id")
def v09(spark, d):
    e = embedded(spark, d)
    f = e.groupBy("conv_id").agg(F.min_by("v", "turn").alias("f"))
    scored = e.join(f, "conv_id").withColumn("s", X.dot("v", "f"))
    return scored.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("s"), 6).alias("best"), F.round(F.min("s"), 6).alias("worst"))


@query("v10_mean_pooling", "WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS p FROM embeddings), m AS (SELECT label, p, avg(x::DOUBLE) AS m FROM u GROUP BY ALL) SELECT label, round(sum(m), 5) AS total, round(max(m), 6) AS top, count(*) AS size FROM m GROUP BY label")
def v10(spark, d):
    m = X.mean_pool(table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.array_max("embedding"), 6).alias("top"), F.size("embedding").cast("long").alias("size"))


@query("v11_offline_term_generation", f"WITH w AS (SELECT item_id, list_filter(regexp_extract_all(regexp_replace(text, '[^ -~]+', ' ', 'g'), '[a-zA-Z][a-zA-Z0-9_-]*'), lambda x: length(x) > 1 AND lower(x) NOT IN ({', '.join(repr(s) for s in STOP)})) AS w FROM benchmark) SELECT item_id, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS n FROM w")
def v11(spark, d):
    clean = F.regexp_replace("text", "[^ -~]+", " ")
    one = F.filter(T.candidates(clean, STOP), lambda c: ~F.contains(c, F.lit(" ")))
    return table(spark, d, "benchmark").select("item_id", F.size(one).cast("long").alias("n"))


@query("v11_provider_terms", """WITH f AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{6,}') AS w FROM documents), u AS (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:5] AS w FROM f) SELECT doc_id, array_to_string(w, ' ') AS terms FROM u""")
def v11_provider(spark, d):
    x = models.answers(docs(spark, d).select("doc_id", "text"), "text", models.word_generator(), "terms")
    return x.select("doc_id", F.array_join("terms", " ").alias("terms"))


@query("v20_provider_similarity")
def v20_provider(spark, d):
    # two encoders by one interface: how alike a text's vectors are to those of its first line
    x = docs(spark, d).select("doc_id", "text", F.substring_index("text", "\n", 1).alias("head"))
    for provider, name in ((models.hash_embedder(), "sentence"), (models.pooled_embedder(), "code")):
        for c in ("text", "head"):
            x = models.answers(x, c, provider, f"{name}_{c}")
    return x.select("doc_id", *[F.round(X.cosine(f"{n}_text", f"{n}_head"), 6).alias(n) for n in ("sentence", "code")])


@query("v12_keyword_statistics")
def v12(spark, d):
    return lexical.keyword_scores(docs(spark, d), stopwords=STOP).select("doc_id", "word", "tf", F.round("score", 6).alias("score"), "rank")


@query("v13_word_ranks")
def v13(spark, d):
    x = lexical.word_ranks(docs(spark, d), stopwords=STOP)
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("rank", 9)), "word"))
    return x.withColumn("place", best).where("place <= 20").select("doc_id", "word", F.round("rank", 6).alias("rank"), "place")


@query("v14_density_clusters")
def v14(spark, d):
    terms = lexical.keyword_scores(docs(spark, d), stopwords=STOP).select("doc_id", F.col("word").alias("term"))
    return cluster.term_clusters(terms.withColumn("v", X.hash_embedding("term", 4)), "doc_id", "term", "v")


@query("v14_similarity_clusters")
def v14_similar(spark, d):
    x = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))
    return cluster.density_clusters(x, "doc_id", "pos", "v", 0.5)


@query("v15_topic_model")
def v15(spark, d):
    assigned = cluster.topic_model(table(spark, d, "embeddings"), "vec_id", "embedding", 8, 4)
    return assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query("v15_density_topics")
def v15_density(spark, d):
    return density.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("vec_id", "cluster", F.round("confidence", 4).alias("confidence"))


TOPIC_TERMS = f"{TOKENS_SQL}, occ AS (SELECT lang AS topic, term, count(*) AS tf FROM tok JOIN documents USING (doc_id) GROUP BY ALL), al AS (SELECT term, sum(tf) AS a FROM occ GROUP BY term), mean AS (SELECT avg(t) AS m FROM (SELECT sum(tf) AS t FROM occ GROUP BY topic)), w AS (SELECT topic, term, tf * ln(1 + m / a) AS weight FROM occ JOIN al USING (term), mean)"


@query("v16_topic_terms", f"WITH {TOPIC_TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 6) DESC, term) AS rank FROM w) SELECT topic, term, round(weight, 4) AS weight, rank FROM r WHERE rank <= 5")
def v16(spark, d):
    assigned = docs(spark, d).select("doc_id", F.col("lang").alias("topic"))
    x = cluster.topic_terms(assigned, tokens(spark, d).select("doc_id", "term"), k=5)
    return x.select("topic", "term", F.round("weight", 4).alias("weight"), "rank")


def discovered(spark, d):
    """Topics of all documents, from their words."""
    from textloom.sources.scratch import materialize

    texts = materialize(spark, cluster.text_vectors(docs(spark, d), stopwords=STOP))  # each fit reads them again
    assigned = materialize(spark, cluster.topic_model(texts, "doc_id", "vector", 8), texts)
    return assigned, cluster.discover(docs(spark, d), assigned, stopwords=STOP)


@query("v17_concept_discovery")
def v17(spark, d):
    _, topics = discovered(spark, d)
    kept = topics.where("topic >= 0").withColumn("terms", F.filter("terms", lambda t: ~t.isin(TOPIC_NOISE)))
    quality = concepts.topic_quality(F.array_join(F.slice("terms", 1, 3), " "), "terms", "size", TOPIC_NOISE)
    return kept.select("topic", "size", "representatives", "name", "terms", F.round(quality, 6).alias("quality"))


def labelled(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 4).cast("int").alias("y"))


@query("v18_trained_inference")
def v18(spark, d):
    x = labelled(spark, d)
    model = classify.train(x, "embedding", "y")
    return classify.predict(x, "embedding", model, ["keyword", "concept"]).select("vec_id", "predicted", F.round("confidence", 4).alias("confidence"))


@query("v19_training_weights", "WITH x AS (SELECT label < 4 AS y FROM embeddings) SELECT y::INT AS y, count(*) AS n, round((SELECT count(*) FROM x) / ((SELECT count(DISTINCT y) FROM x) * count(*)), 6) AS weight FROM x GROUP BY y")
def v19(spark, d):
    counts = labelled(spark, d).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row a class
    return counts.select("y", "n", F.round(F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n")), 6).alias("weight"))


SEEDS = ["general", "code", "concept"]
THREE = ", ".join(f"{hashed_sql('text', 8, s)} AS {s}" for s in SEEDS)


def three(spark, d):
    return table(spark, d, "benchmark").select("item_id", *[X.hash_embedding("text", 8, s).alias(s) for s in SEEDS])


@query("v20_three_embedders", f"WITH e AS (SELECT item_id, {THREE} FROM benchmark) SELECT item_id, round(general[1], 6) AS a, round(code[1], 6) AS b, round(concept[1], 6) AS c FROM e")
def v20(spark, d):
    return three(spark, d).select("item_id", *[F.round(F.get(s, 0), 6).alias(n) for s, n in zip(SEEDS, "abc", strict=True)])


FUSED = f"e AS (SELECT item_id, {THREE} FROM benchmark), raw AS (SELECT *, list_transform(range(1, 9), lambda i: general[i] * 0.5 + code[i] * 0.3 + concept[i] * 0.2) AS r FROM e), fused AS (SELECT *, list_transform(r, lambda x: x / sqrt(list_inner_product(r, r))) AS f FROM raw)"


@query("v21_fusion", f"WITH {FUSED} SELECT item_id, round(f[1], 6) AS first, round(f[8], 6) AS last FROM fused")
def v21(spark, d):
    f = three(spark, d).select("item_id", X.fuse(SEEDS, [0.5, 0.3, 0.2]).alias("f"))
    return f.select("item_id", F.round(F.get("f", 0), 6).alias("first"), F.round(F.get("f", 7), 6).alias("last"))


@query("v22_unified_similarity", f"WITH {FUSED} SELECT b.item_id, round(list_inner_product(a.f, b.f), 6) AS fused, round(list_inner_product(a.general, b.general), 6) AS general, round(list_inner_product(a.code, b.code), 6) AS code, round(list_inner_product(a.concept, b.concept), 6) AS concept FROM fused a JOIN fused b ON a.item_id = 0 AND b.item_id <> 0")
def v22(spark, d):
    e = three(spark, d).withColumn("f", X.fuse(SEEDS, [0.5, 0.3, 0.2]))
    one = e.where("item_id = 0").select(*[F.col(c).alias(f"q_{c}") for c in ["f", *SEEDS]])
    x = e.where("item_id != 0").join(F.broadcast(one))  # one query
    return x.select("item_id", F.round(X.dot("q_f", "f"), 6).alias("fused"), *[F.round(X.dot(f"q_{s}", s), 6).alias(s) for s in SEEDS])


@query("v23_contrastive_loss", f"WITH s AS (SELECT a.vec_id AS i, a.label = b.label AS pos, {COS} / 0.07 AS l FROM {PAIRS}), z AS (SELECT i, ln(sum(exp(l))) AS z FROM s GROUP BY i) SELECT i, round(avg(z - l) FILTER (WHERE pos), 5) AS loss FROM s JOIN z USING (i) GROUP BY i")
def v23(spark, d):
    # of each query and pack the sum of exp(l), and number and sum of l of the positive ones: the mean of z - l is z less the mean of l
    def work(q, r):
        import numpy as np
        import pyarrow as pa

        score, pos = scored_pair(q, r, None)
        l = score / 0.07  # noqa: E741
        pos &= ~np.isnan(l)
        yield pa.RecordBatch.from_pydict({"i": q.ids("vec_id"), "e": np.nansum(np.exp(l), axis=1), "n": pos.sum(1), "l": np.where(pos, l, 0.0).sum(1), "others": (~np.isnan(l)).sum(1)})

    s = X.compared(*embeddings(spark, d), "embedding", work, "i long, e double, n long, l double, others long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("e", "n", "l", "others")])
    return s.where("others > 0").select("i", F.round(F.when(F.col("n") > 0, F.log("e") - F.col("l") / F.col("n")), 5).alias("loss"))


@query("v24_fine_tuning_pairs", "SELECT p_partkey, p_size / 50 AS score FROM part WHERE p_size / 50 >= 0.7 AND length(trim(p_name)) > 0")
def v24(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("anchor"), F.col("p_type").alias("positive"), (F.col("p_size") / 50).alias("score"))
    return training.multiple_negatives(x).select("p_partkey", "score")


@query("v25_fake_embedding", f"SELECT p_partkey, round({hashed_sql('p_name', 16, 'fake')}[1], 6) AS first FROM part")
def v25(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.get(X.hash_embedding("p_name", 16, "fake"), 0), 6).alias("first"))


@query("v26_seed_validation", f"WITH seeds AS (SELECT {hashed_sql('text')} AS s FROM benchmark), t AS (SELECT DISTINCT p_type AS term, {hashed_sql('p_type')} AS v FROM part) SELECT term, round(max(list_inner_product(v, s)), 6) AS best, max(list_inner_product(v, s)) >= 0.35 AS valid FROM t, seeds GROUP BY term")
def v26(spark, d):
    seeds = table(spark, d, "benchmark").select(X.hash_embedding("text", 8).alias("s"))
    t = table(spark, d, "part").select(F.col("p_type").alias("term")).distinct().withColumn("v", X.hash_embedding("term", 8))
    return X.against(seeds, t, bytes_a_row=100).groupBy("term").agg(F.round(F.max(X.dot("v", "s")), 6).alias("best"), (F.max(X.dot("v", "s")) >= 0.35).alias("valid"))


@query("v27_diagram_embedding", f"SELECT p_partkey, round({hashed_sql(chr(39) + 'Figure: ' + chr(39) + ' || p_name || ' + chr(39) + ' ' + chr(39) + ' || p_type')}[2], 6) AS second FROM part")
def v27(spark, d):
    text = F.concat_ws(" ", F.concat(F.lit("Figure: "), "p_name"), "p_type")
    return table(spark, d, "part").select("p_partkey", F.round(F.get(X.hash_embedding(text, 8), 1), 6).alias("second"))


def bm25(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.bm25(docs(spark, d), q)


@query("v28_bm25", f"WITH {BM25} SELECT query_id, doc_id, round(score, 5) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 20")
def v28(spark, d):
    from textloom.operators.ranking import top_by

    x = top_by(bm25(spark, d), ["query_id"], [F.desc(F.round("score", 6)), "doc_id"], 20)
    return x.select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query("v28_indexed_bm25", f"WITH {BM25} SELECT query_id, doc_id, round(score, 5) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 20")
def v28_indexed(spark, d):
    path = scratch_path(spark, "words")
    text_index.build(docs(spark, d), path)
    found = text_index.search(spark, path, table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), 20)
    return found.select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query("v29_triplets", f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) - 1 AS k, count(*) OVER (PARTITION BY query_id) AS c FROM bm), m AS (SELECT * FROM r WHERE k >= c // 3 AND k < 2 * c // 3) SELECT query_id, arg_min(doc_id, md5(doc_id || ':0')) AS negative, (SELECT r.doc_id FROM r WHERE r.query_id = m.query_id AND k = 0) AS positive FROM m GROUP BY query_id")
def v29(spark, d):
    from textloom.operators.ranking import ranked
    from textloom.sources.scratch import materialize

    scores = materialize(spark, bm25(spark, d).withColumn("score", F.round("score", 6)))
    counts = scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"))
    # ranks by ranges, as a frequent word's query has a row for most documents; a query's rows never meet in one task
    x = ranked(scores, ["query_id"], [F.desc("score"), "doc_id"], "k").join(counts, "query_id").withColumn("k", F.col("k") - 1)
    middle = (F.col("k") >= F.floor(F.col("c") / 3)) & (F.col("k") < F.floor(2 * F.col("c") / 3))
    out = x.groupBy("query_id").agg(F.min_by(F.when(middle, F.col("doc_id")), F.when(middle, F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":0"))))).alias("negative"), F.max(F.when(F.col("k") == 0, F.col("doc_id"))).alias("positive"), F.count_if(middle).alias("n"))
    return out.where("n > 0").select("query_id", "negative", "positive")
