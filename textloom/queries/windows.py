"""W: ranking, order and keep-first; U: set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom import vocabulary as V
from textloom.functions import text as T
from textloom.operators import documents, lexical, ranking, vector_index
from textloom.operators import vectors as X
from textloom.queries.aggregates import RETRIEVED, retrieved
from textloom.queries.joins import COS, STAGES, alias_dim, ALIAS_SQL, assembled
from textloom.sources.scratch import scratch_path
from textloom.queries.registry import BM25, SPLIT, TOKENS_SQL, docs, literals, query, split, table, terms, TERMS_SQL, tokens

STOP = ["the", "of", "and", "to", "in", "is", "it", "on", "for", "der", "die", "und", "de", "la", "le", "el"]
NGRAMS = f"""words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda w: w NOT IN ({literals(STOP)})) AS w FROM documents),
occ AS (SELECT doc_id, unnest(w) AS term FROM words UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words)"""
TFIDF = f"""{NGRAMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY ALL), nd AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), kept AS (SELECT term, df, n FROM df, nd WHERE df >= 2 AND df <= n * 0.95),
raw AS (SELECT doc_id, term, tf, df, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN kept USING (term)), tfidf AS (SELECT doc_id, term, tf, df, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def weighted(spark, d, scope="corpus"):
    """(doc_id, terms): each document's terms and weights."""
    if scope == "document":
        return lexical.weighted(docs(spark, d), stopwords=STOP, scope=scope)
    return lexical.weighted(docs(spark, d), stopwords=STOP, max_df=0.95, min_df=2)


def weights(spark, d, scope="corpus"):
    return weighted(spark, d, scope).select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.*")


@query("w01_tfidf_top_k", f"WITH {TFIDF}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term DESC) AS rank FROM tfidf) SELECT doc_id, term, round(round(weight, 9), 6) AS weight, rank FROM r WHERE rank <= 10")
def w01(spark, d):
    # the best of each document's own list, where it lies
    best = F.slice(F.reverse(F.array_sort(F.transform("terms", lambda t: F.struct(F.round(t["weight"], 9).alias("weight"), t["term"].alias("term"))))), 1, 10)
    x = weighted(spark, d).select("doc_id", F.posexplode(best).alias("pos", "t"))
    return x.select("doc_id", "t.term", F.round("t.weight", 6).alias("weight"), (F.col("pos") + 1).alias("rank"))


@query("w02_similarity_top_k", f"WITH {RETRIEVED} SELECT q AS query, m AS match, score, rk AS rank FROM ranked WHERE rk <= 5 AND score >= 0.1")
def w02(spark, d):
    e = table(spark, d, "embeddings")
    x = X.top_similar(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", 5, 0.1, places=6)
    return x


@query("w02_indexed_similarity")
def w02_indexed(spark, d):
    e = table(spark, d, "embeddings")
    path = scratch_path(spark, "vectors")
    vector_index.build(e, path, "vec_id", "embedding")
    return vector_index.search(spark, path, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).withColumn("score", F.round("score", 6))


@query("w03_similar_chapters", f"""WITH sims AS (SELECT b.vec_id AS id, round({COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id = 0) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sims WHERE score >= 0.05 QUALIFY rank <= 10""")
def w03(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = X.against(one, e).select(F.col("vec_id").alias("id"), F.round(X.cosine("q", "embedding"), 6).alias("score")).where("score >= 0.05")
    top = scored.orderBy(F.desc("score"), "id").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


@query("w04_relevance_ranking", f"""WITH sims AS (SELECT a.vec_id AS q, b.vec_id AS id, round(least(1.0, greatest(0.0, {COS})), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0) SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM sims""")
def w04(spark, d):
    e = table(spark, d, "embeddings")
    def work(q, r):
        import numpy as np

        score = X.rounded(np.clip(X.products(q, r)[1], 0.0, 1.0))
        yield from X.score_packs(q.ids("vec_id"), r.ids("vec_id"), score, np.zeros(score.shape, bool))

    def listed(key, score, ids, _):
        import numpy as np
        import pyarrow as pa

        return pa.table({"q": np.full(len(ids), key), "id": ids, "score": score, "rank": np.arange(1, len(ids) + 1)})

    found = X.compared(e.where("vec_id % 100 = 0").select("vec_id", "embedding"), e.where("vec_id is not null").select("vec_id", "embedding"), "embedding", work, X.SCORE_PACK)
    return X.ranked_packs(found, listed, "q long, id long, score double, rank long")


@query("w05_positional_score", f"WITH {TOKENS_SQL} SELECT doc_id, pos, term, round(greatest(0.1, 1 - pos * 0.1), 6)::DOUBLE AS score FROM tok")
def w05(spark, d):
    return tokens(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "term", F.round(ranking.positional_score("pos"), 6).alias("score"))


@query("w06_fallback_score", f"WITH {TOKENS_SQL}, t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM tok) SELECT doc_id, pos, (((1 - pos / n * 0.3::DOUBLE) + least(length(term) / 10, 1.0::DOUBLE)) / 2)::DOUBLE AS score FROM t")
def w06(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return tokens(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), ranking.fallback_score("pos", n, "term").alias("score"))


def results(spark, d):
    """Search results made of line items: book, chapter, score, place."""
    x = table(spark, d, "lineitem")
    return x.select(F.concat(F.lit("b"), (F.col("l_suppkey") % 20).cast("string")).alias("book"), (F.col("l_partkey") % 50).alias("chapter"), (F.col("l_quantity") / 50).alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


RESULTS = "res AS (SELECT 'b' || (l_suppkey % 20) AS book, l_partkey % 50 AS chapter, l_quantity / 50 AS score, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)"


@query("w07_keep_best", f"WITH {RESULTS} SELECT book, chapter, score, pos FROM res QUALIFY row_number() OVER (PARTITION BY book, chapter ORDER BY score DESC, pos) = 1")
def w07(spark, d):
    return ranking.best_results(results(spark, d))


def stem_sql(c: str) -> str:
    rules = " ".join(f"WHEN ends_with(lower({c}), '{s}') AND length({c}) - {len(s)} + {len(r)} >= {n} THEN left({c}, length({c}) - {len(s)}) || '{r}'" for s, r, n in V.SUFFIX_RULES)
    return f"CASE WHEN lower({c}) IN ({literals(V.PROTECTED_TERMS)}) THEN {c} {rules} ELSE {c} END"


@query("w08_keep_first_per_stem", f"WITH {TOKENS_SQL} SELECT doc_id, pos, term FROM tok QUALIFY row_number() OVER (PARTITION BY doc_id, lower({stem_sql('term')}) ORDER BY pos) = 1")
def w08(spark, d):
    return ranking.dedup_by_stem(tokens(spark, d), "doc_id", "term", "pos").select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


@query("w09_shortest_per_cluster", """WITH x AS (SELECT CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size END AS label, p_name AS term, p_partkey AS pos FROM part)
SELECT label, term, pos FROM x WHERE label = -1 UNION ALL SELECT label, term, pos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY length(term), pos) AS n FROM x WHERE label <> -1) WHERE n = 1""")
def w09(spark, d):
    x = table(spark, d, "part").select(F.when(F.col("p_size") % 7 == 0, -1).otherwise(F.col("p_size")).alias("label"), F.col("p_name").alias("term"), F.col("p_partkey").alias("pos"))
    return ranking.shortest_per_cluster(x, "label", "term", "pos")


@query("w10_keep_first_case_insensitive", f"WITH w AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {split('text')} AS w FROM documents)), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY pos) AS n FROM w) SELECT doc_id, array_to_string(list(t ORDER BY pos), ' ') AS kept FROM f WHERE n = 1 GROUP BY doc_id")
def w10(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.keep_first(T.split_words("text")), " ").alias("kept")).where("kept != ''")


@query("w11_middle_third", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS c FROM part) SELECT p_brand, p_partkey FROM r WHERE r >= c // 3 AND r < 2 * c // 3")
def w11(spark, d):
    return ranking.middle_third(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), "p_partkey"]).select("p_brand", "p_partkey")


@query("w12_limit_then_filter", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3 AND o_totalprice >= 150000")
def w12(spark, d):
    return ranking.limit_then_filter(table(spark, d, "orders"), "o_custkey", ["o_orderkey"], 3, F.col("o_totalprice") >= 150000).select("o_custkey", "o_orderkey")


@query("w13_rescored", f"""WITH {BM25}, top AS (SELECT query_id, doc_id, round(score, 6) AS base FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 20),
asked AS (SELECT item_id, list_distinct({split('lower(text)')}) AS words FROM benchmark), c AS (SELECT doc_id, list_distinct({split('lower(text)')}) AS c FROM documents)
SELECT query_id, top.doc_id, round(base / 100 * 0.5 + len(list_intersect(words, c)) / greatest(len(words), 1) * 0.5, 6)::DOUBLE AS score FROM top JOIN asked ON asked.item_id = query_id JOIN c ON c.doc_id = top.doc_id""")
def w13(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    found = ranking.top_by(lexical.bm25(docs(spark, d), asked.withColumnRenamed("q", "text")), ["query_id"], [F.desc(F.round("score", 6)), "doc_id"], 20)
    x = found.select("query_id", "doc_id", (F.round("score", 6) / 100).alias("base")).join(asked, "query_id").join(docs(spark, d).select("doc_id", "text"), "doc_id")
    return x.select("query_id", "doc_id", F.round(ranking.rescored(F.col("base"), "text", "q"), 6).alias("score"))


@query("w14_term_expansion", f"WITH {RETRIEVED} SELECT q, m, score FROM ranked WHERE rk <= 3 AND score >= 0.15")
def w14(spark, d):
    return retrieved(spark, d, 3).where("score >= 0.15").select("q", "m", "score")


@query("w15_quality_sort", "SELECT label AS topic, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) AS place FROM embeddings GROUP BY label")
def w15(spark, d):
    x = table(spark, d, "embeddings").groupBy(F.col("label").alias("topic")).agg(F.count(F.lit(1)).alias("size"))
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "topic")))  # one row a topic


@query("w16_primary_and_related", f"SELECT conv_id, turn, array_to_string(t[1:5], ' ') AS main, array_to_string(t[6:10], ' ') AS related FROM (SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) AS t FROM (SELECT conv_id, turn, {split('lower(text)')} AS w FROM conversations))")
def w16(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.split_words(F.lower("text"))).alias("t"))
    return x.select("conv_id", "turn", F.array_join(F.slice("t", 1, 5), " ").alias("main"), F.array_join(F.slice("t", 6, 5), " ").alias("related"))


@query("w17_frames", "SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS behind, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w17(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("behind"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"))


@query("u01_stopword_union", f"SELECT unnest([{literals(STOP)}]) AS term UNION SELECT lower(w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)")
def u01(spark, d):
    custom = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term"))
    return spark.createDataFrame([(s,) for s in STOP], "term string").union(custom).distinct()


@query("u02_noise_union", f"SELECT unnest([{literals(V.CONCEPT_NOISE)}]) AS term UNION SELECT unnest([{literals(V.KNOWN_AUTHORS)}]) UNION SELECT lower(p_brand) FROM part")
def u02(spark, d):
    fixed = spark.createDataFrame([(s,) for s in V.CONCEPT_NOISE + V.KNOWN_AUTHORS], "term string")
    return fixed.union(table(spark, d, "part").select(F.lower("p_brand"))).distinct()


@query("u03_except_new_terms", f"WITH {TERMS_SQL} SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part) WHERE lower(w) NOT IN (SELECT lower(term) FROM terms)")
def u03(spark, d):
    new = table(spark, d, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("term"))
    return new.distinct().join(terms(spark, d).select(F.lower("term").alias("term")), "term", "left_anti")


@query("u04_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT p_partkey FROM part WHERE p_size < 10")
def u04(spark, d):
    x = table(spark, d, "lineitem")
    small = table(spark, d, "part").where("p_size < 10").select("p_partkey")
    return x.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(x.where("l_quantity > 40").select("l_partkey").subtract(small))


@query("u05_priority_union", f"WITH {ALIAS_SQL} SELECT alias, canonical_term, classification FROM aliases")
def u05(spark, d):
    return alias_dim(spark, d)


@query("u06_sorted_union", f"SELECT conv_id, array_to_string(list_sort(list_distinct(flatten(list({split('lower(text)')})))), ' ') AS words FROM conversations GROUP BY conv_id")
def u06(spark, d):
    words = table(spark, d, "conversations").select("conv_id", F.explode(T.split_words(F.lower("text"))).alias("w")).distinct()
    return words.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("words"))


@query("u07_ordered_union", f"SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS merged FROM (SELECT conv_id, turn, {split('lower(text)')} || ['the', 'with', 'new'] AS w FROM conversations)")
def u07(spark, d):
    more = F.array(*[F.lit(x) for x in ("the", "with", "new")])
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(F.concat(T.split_words(F.lower("text")), more)), " ").alias("merged"))
