"""A: aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import concepts, metrics, ranking
from textloom.operators import vectors as X
from textloom.queries.filters import CODE_WORDS, code_sql
from textloom.queries.joins import COS, DIMS, STAGES, VERDICTS, assembled, domain_dim, hits, hits_sql, verdicts
from textloom.queries.registry import TOKENS_SQL, docs, query, table, tokens

SCORES = f"""{hits_sql()}, n AS (SELECT k, domain, count(*) FILTER (WHERE kind = 'primary') AS np, count(*) FILTER (WHERE kind = 'domain') AS nd FROM hits GROUP BY ALL),
scores AS (SELECT k, domain, np, nd, round(least(1.0, greatest(0.0, 0.5 + CASE WHEN nd > 0 THEN nd * boost + np * 0.05 WHEN np > 0 THEN penalty ELSE 0 END)), 6)::DOUBLE AS score, boost, penalty, tier FROM n JOIN dom USING (domain) WHERE nd >= min_matches),
concepts AS (SELECT k, domain, keyword AS name, round(CASE WHEN bool_or(kind = 'domain') THEN least(1.0, 0.5 + any_value(boost) * 2) ELSE greatest(0.0, least(1.0, 0.5 + any_value(penalty))) END, 6)::DOUBLE AS confidence, coalesce(any_value(tier), 'unknown') AS tier
 FROM hits JOIN scores USING (k, domain) GROUP BY k, domain, keyword),
detected AS (SELECT k, domain, round_even(s / sum(s) OVER (PARTITION BY k), 3) AS share, row_number() OVER (PARTITION BY k ORDER BY round(s, 6) DESC, domain) AS r FROM (SELECT k, domain, sum(confidence) AS s FROM concepts GROUP BY ALL))"""


def scored(spark, d):
    return concepts.domain_scores(hits(spark, d), domain_dim(spark)).withColumn("score", F.round("score", 6))


def concept_rows(spark, d):
    return concepts.concept_rows(hits(spark, d), scored(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("a01_domain_detection", f"WITH {SCORES} SELECT k AS doc_id, domain, share FROM detected WHERE r = 1")
def a01(spark, d):
    return concepts.detect_domain(concept_rows(spark, d))


@query("a02_domain_score", f"WITH {SCORES} SELECT k AS doc_id, domain, np AS n_primary, nd AS n_domain, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, domain) = 1 AS is_primary FROM scores")
def a02(spark, d):
    s = scored(spark, d)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "domain")) == 1
    return s.select("doc_id", "domain", "n_primary", "n_domain", "score", first.alias("is_primary"))


@query("a03_concept_rows", f"WITH {SCORES} SELECT k AS doc_id, domain, name, confidence, tier FROM concepts")
def a03(spark, d):
    return concept_rows(spark, d).select("doc_id", "domain", "name", "confidence", "tier")


#: Over kn keywords, cn concepts, the domain's share and the length of the text.
QUALITY_SQL = """round_even(least(1.0, greatest(0.0, 0.3 * CASE WHEN kn >= 3 THEN least(kn / 20, 1.0) ELSE kn / 3 * 0.5 END + 0.3 * CASE WHEN cn >= 1 THEN least(cn / 10, 1.0) ELSE 0 END + 0.2 * share
 + 0.2 * CASE WHEN len < 100 THEN len / 100 * 0.5 WHEN len > 10000 THEN 1.0 ELSE (len - 100) / 9900 * 0.5 + 0.5 END))::DOUBLE, 3)::DOUBLE"""


@query("a04_quality_score", f"""WITH {SCORES}, kw2 AS (SELECT doc_id, count(DISTINCT term) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS term FROM documents) GROUP BY 1),
c2 AS (SELECT k, count(*) AS n FROM concepts GROUP BY 1), x AS (SELECT d.doc_id, coalesce(kw2.n, 0) AS kn, coalesce(c2.n, 0) AS cn, coalesce(share, 0) AS share, length(text) AS len FROM documents d LEFT JOIN kw2 USING (doc_id) LEFT JOIN c2 ON c2.k = doc_id LEFT JOIN detected ON detected.k = doc_id AND r = 1)
SELECT doc_id, {QUALITY_SQL} AS quality FROM x""")
def a04(spark, d):
    kn = tokens(spark, d).groupBy("doc_id").agg(F.count_distinct("term").alias("kn"))
    c = concept_rows(spark, d)
    cn = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cn"))
    x = docs(spark, d).join(kn, "doc_id", "left").join(cn, "doc_id", "left").join(concepts.detect_domain(c), "doc_id", "left")
    score = concepts.quality_score(F.coalesce("kn", F.lit(0)), F.coalesce("cn", F.lit(0)), "share", F.length("text"))
    return x.select("doc_id", score.alias("quality"))


AGREED = f"""{STAGES}, t AS (SELECT doc_id, term, (term IN (SELECT term FROM val)) AS ok, coalesce(score, 0) AS rs FROM gen LEFT JOIN ranked USING (doc_id, term)),
v AS (SELECT *, 1 + ok::INT + (rs >= 0.5)::INT AS models_agreed FROM t)"""


@query("a05_consensus_vote", f"WITH {AGREED} SELECT doc_id, term, models_agreed, models_agreed >= 2 AS accepted, CASE WHEN models_agreed >= 2 THEN floor((0.8 + rs) / 3 * 1e6 + 0.5) / 1e6 END AS score, CASE WHEN models_agreed < 2 THEN 'insufficient_agreement: ' || models_agreed || '/2' END AS reason FROM v")
def a05(spark, d):
    x = ranking.consensus(assembled(spark, d))
    # halves are rounded alike on both sides: round() goes by the decimal digits in Spark and by the product in DuckDB
    return x.select("doc_id", "term", "models_agreed", "accepted", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"), "reason")


@query("a06_tier_statistics", "SELECT l_partkey % 100 AS doc, count(*) FILTER (WHERE l_linenumber = 1) AS tier_1_hits, count(*) FILTER (WHERE l_linenumber = 2) AS tier_2_hits, count(*) FILTER (WHERE l_linenumber >= 3 AND l_returnflag = 'R') AS tier_3_rejections, count(*) AS total FROM lineitem GROUP BY 1")
def a06(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 100).alias("doc")).agg(
        F.count_if(n == 1).alias("tier_1_hits"), F.count_if(n == 2).alias("tier_2_hits"), F.count_if((n >= 3) & (F.col("l_returnflag") == "R")).alias("tier_3_rejections"), F.count(F.lit(1)).alias("total")
    )


@query("a07_concept_audit", f"""WITH {TOKENS_SQL}, occ AS (SELECT term, doc_id, source FROM tok JOIN documents USING (doc_id) WHERE length(term) > 3)
SELECT term AS concept, count(*) AS occurrences, count(DISTINCT source) AS books, count(DISTINCT doc_id) AS chapters, max(source) AS last_source, array_to_string(list_sort(list_distinct(list(lang)))[1:10], ',') AS sample FROM occ JOIN documents USING (doc_id, source) GROUP BY term HAVING count(*) >= 5""")
def a07(spark, d):
    x = docs(spark, d).select("doc_id", "source", "lang", F.explode(T.words("text")).alias("term")).where("length(term) > 3")
    sample = F.array_join(F.slice(F.array_sort(F.collect_set("lang")), 1, 10), ",")  # languages: few, so the set is small
    # a word's occurrences in a document are counted first, then documents: no distinct count over occurrences
    chapters = x.groupBy("term", "doc_id", "source", "lang").agg(F.count(F.lit(1)).alias("n"))
    out = chapters.groupBy(F.col("term").alias("concept")).agg(F.sum("n").alias("occurrences"), F.size(F.collect_set("source")).cast("long").alias("books"), F.count(F.lit(1)).alias("chapters"), F.max("source").alias("last_source"), sample.alias("sample"))
    return out.where("occurrences >= 5")


@query("a08_domain_histogram", f"WITH {SCORES} SELECT domain, count(*) AS n, count(DISTINCT name) AS n_concepts, count(DISTINCT k) AS n_docs FROM concepts GROUP BY domain")
def a08(spark, d):
    return concept_rows(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("n_concepts"), F.count_distinct("doc_id").alias("n_docs"))


#: Retrieval over the embeddings: each hundredth vector is a query, its label's vectors are relevant.
RETRIEVED = f"""sims AS (SELECT a.vec_id AS q, b.vec_id AS m, round({COS}, 6) AS score, a.label = b.label AS rel FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, m) AS rk, count(*) FILTER (WHERE rel) OVER (PARTITION BY q) AS nrel FROM sims)"""


def embeddings(spark, d):
    """(queries, rows): each hundredth vector, and all that have an id."""
    e = table(spark, d, "embeddings").where("vec_id is not null").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    return e.where("vec_id % 100 = 0"), e


def scored_pair(q, r, places=6):
    """(score, rel) of all pairs of two packs, as arrays; a row's own pair has score NaN."""
    import numpy as np

    score = X.products(q, r)[1]
    score = score if places is None else X.rounded(score, places)
    score[q.ids("vec_id")[:, None] == r.ids("vec_id")[None, :]] = np.nan
    labels = [p.columns["label"].combine_chunks() for p in (q, r)]
    known = [np.asarray(x.is_valid()) for x in labels]
    a, b = (np.asarray(x.fill_null(0)) for x in labels)
    rel = (a[:, None] == b[None, :]) & known[0][:, None] & known[1][None, :]
    return score, rel & (q.ids("vec_id")[:, None] != r.ids("vec_id")[None, :])


def retrieved(spark, d, k):
    """(q, m, score, rel, nrel, rk): the k most similar ones of each query, with their rank and the number of all relevant ones; a task passes on the k best of each pack only."""

    def work(q, r):
        import numpy as np
        import pyarrow as pa

        score, rel = scored_pair(q, r)
        row, column = X.best_of(score, r.ids("vec_id"), k)
        first = np.r_[True, row[1:] != row[:-1]][: len(row)]  # a pack's count goes with one row
        yield pa.RecordBatch.from_pydict({"q": q.ids("vec_id")[row], "m": r.ids("vec_id")[column], "score": score[row, column], "rel": rel[row, column], "n": np.where(first, rel.sum(1)[row], 0)})

    found = X.compared(*embeddings(spark, d), "embedding", work, "q long, m long, score double, rel boolean, n long")
    counted = found.withColumn("nrel", F.sum("n").over(Window.partitionBy("q"))).drop("n")
    return ranking.top_by(counted, ["q"], [F.desc("score"), "m"], k, "rk")


def precisions(spark, d):
    """(q, ap): average precision over the whole ranking of each query.

    A query's scores come together as packed whole numbers, millionths of a cosine, and are sorted as such.
    """

    def work(q, r):
        import numpy as np

        score, rel = scored_pair(q, r)
        yield from X.score_packs(q.ids("vec_id"), r.ids("vec_id"), score, rel)

    def measure(key, score, ids, rel):
        import numpy as np
        import pyarrow as pa

        at = np.flatnonzero(rel) + 1
        ap = (np.arange(1, len(at) + 1) / at).sum() / len(at) if len(at) else 0.0
        return pa.table({"q": pa.array([key], pa.int64()), "ap": pa.array([ap], pa.float64())})

    return X.ranked_packs(X.compared(*embeddings(spark, d), "embedding", work, X.SCORE_PACK), measure, "q long, ap double")


@query("a09_recall_at_k", f"WITH {RETRIEVED} SELECT q, round(CASE WHEN max(nrel) > 0 THEN count(*) FILTER (WHERE rel AND rk <= 10) / max(nrel) ELSE 0 END, 6)::DOUBLE AS recall_10, (count(*) FILTER (WHERE rel AND rk <= 10) > 0)::INT::DOUBLE AS hit_10 FROM ranked GROUP BY q")
def a09(spark, d):
    found = retrieved(spark, d, 10).groupBy("q").agg(F.count_if("rel").alias("hits"), F.max("nrel").alias("nrel"))
    recall = F.when(F.col("nrel") > 0, F.col("hits") / F.col("nrel")).otherwise(0.0)
    return found.select("q", F.round(recall, 6).alias("recall_10"), (F.col("hits") > 0).cast("int").cast("double").alias("hit_10"))


AP = f"{RETRIEVED}, p AS (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY rk) / rk AS prec FROM ranked)"


@query("a10_average_precision", f"WITH {AP} SELECT q, round(CASE WHEN max(nrel) > 0 THEN coalesce(sum(prec) FILTER (WHERE rel), 0) / max(nrel) ELSE 0 END, 6)::DOUBLE AS ap FROM p GROUP BY q")
def a10(spark, d):
    return precisions(spark, d).withColumn("ap", F.round("ap", 6))


@query("a11_code_query_recall", f"WITH {RETRIEVED}, code AS (SELECT doc_id FROM documents WHERE {code_sql('text')}), h AS (SELECT q, max((rel AND rk <= 10)::INT) AS hit FROM ranked WHERE q IN (SELECT doc_id FROM code) GROUP BY q) SELECT round(avg(hit), 6) AS recall, count(*) AS n FROM h")
def a11(spark, d):
    code = docs(spark, d).where(T.is_code_query("text", CODE_WORDS)).select(F.col("doc_id").alias("q"))  # a query's text is the document of its id
    h = retrieved(spark, d, 10).join(code, "q", "left_semi").groupBy("q").agg(F.max(F.col("rel").cast("int")).alias("hit"))
    return h.agg(F.round(F.avg("hit"), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


BENCH = f"{AP}, ap AS (SELECT q, CASE WHEN max(nrel) > 0 THEN coalesce(sum(prec) FILTER (WHERE rel), 0) / max(nrel) ELSE 0 END AS ap FROM p GROUP BY q), h AS (SELECT q, max((rel AND rk <= 1)::INT) AS h1, max((rel AND rk <= 5)::INT) AS h5, max((rel AND rk <= 10)::INT) AS h10 FROM ranked GROUP BY q)"


def benchmark(spark, d):
    ap = precisions(spark, d).agg(F.round(F.avg("ap"), 6).alias("map"))
    at = lambda k: F.max((F.col("rel") & (F.col("rk") <= k)).cast("int"))
    h = retrieved(spark, d, 10).groupBy("q").agg(at(1).alias("h1"), at(5).alias("h5"), at(10).alias("h10"))
    return h.agg(F.round(F.avg("h1"), 6).alias("recall_1"), F.round(F.avg("h5"), 6).alias("recall_5"), F.round(F.avg("h10"), 6).alias("recall_10"), F.count(F.lit(1)).alias("queries")).join(ap)


@query("a12_retrieval_benchmark", f"WITH {BENCH} SELECT round(avg(h1), 6) AS recall_1, round(avg(h5), 6) AS recall_5, round(avg(h10), 6) AS recall_10, count(*) AS queries, (SELECT round(avg(ap), 6) FROM ap) AS map FROM h")
def a12(spark, d):
    return benchmark(spark, d)


@query("a13_model_comparison", "WITH m AS (SELECT s_nationkey AS model, avg(s_acctbal) AS map FROM supplier GROUP BY 1), b AS (SELECT map AS base FROM m ORDER BY model LIMIT 1) SELECT model, round(map, 4) AS map, round((map - base) / abs(base) * 100, 4) AS improvement, map = max(map) OVER () AS best FROM m, b")
def a13(spark, d):
    m = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("model")).agg(F.avg("s_acctbal").alias("map"))
    w = Window.orderBy("model").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a model
    base = F.first("map").over(w)
    return m.select("model", F.round("map", 4).alias("map"), F.round((F.col("map") - base) / F.abs(base) * 100, 4).alias("improvement"), (F.col("map") == F.max("map").over(w)).alias("best"))


@query("a14_verdict_buckets", f"WITH {VERDICTS}, x AS (SELECT coalesce(contains(a.v, 'KEEP'), false) AS f, coalesce(contains(b.v, 'KEEP'), false) AS s FROM a FULL JOIN b ON a.k = b.k) SELECT CASE WHEN f AND s THEN 'keep_both' WHEN f THEN 'only_first' WHEN s THEN 'only_second' ELSE 'reject' END AS bucket, count(*) AS n FROM x GROUP BY 1")
def a14(spark, d):
    has = lambda c: F.coalesce(F.contains(F.col(c), F.lit("KEEP")), F.lit(False))
    bucket = F.when(has("first") & has("second"), "keep_both").when(has("first"), "only_first").when(has("second"), "only_second").otherwise("reject")
    return verdicts(spark, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("a15_max_over_pairs", f"SELECT a.label AS src, b.label AS tgt, round(max({COS}), 6) AS best FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL")
def a15(spark, d):
    def work(q, r):
        import numpy as np
        import pyarrow as pa

        score = X.products(q, r)[1]
        score[q.ids("vec_id")[:, None] == r.ids("vec_id")[None, :]] = np.nan
        src, tgt = (p.columns["label"].combine_chunks().dictionary_encode(null_encoding="encode") for p in (q, r))
        best = np.full((len(src.dictionary), len(tgt.dictionary)), -np.inf)
        a, b = (np.asarray(x.indices) for x in (src, tgt))
        for j in range(len(tgt.dictionary)):
            np.maximum.at(best[:, j], a, np.fmax.reduce(score[:, b == j], axis=1, initial=-np.inf))
        i, j = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_pydict({"src": src.dictionary.take(pa.array(i)), "tgt": tgt.dictionary.take(pa.array(j)), "best": best[i, j]})

    found = X.compared(*embeddings(spark, d), "embedding", work, "src long, tgt long, best double").groupBy("src", "tgt").agg(F.round(F.max("best"), 6).alias("best"))
    return found.select(F.col("src").cast("int").alias("src"), F.col("tgt").cast("int").alias("tgt"), "best")


TOPICS = f"""{TOKENS_SQL}, c AS (SELECT source, term, count(*) AS n FROM tok JOIN documents USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS k FROM c),
topics AS (SELECT source, count(*) AS size, list(term ORDER BY k) FILTER (WHERE k <= 5) AS reps FROM r GROUP BY source)"""


@query("a16_topic_quality", f"""WITH {TOPICS} SELECT source, round(greatest(0.0, least(1.0, 0.5 + 0.2 + CASE WHEN size >= 30 THEN 0.15 WHEN size >= 15 THEN 0.1 WHEN size >= 8 THEN 0.05 ELSE 0 END - 0.1 * len(list_filter(reps, lambda t: t IN ('the', 'of', 'and'))))), 6)::DOUBLE AS quality FROM topics""")
def a16(spark, d):
    c = tokens(spark, d).join(docs(spark, d).select("doc_id", "source"), "doc_id").groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "term")))
    t = r.groupBy("source").agg(F.count(F.lit(1)).alias("size"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "term")))), lambda x: x["term"]).alias("reps"))
    quality = concepts.topic_quality(F.array_join(F.slice("reps", 1, 3), " "), "reps", "size", ["the", "of", "and"])
    return t.select("source", F.round(quality, 6).alias("quality"))


@query("a17_classification_metrics", """WITH x AS (SELECT quality AS l, CASE WHEN contains(text, '&&&') OR contains(text, ' | ') OR contains(text, '!!') THEN 0 ELSE 1 END AS p FROM documents JOIN labels USING (doc_id)),
l AS (SELECT l, count(*) AS s, count(*) FILTER (WHERE l = p) AS tp FROM x GROUP BY l), pr AS (SELECT p AS l, count(*) AS said FROM x GROUP BY p), m AS (SELECT l.*, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS pc, tp / s AS rc FROM l LEFT JOIN pr USING (l))
SELECT round(sum(tp) / sum(s), 6)::DOUBLE AS accuracy, round(sum(pc * s) / sum(s), 6)::DOUBLE AS precision, round(sum(rc * s) / sum(s), 6)::DOUBLE AS recall, round(sum(CASE WHEN pc + rc > 0 THEN 2 * pc * rc / (pc + rc) ELSE 0 END * s) / sum(s), 6)::DOUBLE AS f1, sum(s)::BIGINT AS n FROM m""")
def a17(spark, d):
    junk = F.contains("text", F.lit("&&&")) | F.contains("text", F.lit(" | ")) | F.contains("text", F.lit("!!"))
    x = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("quality", F.when(junk, 0).otherwise(1).alias("p"))
    m = metrics.classification(x, "quality", "p")
    return m.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "n")


@query("a18_batch_outcomes", "SELECT event_type, count(*) AS total, count(TRY_CAST(json_extract_string(props, '$.k') AS INT)) AS succeeded, count(*) - count(TRY_CAST(json_extract_string(props, '$.k') AS INT)) AS failed FROM events GROUP BY event_type")
def a18(spark, d):
    value = F.expr("try_cast(get_json_object(props, '$.k') as int)")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count(value).alias("succeeded"), (F.count(F.lit(1)) - F.count(value)).alias("failed"))


@query("a19_topic_summary", "SELECT label AS topic, count(*) AS size, array_to_string(list_sort(list(vec_id))[1:3], ',') AS representatives FROM embeddings GROUP BY label")
def a19(spark, d):
    from textloom.operators.cluster import topic_summary

    x = topic_summary(table(spark, d, "embeddings").select(F.col("label").alias("topic"), "vec_id"), "topic", "vec_id")
    return x.select("topic", "size", F.array_join(F.transform("representatives", lambda v: v.cast("string")), ",").alias("representatives"))


@query("a20_backfill_counters", f"WITH {DIMS}, x AS (SELECT source, doc_id, list_filter(['with', 'for', 'und', 'pour', 'para'], lambda k: contains(lower(text), k)) AS added FROM documents) SELECT count(DISTINCT source) AS books, count(*) FILTER (WHERE len(added) > 0) AS chapters, sum(len(added))::BIGINT AS terms FROM x")
def a20(spark, d):
    added = F.filter(F.array(*[F.lit(k) for k in ("with", "for", "und", "pour", "para")]), lambda k: F.contains(F.lower(F.col("text")), k))
    x = docs(spark, d).select("source", F.size(added).alias("n"))
    return x.agg(F.count_distinct("source").alias("books"), F.count_if(F.col("n") > 0).alias("chapters"), F.sum("n").alias("terms"))


@query("a21_last_wins_distinct", "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price, count(*) AS n FROM orders GROUP BY o_custkey")
def a21(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("price"), F.count(F.lit(1)).alias("n"))


@query("a22_cube_and_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a22(spark, d):
    x = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))
    return x
