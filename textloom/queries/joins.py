"""J: joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import classify, concepts, documents, grams, ranking, training
from textloom.operators import vectors as X
from textloom.queries.registry import TOKENS_SQL, docs, query, split, table, tokens

ALIAS_SQL = """src AS (SELECT p_name AS term, 'concept' AS kind, min(p_partkey) AS pos FROM part GROUP BY 1 UNION ALL SELECT p_type, 'keyword', min(p_partkey) FROM part GROUP BY 1),
low AS (SELECT lower(trim(term)) AS t, kind, pos FROM src),
variants AS (SELECT DISTINCT unnest([t, CASE WHEN contains(t, ' ') THEN replace(t, ' ', '-') END, CASE WHEN contains(t, ' ') THEN replace(t, ' ', '_') END, CASE WHEN contains(t, ' ') THEN replace(t, ' ', '') END,
 CASE WHEN contains(t, '-') THEN replace(t, '-', ' ') END, CASE WHEN contains(t, '-') THEN replace(t, '-', '_') END, CASE WHEN contains(t, '_') THEN replace(t, '_', ' ') END, CASE WHEN contains(t, '_') THEN replace(t, '_', '-') END]) AS alias,
 regexp_replace(regexp_replace(t, '[\\s-]+', '_', 'g'), '[^\\w]', '', 'g') AS canonical_term, kind AS classification, pos FROM low),
aliases AS (SELECT alias, canonical_term, classification FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY classification = 'concept' DESC, CASE WHEN classification = 'concept' THEN -pos ELSE pos END) AS n FROM variants WHERE alias IS NOT NULL) WHERE n = 1)"""


def term_list(spark, d):
    part = table(spark, d, "part")
    rows = [part.groupBy(F.col(c).alias("term")).agg(F.min("p_partkey").alias("pos")).withColumn("kind", F.lit(k)) for c, k in (("p_name", "concept"), ("p_type", "keyword"))]
    return rows[0].unionByName(rows[1])


def alias_dim(spark, d):
    return classify.build_aliases(term_list(spark, d))


@query("j01_alias_lookup", f"""WITH {ALIAS_SQL}, asked AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN ' ' || replace(p_type, ' ', '-') ELSE p_brand END AS term FROM part)
SELECT p_partkey, a.term, canonical_term, classification, CASE WHEN alias IS NOT NULL THEN 1.0::DOUBLE END AS confidence FROM asked a LEFT JOIN aliases ON lower(trim(a.term)) = alias""")
def j01(spark, d):
    k = F.col("p_partkey") % 3
    asked = table(spark, d, "part").select("p_partkey", F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit("-")))).otherwise(F.col("p_brand")).alias("term"))
    found = classify.lookup_aliases(asked, "term", alias_dim(spark, d))
    return found.withColumn("confidence", F.when(F.col("classification").isNotNull(), 1.0))


RAW = f"raw AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {split('text')} AS w FROM documents))"


def raw_words(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.split_words("text")).alias("pos", "term"))


@query("j02_ensemble_merge", f"""WITH {RAW}, a AS (SELECT doc_id, lower(term) AS k, arg_max(term, pos) AS term, arg_max(pos / 100.0, pos) AS score FROM raw WHERE length(term) <= 7 GROUP BY ALL),
b AS (SELECT doc_id, lower(term) AS k, arg_min(term, pos) AS term FROM raw WHERE length(term) >= 4 GROUP BY ALL)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.term, b.term) AS term, coalesce(score, 0.5)::DOUBLE AS score, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'yake' ELSE 'textrank' END AS source
FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.k = b.k""")
def j02(spark, d):
    return concepts.merge_words(docs(spark, d), longest=7, shortest=4)


@query("j03_score_reattachment", f"""WITH {TOKENS_SQL}, s AS (SELECT term, count(*)::DOUBLE AS score FROM tok GROUP BY term HAVING count(*) > 20), t AS (SELECT DISTINCT doc_id, term FROM tok)
SELECT doc_id, t.term, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0) DESC, t.term) AS place FROM t LEFT JOIN s USING (term)""")
def j03(spark, d):
    w = tokens(spark, d)
    s = w.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("score")).where("score > 20")
    x = w.select("doc_id", "term").distinct().join(s, "term", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")))


STAGES = f"""{TOKENS_SQL}, gen AS (SELECT doc_id, term, min(pos) AS pos, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM tok) GROUP BY ALL), val AS (SELECT term FROM tok GROUP BY term HAVING count(*) >= 3),
ranked AS (SELECT doc_id, term, ((1 - pos / n * 0.3) + least(length(term) / 10, 1.0)) / 2 AS score FROM gen WHERE length(term) > 3)"""


def assembled(spark, d):
    w = docs(spark, d).select("doc_id", T.words("text").alias("w")).select("doc_id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "term"))
    gen = w.groupBy("doc_id", "term").agg(F.min("pos").alias("pos"), F.first("n").alias("n"))
    val = w.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("term", F.lit(True).alias("_v"))
    ranked = F.when(F.length("term") > 3, ranking.fallback_score("pos", F.col("n"), "term"))  # the ranker answers for longer terms only
    x = gen.withColumn("ranker_score", ranked).join(val, "term", "left")
    return x.select("doc_id", "term", F.lit(0.8).alias("generator_score"), F.coalesce("_v", F.lit(False)).alias("validator_approved"), F.coalesce("ranker_score", F.lit(0.0)).alias("ranker_score"))


@query("j04_stage_assembly", f"WITH {STAGES} SELECT doc_id, term, 0.8::DOUBLE AS generator_score, term IN (SELECT term FROM val) AS validator_approved, coalesce(score, 0)::DOUBLE AS ranker_score FROM gen LEFT JOIN ranked USING (doc_id, term)")
def j04(spark, d):
    return assembled(spark, d)


CHAPTERS = "ch AS (SELECT n_nationkey AS idx, n_nationkey * 2 + 1 AS start_page, n_nationkey * 2 + 4 AS end_page FROM nation)"


def page_join(spark, d, last):
    ch = table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), (F.col("n_nationkey") * 2 + 1).alias("start_page"), (F.col("n_nationkey") * 2 + 4).alias("end_page"))
    points = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("page"))
    return documents.in_intervals(points, ch, "page", "start_page", "end_page", "idx", last, cell=10).select("p_partkey", F.col("page").cast("long").alias("page"), "idx")


@query("j05_range_join_last", f"WITH {CHAPTERS} SELECT p_partkey, p_size::BIGINT AS page, max(idx) AS idx FROM part JOIN ch ON p_size BETWEEN start_page AND end_page GROUP BY ALL")
def j05(spark, d):
    return page_join(spark, d, True)


@query("j06_interval_join_first", f"WITH {CHAPTERS} SELECT p_partkey, p_size::BIGINT AS page, min(idx) AS idx FROM part JOIN ch ON p_size BETWEEN start_page AND end_page GROUP BY ALL")
def j06(spark, d):
    return page_join(spark, d, False)


REFERRED = """c AS (SELECT 'b' || (p_partkey % 10) AS book, p_partkey AS chapter_number, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_type ELSE p_brand END AS text,
 'b' || ((p_partkey * 7 % 199 + 1) % 10) AS rb, p_partkey * 7 % 199 + 1 AS rc, p_size / 50 AS score FROM part)"""


def chapters(spark, d):
    to = F.col("p_partkey") * 7 % 199 + 1
    summary = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    ref = F.struct(F.concat(F.lit("b"), (to % 10).cast("string")).alias("book"), to.alias("chapter"), F.lit("").alias("title"), (F.col("p_size") / 50).alias("score"))
    return table(spark, d, "part").select(F.concat(F.lit("b"), (F.col("p_partkey") % 10).cast("string")).alias("book"), F.col("p_partkey").alias("chapter_number"), F.col("p_name").alias("title"), summary.alias("summary"), F.array(ref).alias("similar_chapters"))


@query("j07_similar_chapter_join", f"WITH {REFERRED} SELECT a.text AS anchor, b.text AS positive, a.score FROM c a JOIN c b ON a.rb = b.book AND a.rc = b.chapter_number WHERE a.score >= 0.7 AND length(a.text) >= 10 AND length(b.text) >= 10")
def j07(spark, d):
    return training.similar_pairs(chapters(spark, d))


DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
COS = f"{DOT} / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query("j08_pairwise_similarity", f"SELECT a.vec_id AS i, b.vec_id AS j, round({COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id")
def j08(spark, d):
    e = table(spark, d, "embeddings")
    return X.all_pairs(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", lambda dot, cos: [X.rounded(cos)], "score")  # the stated queries


#: A taxonomy made for the generated prose: frequent words, and phrases of them.
DOMAINS = {
    "english": {"primary": ["the", "this", "that"], "domain": ["with", "for", "was", "of the", "on the"], "min": 2, "boost": 0.1, "penalty": -0.2, "tier": "core"},
    "german": {"primary": ["der", "die"], "domain": ["und", "nicht", "von der"], "min": 1, "boost": 0.15, "penalty": 0.0, "tier": None},
    "french": {"primary": ["le", "la"], "domain": ["pour", "dans", "de la"], "min": 1, "boost": 0.2, "penalty": -0.1, "tier": "extra"},
    "spanish": {"primary": ["el", "los"], "domain": ["para", "con", "de la"], "min": 3, "boost": 0.1, "penalty": -0.1, "tier": "extra"},
}


def keyword_dim(spark):
    rows = [(n, k, kind) for n, x in DOMAINS.items() for kind in ("primary", "domain") for k in x[kind]]
    return spark.createDataFrame(rows, "domain string, keyword string, kind string")


def domain_dim(spark):
    return spark.createDataFrame([(n, x["min"], x["boost"], x["penalty"], x["tier"]) for n, x in DOMAINS.items()], "domain string, min_matches int, boost double, penalty double, tier string")


_K = ", ".join(f"('{n}', '{k}', '{kind}')" for n, x in DOMAINS.items() for kind in ("primary", "domain") for k in x[kind])
_D = ", ".join(f"('{n}', {x['min']}, {x['boost']}, {x['penalty']}, {repr(x['tier']) if x['tier'] else 'NULL'})" for n, x in DOMAINS.items())
DIMS = f"kw(domain, keyword, kind) AS (VALUES {_K}), dom(domain, min_matches, boost, penalty, tier) AS (VALUES {_D})"


def hits_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""{DIMS}, txt AS (SELECT {key} AS k, lower({text}) AS t, list_distinct(regexp_extract_all(lower({text}), '\\w+')) AS w FROM {source}),
hits AS (SELECT DISTINCT k, domain, keyword, kind FROM txt, kw WHERE list_contains(w, keyword) OR (kind = 'domain' AND contains(keyword, ' ') AND contains(t, keyword)))"""


def hits(spark, d):
    return concepts.taxonomy_hits(docs(spark, d), keyword_dim(spark))


@query("j09_taxonomy_match", f"WITH {hits_sql()} SELECT k AS doc_id, domain, keyword, kind FROM hits")
def j09(spark, d):
    return hits(spark, d)


@query("j10_positional_zip", "SELECT p_partkey, unnest(range(2)) AS pos, unnest(string_split(p_name, ' ')[1:2]) AS a, unnest(string_split(p_type, ' ')[1:2]) AS b FROM part WHERE contains(p_name, ' ') AND contains(p_type, ' ')")
def j10(spark, d):
    x = table(spark, d, "part").where("contains(p_name, ' ') and contains(p_type, ' ')")
    zipped = F.posexplode(F.arrays_zip(F.slice(F.split("p_name", " "), 1, 2).alias("a"), F.slice(F.split("p_type", " "), 1, 2).alias("b")))
    return x.select("p_partkey", zipped.alias("pos", "z")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "z.a", "z.b")


KEEP = ["the", "for", "with", "from", "if", "as"]
KEEP_SQL = ", ".join(f"'{k}'" for k in KEEP)
W40 = f"list_distinct({split('lower(text)')})"


@query("j11_log_backfill", f"""WITH log AS (SELECT doc_id, source, {W40} AS raw FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(raw, lambda x: x IN ({KEEP_SQL}))), ' ') AS back FROM log WHERE list_has_any(raw, [{KEEP_SQL}])""")
def j11(spark, d):
    from textloom.operators.filters import noise_reason

    raw = F.array_distinct(T.split_words(F.lower(F.col("text"))))
    log = docs(spark, d).select("doc_id", raw.alias("raw")).withColumn("post", F.filter("raw", lambda w: noise_reason(w).isNull() & ~w.isin(KEEP)))
    back = F.array_intersect(F.array_except("raw", "post"), F.array(*[F.lit(k) for k in KEEP]))
    return log.select("doc_id", F.array_join(F.array_sort(back), " ").alias("back")).where("back != ''")


@query("j12_index_backfill", """WITH have AS (SELECT DISTINCT l_partkey % 50 AS chapter, l_suppkey AS term FROM lineitem WHERE l_quantity > 25), want AS (SELECT DISTINCT l_partkey % 50 AS chapter, l_suppkey AS term FROM lineitem),
valid AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
SELECT chapter, count(*) AS n, min(term) AS first_term FROM want WHERE term IN (SELECT s_suppkey FROM valid) AND (chapter, term) NOT IN (SELECT (chapter, term) FROM have) GROUP BY chapter""")
def j12(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("chapter"), F.col("l_suppkey").alias("term"), "l_quantity")
    valid = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("term"))
    new = li.select("chapter", "term").distinct().join(valid, "term", "left_semi").join(li.where("l_quantity > 25"), ["chapter", "term"], "left_anti")
    return new.groupBy("chapter").agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("first_term"))


VERDICTS = """a AS (SELECT lower('T' || o_custkey) AS k, max(CASE WHEN o_totalprice > 100000 THEN 'KEEP' ELSE 'REJECT' END) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT lower('t' || o_custkey) AS k, max(CASE WHEN o_totalprice > 150000 THEN 'KEEP: yes' ELSE 'REJECT' END) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"""


def verdicts(spark, d):
    o = table(spark, d, "orders")
    side = lambda s, least, word, v: o.where(F.col("o_orderstatus") == s).groupBy(F.lower(F.concat(F.lit(word), F.col("o_custkey").cast("string"))).alias("term")).agg(F.max(F.when(F.col("o_totalprice") > least, v[0]).otherwise("REJECT")).alias(v[1]))
    return side("F", 100000, "T", ("KEEP", "first")).join(side("O", 150000, "t", ("KEEP: yes", "second")), "term", "full_outer")


@query("j13_verdict_full_outer", f"WITH {VERDICTS} SELECT coalesce(a.k, b.k) AS term, a.v AS first, b.v AS second FROM a FULL JOIN b ON a.k = b.k")
def j13(spark, d):
    return verdicts(spark, d)


@query("j14_intra_concept_pairs", """WITH s AS (SELECT p_brand AS concept, p_partkey AS pos, p_name || ' ' || p_partkey AS code FROM part),
firsts AS (SELECT concept, arg_min(code, md5(pos || ':0')) AS negative FROM s GROUP BY concept),
ring AS (SELECT concept, coalesce(lead(concept) OVER w, first_value(concept) OVER w) AS o FROM firsts WINDOW w AS (ORDER BY md5(concept || ':0') ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT a.concept, a.pos AS i, b.pos AS j, a.code AS anchor, b.code AS positive, f.negative FROM s a JOIN s b ON a.pos % 100 = 0 AND a.concept = b.concept AND a.pos < b.pos JOIN ring r ON r.concept = a.concept JOIN firsts f ON f.concept = r.o WHERE r.o <> a.concept""")
def j14(spark, d):
    s = table(spark, d, "part").select(F.col("p_brand").alias("concept"), F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("code"))
    return training.code_triplets(s, anchors=F.col("pos") % 100 == 0)  # the stated queries, against all snippets of their concepts


@query("j16_coverage", f"WITH {TOKENS_SQL}, keep AS (SELECT DISTINCT lower(unnest(string_split(p_name || ' the for with', ' '))) AS term FROM part) SELECT count(*) AS kept, count(*) FILTER (WHERE term IN (SELECT term FROM tok)) AS found, round(100.0 * count(*) FILTER (WHERE term IN (SELECT term FROM tok)) / count(*), 6) AS percent FROM keep")
def j16(spark, d):
    keep = table(spark, d, "part").select(F.explode(F.split(F.lower(F.concat(F.col("p_name"), F.lit(" the for with"))), " ")).alias("term")).distinct()
    have = tokens(spark, d).select("term").distinct().withColumn("hit", F.lit(1))
    return keep.join(have, "term", "left").agg(F.count(F.lit(1)).alias("kept"), F.count("hit").alias("found"), F.round(100.0 * F.count("hit") / F.count(F.lit(1)), 6).alias("percent"))


@query("j17_prefix_match", """WITH books AS (SELECT DISTINCT p_type AS book FROM part), files AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'x ' || p_type || ' 2nd' END AS f FROM part),
exact AS (SELECT book, f FROM books JOIN files ON f = book), rest AS (SELECT book FROM books WHERE book NOT IN (SELECT book FROM exact))
SELECT book, f AS file FROM exact UNION ALL SELECT book, min(f) FROM rest JOIN files ON contains(f, substr(book, 1, 20)) GROUP BY book""")
def j17(spark, d):
    part = table(spark, d, "part")
    books = part.select(F.col("p_type").alias("book")).distinct()
    files = part.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lit("x "), F.col("p_type"), F.lit(" 2nd"))).alias("file")).distinct()
    exact = books.join(files, F.col("book") == F.col("file"))
    rest = books.join(exact.select("book"), "book", "left_anti").withColumn("start", F.substring("book", 1, 20))
    first = grams.containing(rest, files, "start", "file").groupBy("start").agg(F.min("file").alias("file"))
    return exact.unionByName(rest.join(first, "start").select("book", "file"))


NAMED = "CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_brand ELSE p_brand || p_name END"


@query("j17_similar_names", f"WITH a AS (SELECT DISTINCT {NAMED} AS a FROM part), b AS (SELECT DISTINCT p_name || ' ' || p_brand AS b FROM part) SELECT a, b, levenshtein(a, b)::INT AS distance FROM a JOIN b ON levenshtein(a, b) <= 2")
def j17_similar(spark, d):
    part = table(spark, d, "part")
    return grams.similar(part.select(F.expr(NAMED).alias("a")), part.select(F.concat_ws(" ", "p_name", "p_brand").alias("b")), "a", "b", 2)


@query("j18_seen_title_resolution", """WITH c AS (SELECT p_partkey AS pos, p_type AS title FROM part), r AS (SELECT a.pos, min(b.pos) AS first_pos, count(*) AS n FROM c a JOIN c b ON a.title = b.title AND b.pos < a.pos GROUP BY a.pos)
SELECT c.pos, coalesce(first_pos, c.pos) AS target, coalesce(n, 0) AS seen FROM c LEFT JOIN r ON r.pos = c.pos""")
def j18(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_type").alias("title"))
    before = Window.partitionBy("title").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # a window instead of the self-join
    return c.select("pos", F.coalesce(F.min("pos").over(before), "pos").alias("target"), F.count("pos").over(before).alias("seen"))


@query("j19_keyword_list_domain", f"""WITH conv AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id), {hits_sql('conv', 'conv_id', 't')},
n AS (SELECT k, domain, count(*) FILTER (WHERE kind = 'primary') AS np, count(*) FILTER (WHERE kind = 'domain') AS nd FROM hits GROUP BY ALL),
s AS (SELECT k, domain, least(1.0, greatest(0.0, 0.5 + CASE WHEN nd > 0 THEN nd * boost + np * 0.05 WHEN np > 0 THEN penalty ELSE 0 END))::DOUBLE AS score FROM n JOIN dom USING (domain) WHERE nd >= min_matches)
SELECT k AS conv_id, domain, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, domain) AS r FROM s) WHERE r = 1""")
def j19(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    found = concepts.taxonomy_hits(c, keyword_dim(spark), "conv_id")
    scores = concepts.domain_scores(found, domain_dim(spark), "conv_id").withColumn("score", F.round("score", 9))
    return concepts.primary_domain(scores, "conv_id").withColumn("score", F.round("score", 6))
