"""P: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom import vocabulary as V
from textloom.functions import text as T
from textloom.operators import filters as P
from textloom.queries.registry import TERMS_SQL, TOKENS_SQL, docs, literals, query, split, table, terms, tokens

L = literals
LOW = "lower(trim(term))"


def noise_sql(c: str) -> str:
    low = f"lower(trim({c}))"
    return f"""CASE WHEN {c} IS NULL OR {c} = '' OR length({low}) = 1 THEN 'single_char' WHEN regexp_full_match({low}, '\\d+') THEN 'pure_number'
 WHEN regexp_full_match({low}, '[''`]?(ll|nt|n''t|s|ve|d|re|m)') THEN 'contraction' WHEN regexp_full_match({low}, '_+\\w*') THEN 'code_artifact'
 WHEN {low} IN ({L(V.WATERMARKS + V.MORE_WATERMARKS)}) THEN 'watermark' WHEN {low} IN ({L(V.URL_FRAGMENTS)}) THEN 'url_fragment'
 WHEN {low} IN ({L(V.GENERIC_FILLER)}) THEN 'generic_filler' WHEN {low} IN ({L(V.CODE_ARTIFACTS)}) THEN 'code_artifact'
 WHEN {low} IN ({L(V.PAGE_MARKERS)}) THEN 'page_marker' END"""


def heuristic_sql(c: str) -> str:
    low = f"lower(trim({c}))"
    listed = " ".join(f"WHEN {low} IN ({L(v)}) THEN 'noise_{k}'" for k, v in V.NOISE_CATEGORIES.items())
    return f"""CASE WHEN {low} = '' THEN 'noise_empty' WHEN length({low}) = 1 THEN 'noise_single_char' WHEN regexp_full_match({low}, '[\\d.]+') THEN 'noise_pure_number'
 WHEN regexp_matches({low}, '^_+\\w+') THEN 'noise_underscore_prefix' WHEN regexp_full_match({low}, '(ll|nt|ve|re|s|d|m)') THEN 'noise_broken_contraction' {listed} END"""


@query("p01_noise_predicate", f"WITH {TERMS_SQL} SELECT term, {noise_sql('term')} AS reason, {noise_sql('term')} IS NOT NULL AS is_rejected FROM terms")
def p01(spark, d):
    return terms(spark, d).select("term", P.noise_reason("term").alias("reason"), P.noise_reason("term").isNotNull().alias("is_rejected"))


@query("p02_noise_split", f"""WITH {TOKENS_SQL}, flagged AS (SELECT *, {noise_sql('term')} AS reason FROM tok)
SELECT doc_id, coalesce(array_to_string(list(term ORDER BY pos) FILTER (WHERE reason IS NULL), ' '), '') AS accepted, coalesce(array_to_string(list(term ORDER BY pos) FILTER (WHERE reason IS NOT NULL), ' '), '') AS rejected,
count(DISTINCT term) FILTER (WHERE reason IS NOT NULL) AS n_reasons FROM flagged GROUP BY doc_id""")
def p02(spark, d):
    x = P.split_noise(tokens(spark, d), "doc_id", "term", "pos")
    return x.select("doc_id", F.array_join("accepted", " ").alias("accepted"), F.array_join("rejected", " ").alias("rejected"), F.size("reasons").cast("long").alias("n_reasons"))


@query("p03_heuristic_predicate", f"WITH {TERMS_SQL} SELECT term, {heuristic_sql('term')} AS reason FROM terms")
def p03(spark, d):
    return terms(spark, d).select("term", P.heuristic_reason("term").alias("reason"))


DICTIONARY = "SELECT lower(w) AS term FROM (SELECT unnest(string_split(p_type || ' ' || p_name, ' ')) AS w FROM part) UNION SELECT term FROM tok GROUP BY term HAVING count(*) >= 50"


@query("p04_dictionary_predicate", f"WITH {TERMS_SQL}, dict AS ({DICTIONARY}) SELECT term, lower(trim(term)) IN (SELECT term FROM dict) AS approved FROM terms")
def p04(spark, d):
    part = table(spark, d, "part").select(F.explode(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).alias("term"))
    frequent = tokens(spark, d).groupBy("term").count().where("count >= 50").select("term")
    known = part.unionByName(frequent)
    all_terms = terms(spark, d)
    yes = P.dictionary(all_terms, "term", known).withColumn("approved", F.lit(True))
    return yes.unionByName(P.dictionary(all_terms, "term", known, keep=False).withColumn("approved", F.lit(False)))


@query("p05_text_noise_removal", f"SELECT doc_id, array_to_string(list_filter({split('text')}, lambda t: ({noise_sql('t')}) IS NULL), ' ') AS clean FROM documents")
def p05(spark, d):
    return docs(spark, d).select("doc_id", P.clean_text("text").alias("clean"))


PHRASES = f"{TERMS_SQL}, phrases AS (SELECT a.term || ' ' || b.term AS term FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 UNION SELECT term FROM terms)"


def phrases(spark, d):
    pairs = docs(spark, d).select(T.words("text").alias("w")).select(F.explode(T.ngrams("w", 2)).alias("term"))
    return pairs.unionByName(terms(spark, d)).distinct()


@query("p06_phrase_noise", f"WITH {PHRASES} SELECT term, len(list_filter({split('term')}, lambda t: ({noise_sql('t')}) IS NOT NULL)) = 0 AS clean FROM phrases")
def p06(spark, d):
    return phrases(spark, d).select("term", P.clean_phrase("term").alias("clean"))


@query("p07_concept_pattern", f"""WITH {PHRASES} SELECT term, CASE WHEN length(term) < 2 THEN 'noise_term' WHEN len({split('term')}) < 2 THEN 'single_word_not_concept'
 WHEN regexp_matches(term, '(?i)copyright') OR contains(term, '©') OR regexp_matches(term, '^[A-Z][a-z]+\\s+[A-Z]\\.\\s+[A-Z][a-z]+$') OR regexp_matches(term, '(?i)all\\s+rights\\s+reserved')
 OR list_has_any({split('lower(term)')}, [{L(V.KNOWN_AUTHORS)}]) THEN 'author_pattern' WHEN lower(term) IN ({L(V.CONCEPT_NOISE)}) THEN 'noise_term' END AS reason FROM phrases""")
def p07(spark, d):
    return phrases(spark, d).select("term", P.concept_reason("term").alias("reason"))


@query("p08_generic_filter", f"WITH {TERMS_SQL} SELECT term, CASE WHEN length({LOW}) < 2 THEN 'too_short' WHEN {LOW} IN ({L(V.GENERIC_TERMS)}) THEN 'too_generic' END AS reason FROM terms")
def p08(spark, d):
    return terms(spark, d).select("term", P.generic_reason("term").alias("reason"))


SIMPLE = f"list_filter({split('lower(text)')}, lambda w: length(w) > 2 AND w NOT IN ({L(V.SIMPLE_STOPWORDS)}))"
FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("p09_state_generic_filter", f"""WITH q AS (SELECT conv_id, turn, {FIRST.format(SIMPLE)} AS t FROM conversations), s AS (SELECT conv_id, turn, t[1:10] AS twice FROM q)
SELECT conv_id, turn, array_to_string(list_filter(twice, lambda w: w NOT IN ({L(V.GRAPH_GENERIC_TERMS)})), ' ') AS validated, array_to_string(list_filter(twice, lambda w: w IN ({L(V.GRAPH_GENERIC_TERMS)})), ' ') AS rejected FROM s""")
def p09(spark, d):
    q = table(spark, d, "conversations").select("conv_id", "turn", T.simple_terms("text").alias("t"))
    x = q.select("conv_id", "turn", F.slice("t", 1, 5).alias("g"), F.slice("t", 6, 5).alias("r"))
    yes, no = P.graph_split("g", "r")
    return x.select("conv_id", "turn", F.array_join(yes, " ").alias("validated"), F.array_join(no, " ").alias("rejected"))


@query("p10_technical_flag", f"WITH {TERMS_SQL} SELECT term, {' OR '.join(f'contains(lower(term), {chr(39)}{p}{chr(39)})' for p in V.TECHNICAL_PARTS)} AS is_technical FROM terms")
def p10(spark, d):
    return terms(spark, d).select("term", T.is_technical("term").alias("is_technical"))


CODE_WORDS = ["function", "class", "method", "api", "code", "python", "with", "for"]


def code_sql(c: str) -> str:
    return f"(list_has_any({split(f'lower({c})')}, [{L(CODE_WORDS)}]) OR {' OR '.join(f'contains(lower({c}), {L([p])})' for p in V.CODE_PARTS)})"


@query("p11_code_query", f"SELECT conv_id, turn, {code_sql('text')} AS is_code FROM conversations")
def p11(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_code_query("text", CODE_WORDS).alias("is_code"))


def domain_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({c}), {L([k])})' for k in keys)} THEN '{name}'" for name, keys in V.TITLE_DOMAINS.items()) + " ELSE 'general' END"


@query("p12_title_domain", f"SELECT p_partkey, {domain_sql('p_name')} AS domain, {domain_sql('p_name')} IN ('ai-ml', 'general') AS matches FROM part")
def p12(spark, d):
    return table(spark, d, "part").select("p_partkey", T.title_domain("p_name").alias("domain"), P.matches_domain("p_name", "ai-ml").alias("matches"))


@query("p13_domain_and_threshold", f"SELECT p_partkey, p_retailprice / 2000 AS score FROM part WHERE {domain_sql('p_name')} IN ('systems', 'general') AND p_retailprice / 2000 >= 0.3")
def p13(spark, d):
    x = table(spark, d, "part").withColumn("score", F.col("p_retailprice") / 2000)
    return x.where(P.matches_domain("p_name", "systems")).where("score >= 0.3").select("p_partkey", "score")


@query("p14_confidence", "SELECT l_orderkey, l_linenumber, 1 - least(l_discount * 12, 1.0) AS confidence FROM lineitem WHERE 1 - least(l_discount * 12, 1.0) >= 0.3")
def p14(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.confidence(F.col("l_discount") * 12).alias("confidence"))
    return x.where("confidence >= 0.3")


@query("p15_domain_filter_after_aggregation", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL HAVING c_mktsegment = 'BUILDING'")
def p15(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n")).where("c_mktsegment = 'BUILDING'")


@query("p16_validation_quarantine", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_totalprice >= 50000 THEN 'price' END, CASE WHEN NOT length(trim(o_orderpriority)) > 5 THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS broken FROM orders
WHERE NOT (o_totalprice >= 50000 AND length(trim(o_orderpriority)) > 5)""")
def p16(spark, d):
    rules = {"price": F.col("o_totalprice") >= 50000, "priority": F.length(F.trim("o_orderpriority")) > 5}
    _, bad = P.quarantine(table(spark, d, "orders"), rules)
    return bad.select("o_orderkey", F.array_join("broken", ",").alias("broken"))


TOPIC_NOISE = ["the", "of", "and"]


@query("p17_topic_noise", f"""WITH {TOKENS_SQL}, c AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS k FROM c)
SELECT doc_id, array_to_string(list(term ORDER BY k), ' ') AS name FROM r WHERE k <= 3 AND term NOT IN ({L(TOPIC_NOISE)}) GROUP BY doc_id HAVING count(*) >= 2""")
def p17(spark, d):
    from textloom.operators.ranking import top_by

    counts = tokens(spark, d).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    top = top_by(counts, ["doc_id"], [F.desc("n"), "term"], 3, "k").where(~F.col("term").isin(TOPIC_NOISE))
    names = top.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("t"))
    return names.where("size(t) >= 2").select("doc_id", F.array_join("t", " ").alias("name"))
