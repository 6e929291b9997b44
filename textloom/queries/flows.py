"""S: sources and sinks; O: composite dataflows; streaming over events with a batch twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom import vocabulary as V
from textloom.functions import text as T
from textloom.operators import classify, documents, lexical
from textloom.plans import pipelines, state_graph
from textloom.queries.aggregates import QUALITY_SQL, SCORES
from textloom.queries.filters import heuristic_sql, noise_sql
from textloom.queries.joins import ALIAS_SQL, alias_dim, domain_dim, keyword_dim
from textloom.queries.registry import BM25, TERMS_SQL, TOKENS_SQL, docs, literals, query, table, terms, tokens
from textloom.queries.vectors import COS, discovered, labelled
from textloom.queries.windows import STOP
from textloom.sources import files, http, services
from textloom.sources.scratch import materialize, scratch_path
from textloom.streaming import events


def written(spark, text: str) -> str:
    """A one-file folder with the text."""
    path = scratch_path(spark, "text")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


@query("s01_alias_file", f"WITH {ALIAS_SQL} SELECT alias, canonical_term, classification FROM aliases")
def s01(spark, d):
    path = scratch_path(spark, "aliases")
    entry = F.struct(F.col("alias").alias("key"), F.struct("canonical_term", "classification").alias("value"))
    dim = alias_dim(spark, d).unionByName(spark.createDataFrame([("_metadata", None, "none")], "alias string, canonical_term string, classification string"))
    # a dimension: one object a hash group, as a large map is written in parts
    parts = dim.groupBy(F.pmod(F.crc32(F.col("alias").cast("binary")), F.lit(8))).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    parts.select("value").repartition(8).write.option("maxRecordsPerFile", 1).text(path)
    return files.alias_file(spark, path)


@query("s02_dictionary_file", "SELECT lower(p_brand) AS term, 'keyword' AS kind FROM part UNION SELECT lower(p_type), 'concept' FROM part")
def s02(spark, d):
    path = scratch_path(spark, "dictionary")
    part = table(spark, d, "part")
    part.agg(F.collect_set("p_brand").alias("keywords"), F.collect_set(F.concat(F.lit(" "), "p_type")).alias("concepts")).write.json(path)
    return files.dictionary_file(spark, path)


NOISE_OF = {"brands": "p_brand", "names": "p_name", "types": "p_type"}


@query("s03_noise_file", " UNION ALL ".join(f"SELECT DISTINCT lower(trim({c})) AS term, '{k}' AS category, {i + 1}::BIGINT AS priority FROM part" for i, (k, c) in enumerate(NOISE_OF.items())))
def s03(spark, d):
    # a dimension: the lists of one file, in the order of its categories
    part = table(spark, d, "part")
    lists = part.agg(*[F.sort_array(F.collect_set(c)).alias(k) for k, c in NOISE_OF.items()])
    parts = [F.concat(F.lit(f"{k}:\n  - "), F.array_join(k, "\n  - ")) for k in NOISE_OF]
    path = scratch_path(spark, "noise")
    lists.select(F.concat_ws("\n", F.lit("# noise"), *parts)).write.text(path)
    return files.noise_file(spark, path)


@query("s04_stopword_file", f"WITH {TOKENS_SQL} SELECT DISTINCT lower(p_name) AS term FROM part UNION SELECT term FROM (SELECT term, count(*) AS n FROM tok GROUP BY term ORDER BY n DESC, term LIMIT 50)")
def s04(spark, d):
    # the words that the documents have most often, and names of parts
    often = tokens(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(50)
    names = table(spark, d, "part").agg(F.collect_set("p_name").alias("names"))
    lists = often.agg(F.collect_list("term").alias("common")).join(names)  # one row each
    path = scratch_path(spark, "stopwords")
    lists.select(F.to_json(F.struct("common", "names"))).write.text(path)
    return files.stopword_file(spark, path)


TAXONOMY_SQL = """tx AS (SELECT p_brand AS domain, lower(p_name) AS keyword, 'primary' AS kind FROM part WHERE p_size <= 10 UNION SELECT p_brand, lower(p_type), 'domain' FROM part WHERE p_size > 10),
td AS (SELECT p_brand AS domain, max(p_size)::INT AS min_matches, round(min(p_retailprice) / 10000, 6) AS boost, -0.1 AS penalty, CASE WHEN count(*) > 50 THEN min(p_type) END AS tier FROM part GROUP BY 1)"""


def taxonomy(spark, d):
    """(domain, keyword, kind) and (domain, min_matches, boost, penalty, tier) of a file whose domains are the brands of the parts."""
    first = F.col("p_size") <= 10
    adjust = F.create_map(F.lit("domain_keyword_present"), F.round(F.min("p_retailprice") / 10000, 6), F.lit("primary_only_no_domain"), F.lit(-0.1))
    domain = table(spark, d, "part").groupBy("p_brand").agg(
        F.collect_set(F.when(first, F.lower("p_name"))).alias("primary_keywords"), F.collect_set(F.when(~first, F.lower("p_type"))).alias("domain_keywords"), F.max("p_size").alias("min_domain_matches"),
        F.when(F.count(F.lit(1)) > 50, F.array(F.min("p_type"))).otherwise(F.array().cast("array<string>")).alias("tier_whitelist"), adjust.alias("score_adjustments"),
    )
    path = scratch_path(spark, "taxonomy")
    # a file for each domain, as a large taxonomy is kept
    entry = F.create_map("p_brand", F.struct("primary_keywords", "domain_keywords", "min_domain_matches", "tier_whitelist", "score_adjustments"))
    domain.select(F.to_json(F.struct(entry.alias("domains")))).write.option("maxRecordsPerFile", 1).text(path)
    return files.taxonomy_file(spark, path)


@query("s05_taxonomy_file", f"WITH {TAXONOMY_SQL} SELECT domain, keyword, kind, min_matches, boost::DOUBLE AS boost, penalty::DOUBLE AS penalty, tier FROM tx JOIN td USING (domain)")
def s05(spark, d):
    words, dims = taxonomy(spark, d)
    return words.join(dims, "domain")


@query("j15_dimension_lookup", f"WITH {TAXONOMY_SQL} SELECT domain, string_agg(keyword, ',' ORDER BY keyword) AS keywords, count(*) AS n FROM tx WHERE kind = 'primary' GROUP BY domain")
def j15(spark, d):
    words, _ = taxonomy(spark, d)
    return words.where("kind = 'primary'").groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("keywords"), F.count_distinct("keyword").alias("n"))


def book_files(spark, d) -> str:
    """Books of documents: a source is a book, its documents are the chapters."""
    path = scratch_path(spark, "books")
    empty = F.array().cast("array<string>")
    refs = F.array().cast("array<struct<book:string,chapter:int,title:string,score:double>>")
    chapter = F.struct(F.col("doc_id").cast("int").alias("chapter_number"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("summary"), F.col("text").alias("content"), F.slice(T.words("text"), 1, 3).alias("keywords"), empty.alias("concepts"), refs.alias("similar_chapters"), empty.alias("code_snippets"))
    title = F.struct(F.col("source").alias("title"))
    docs(spark, d).select(title.alias("metadata"), F.array(chapter).alias("chapters")).write.option("maxRecordsPerFile", 200).json(path)
    return path


@query("s06_books", "SELECT source AS book, doc_id::INT AS chapter_number, 't' || doc_id AS title, length(text)::INT AS n FROM documents")
def s06(spark, d):
    x = spark.read.schema(files.BOOK).json(book_files(spark, d))
    flat = x.select(F.col("metadata.title").alias("book"), F.explode("chapters").alias("c")).select("book", "c.*")
    return flat.select("book", "chapter_number", "title", F.length("content").alias("n"))


@query("s07_retrieval_ground_truth", "SELECT source || ':t' || doc_id AS key, length(left(text, 1000)) AS corpus, length(left(text, 200)) AS query FROM documents")
def s07(spark, d):
    x = spark.read.schema(files.BOOK).json(book_files(spark, d)).select(F.col("metadata.title").alias("book"), F.explode("chapters").alias("c"))
    return x.select(F.concat_ws(":", "book", "c.title").alias("key"), F.length(F.substring("c.content", 1, 1000)).cast("long").alias("corpus"), F.length(F.substring("c.content", 1, 200)).cast("long").alias("query"))


@query("s08_chapter_terms", "SELECT lower(p_name) AS term FROM part GROUP BY 1 UNION SELECT lower(p_type) FROM part")
def s08(spark, d):
    path = scratch_path(spark, "metadata")
    part = table(spark, d, "part")
    part.select(F.lit("c").alias("title"), F.array("p_name", F.upper("p_name")).alias("keywords"), F.array("p_type").alias("concepts"), F.lit(1).alias("start_page"), F.lit(2).alias("end_page")).write.json(path)
    return files.chapter_terms(spark, path).select(F.lower("term").alias("term"))


PAIR_ROWS = "SELECT a.text AS anchor, b.text AS positive, a.conv_id % 10 / 10 AS score FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def turn_pairs(spark, d):
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = c.withColumn("positive", F.lead("text").over(w)).withColumn("_t", F.lead("turn").over(w)).where("_t = turn + 1")
    return x.select(F.col("text").alias("anchor"), "positive", F.lit(None).cast("string").alias("negative"), (F.col("conv_id") % 10 / 10).alias("score"))


@query("s09_pair_source", PAIR_ROWS)
def s09(spark, d):
    path = scratch_path(spark, "pairs")
    files.write_pairs(turn_pairs(spark, d), path)
    return files.pairs(spark, path).select("anchor", "positive", "score")


@query("s10_pair_sink", f"SELECT count(*) AS n, round(sum(score), 4) AS score FROM ({PAIR_ROWS})")
def s10(spark, d):
    path = scratch_path(spark, "pairs")
    for _ in range(2):  # the second run overwrites the first
        files.write_pairs(turn_pairs(spark, d), path)
    return files.pairs(spark, path).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("s11_append_log", f"WITH {TOKENS_SQL}, k AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS t FROM conversations) SELECT conv_id, turn, 2 * len(t) AS raw, 2 * len(list_filter(t, lambda x: ({noise_sql('x')}) IS NULL)) AS kept FROM k")
def s11(spark, d):
    from textloom.operators.filters import noise_reason

    raw = F.array_distinct(T.words("text"))
    x = table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw")).withColumn("kept", F.filter("raw", lambda t: noise_reason(t).isNull()))
    path = scratch_path(spark, "log")
    for _ in range(2):
        files.append_log(x, path)
    log = spark.read.schema("conv_id long, turn long, raw_count long, kept_count long, timestamp timestamp").json(path)
    return log.groupBy("conv_id", "turn").agg(F.sum("raw_count").alias("raw"), F.sum("kept_count").alias("kept"))


@query("s12_concept_config", "SELECT label AS topic, count(*) AS size FROM embeddings GROUP BY label")
def s12(spark, d):
    path = scratch_path(spark, "concepts")
    schema = "topic int, size long"
    assert files.load_concepts(spark, path, schema).isEmpty()
    files.save_concepts(table(spark, d, "embeddings").groupBy(F.col("label").alias("topic")).agg(F.count(F.lit(1)).alias("size")), path)
    return files.load_concepts(spark, path, schema)


@query("s13_alias_build", f"WITH {ALIAS_SQL} SELECT classification, count(*) AS n FROM aliases GROUP BY 1")
def s13(spark, d):
    path = scratch_path(spark, "alias-dim")
    alias_dim(spark, d).write.parquet(path)
    return spark.read.parquet(path).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@query("s14_audit_csv", "SELECT p_type AS Concept, count(*) AS Occurrences, count(DISTINCT p_brand) AS Books FROM part GROUP BY 1")
def s14(spark, d):
    path = scratch_path(spark, "audit")
    x = table(spark, d, "part").groupBy("p_type").agg(F.lit("d").alias("d"), F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("b"), F.count_distinct("p_size").alias("c"), F.array_join(F.slice(F.array_sort(F.collect_set("p_brand")), 1, 10), "; ").alias("s"), F.lit("").alias("k"))
    files.write_audit(x, path)
    return files.read_audit(spark, path).select("Concept", "Occurrences", "Books")


@query("s15_model_artifact")
def s15(spark, d):
    from pyspark.ml.classification import LogisticRegressionModel

    path = scratch_path(spark, "model")
    x = labelled(spark, d)
    classify.train(x, "embedding", "y").save(path)
    return classify.predict(x, "embedding", LogisticRegressionModel.load(path), ["keyword", "concept"]).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))


@query("s16_search_client", "SELECT p_partkey, length(p_name) AS hits FROM part")
def s16(spark, d):
    def client(name: str) -> dict:
        return {"hits": len(name)}

    return services.request(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name"], "hits long", client).drop("p_name")


SIGNS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("s17_summaries", f"""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(substr(text, 1, 8000), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {SIGNS})), lambda s: s <> '') AS p FROM conversations),
b AS (SELECT conv_id, turn, list_sort(list_transform(p, lambda s, i: {{'l': -length(s), 'i': i, 's': s}}))[1:2] AS b FROM p)
SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(b, lambda x: {{'i': x.i, 's': x.s}})), lambda x: x.s), ' ') AS summary FROM b""")
def s17(spark, d):
    return services.summarize(table(spark, d, "conversations"), "text").select("conv_id", "turn", "summary")


PAGES = "pg AS (SELECT p_size AS book, p_partkey AS page, CASE p_partkey % 10 WHEN 3 THEN 'Index' || chr(10) || p_name WHEN 9 THEN 'About the author ' || p_name ELSE p_name END AS content FROM part)"


@query("s19_index_pages", f"""WITH {PAGES}, o AS (SELECT *, max((starts_with(content, 'Index'))::INT) OVER (PARTITION BY book ORDER BY page) AS i FROM pg), n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page) AS n FROM o WHERE i = 1),
s AS (SELECT *, coalesce(max((starts_with(content, 'About') AND n > 2)::INT) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM n) SELECT book, page FROM s WHERE s = 0""")
def s19(spark, d):
    k = F.col("p_partkey") % 10
    content = F.when(k == 3, F.concat(F.lit("Index\n"), "p_name")).when(k == 9, F.concat(F.lit("About the author "), "p_name")).otherwise(F.col("p_name"))
    pages = table(spark, d, "part").select(F.col("p_size").alias("book"), F.col("p_partkey").alias("page"), content.alias("content"))
    return documents.index_pages(pages, "book", "page", "content").select("book", "page")


def flagship(spark, d):
    approved = lexical.word_counts(docs(spark, d)).where("n >= 3").select("term")
    return pipelines.extract_metadata(docs(spark, d), keyword_dim(spark), domain_dim(spark), approved, STOP)


FLAGSHIP_SQL = f"""WITH {TOKENS_SQL}, app AS (SELECT term FROM tok GROUP BY term HAVING count(*) >= 3), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term NOT IN ({literals(STOP)}) GROUP BY ALL),
w AS (SELECT doc_id, term, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 9) AS weight, ({noise_sql('term')}) IS NOT NULL AS noise FROM tf), noise AS (SELECT doc_id, count(*) FILTER (WHERE noise) AS n_noise FROM w GROUP BY doc_id),
kw0 AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term DESC) AS r FROM w WHERE NOT noise AND term IN (SELECT term FROM app)), kws AS (SELECT doc_id, string_agg(term, ' ' ORDER BY r) AS keywords, count(*) AS n FROM kw0 WHERE r <= 20 GROUP BY doc_id)
SELECT d.doc_id, keywords, coalesce(n, 0) AS n_keywords, coalesce(n_noise, 0) AS n_noise FROM documents d LEFT JOIN noise USING (doc_id) LEFT JOIN kws USING (doc_id)"""


@query("o01_metadata_extraction", FLAGSHIP_SQL)
def o01(spark, d):
    x = flagship(spark, d)
    return x.select("doc_id", said("keywords"), F.col("n_keywords").cast("long").alias("n_keywords"), "n_noise")


def said(c):
    """An array joined by blanks, null if it is empty."""
    return F.when(F.size(c) > 0, F.array_join(c, " ")).alias(c)


REJECTED_SQL = f"""WITH {TOKENS_SQL}, app AS (SELECT term FROM tok GROUP BY term HAVING count(*) >= 3), u AS (SELECT DISTINCT doc_id, term FROM tok WHERE term NOT IN ({literals(STOP)})),
r AS (SELECT doc_id, term, {noise_sql('term')} AS noise, term IN (SELECT term FROM app) AS ok FROM u),
n AS (SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE noise IS NULL) AS after_noise, count(*) FILTER (WHERE noise IS NULL AND ok) AS after_dictionary,
 string_agg(term || '=' || coalesce(noise, 'not_in_approved_keywords'), ' ' ORDER BY term) FILTER (WHERE noise IS NOT NULL OR NOT ok) AS rejected FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(words, 0) AS words, coalesce(after_noise, 0) AS after_noise, coalesce(after_dictionary, 0) AS after_dictionary, least(20, coalesce(after_dictionary, 0)) AS keywords, coalesce(rejected, '') AS rejected FROM documents d LEFT JOIN n USING (doc_id)"""


@query("o01_rejected_terms", REJECTED_SQL)
def o01_rejected(spark, d):
    x = flagship(spark, d)
    stat = lambda k: F.element_at("stats", k).alias(k)
    words = F.filter("rejected", lambda r: r["reason"] != "not_in_approved_concepts")
    return x.select("doc_id", stat("words"), stat("after_noise"), stat("after_dictionary"), stat("keywords"), F.array_join(F.transform(words, lambda r: F.concat_ws("=", r["term"], r["reason"])), " ").alias("rejected"))


@query("o01_stages", f"""WITH {SCORES}, c2 AS (SELECT k, count(*) AS hits, count(*) FILTER (WHERE name LIKE '%e%') AS n, string_agg(DISTINCT name || '=not_in_approved_concepts', ' ' ORDER BY name || '=not_in_approved_concepts') FILTER (WHERE name NOT LIKE '%e%') AS refused FROM concepts GROUP BY 1)
SELECT doc_id, coalesce(hits, 0) AS taxonomy_concepts, coalesce(n, 0) AS concepts, coalesce(refused, '') AS refused, 'keywords noise_filter concepts ' || CASE WHEN n > 0 THEN 'domain ' ELSE '' END || 'quality' AS stages FROM documents LEFT JOIN c2 ON k = doc_id""")
def o01_stages(spark, d):
    named = keyword_dim(spark).where("keyword like '%e%'").select(F.col("keyword").alias("term"))  # the approved concepts
    x = pipelines.extract_metadata(docs(spark, d), keyword_dim(spark), domain_dim(spark), None, STOP, approved_concepts=named)
    out = F.filter("rejected", lambda r: r["reason"] == "not_in_approved_concepts")
    stat = lambda k: F.element_at("stats", k).alias(k)
    return x.select("doc_id", stat("taxonomy_concepts"), stat("concepts"), F.array_join(F.transform(out, lambda r: F.concat_ws("=", r["term"], r["reason"])), " ").alias("refused"), F.array_join("stages", " ").alias("stages"))


FULL_SQL = f"""WITH {SCORES}, {FLAGSHIP_SQL.removeprefix('WITH ').rsplit('SELECT d.doc_id, keywords', 1)[0].rstrip()}, c2 AS (SELECT k, count(*) AS n FROM concepts GROUP BY 1),
x AS (SELECT d.doc_id, keywords, coalesce(kws.n, 0) AS kn, coalesce(n_noise, 0) AS n_noise, coalesce(c2.n, 0) AS cn, domain, detected.share AS own, coalesce(detected.share, 0) AS share, length(text) AS len
 FROM documents d LEFT JOIN noise USING (doc_id) LEFT JOIN kws USING (doc_id) LEFT JOIN c2 ON c2.k = d.doc_id LEFT JOIN detected ON detected.k = d.doc_id AND r = 1)
SELECT doc_id, keywords, kn AS n_keywords, cn AS n_concepts, n_noise, domain, own AS share, {QUALITY_SQL} AS quality FROM x"""


@query("o01_metadata_extraction_full", FULL_SQL)
def o01_full(spark, d):
    return flagship(spark, d).select("doc_id", said("keywords"), F.col("n_keywords").cast("long").alias("n_keywords"), "n_concepts", "n_noise", "domain", "share", "quality")


HASHED = pipelines.Stages(seeds=-0.2, similar=-0.4)
SEED_PHRASES = ["software architecture", "data structure", "machine learning", "design pattern"]


@query("o02_hybrid_concepts")
def o02(spark, d):
    # the surveyed chain; hash embeddings know no meaning, so their thresholds only show that the stages work
    x = pipelines.hybrid_concepts(docs(spark, d), STOP, stages=HASHED, seeds=SEED_PHRASES)
    return x.select("doc_id", "term", F.round("score", 6).alias("score"), "source")


@query("o02_stage_counts")
def o02_counts(spark, d):
    return pipelines.stage_counts(pipelines.audited_concepts(docs(spark, d), STOP, stages=HASHED, seeds=SEED_PHRASES))


CASCADE = f"""{TERMS_SQL}, {ALIAS_SQL}, c AS (SELECT t.term, a.canonical_term, a.classification, ({heuristic_sql('t.term')}) AS reason FROM terms t LEFT JOIN aliases a ON lower(trim(t.term)) = a.alias)"""


@query("o03_four_tier_cascade", f"""WITH {CASCADE} SELECT term, CASE WHEN classification IS NOT NULL THEN classification WHEN length(term) >= 12 THEN 'concept' WHEN reason IS NOT NULL THEN 'rejected' ELSE 'keyword' END AS classification,
CASE WHEN classification IS NOT NULL THEN 1 WHEN length(term) >= 12 THEN 2 WHEN reason IS NOT NULL THEN 3 ELSE 4 END AS tier, CASE WHEN classification IS NOT NULL THEN 1.0 WHEN length(term) >= 12 THEN 0.8 WHEN reason IS NOT NULL THEN 1.0 ELSE 0.6 END::DOUBLE AS confidence FROM c""")
def o03(spark, d):
    def model(df):
        return df.withColumn("predicted", F.when(F.length("term") >= 12, "concept").otherwise("unknown")).withColumn("confidence", F.lit(0.8))

    last = F.struct(F.lit("keyword").alias("classification"), F.lit(0.6).alias("confidence"))
    return pipelines.cascade(terms(spark, d), "term", alias_dim(spark, d), model, last).select("term", "classification", "tier", "confidence")


@query("o04_three_tier_cascade", f"WITH {CASCADE} SELECT term, CASE WHEN classification IS NOT NULL THEN classification WHEN reason IS NOT NULL THEN 'rejected' ELSE 'unknown' END AS classification, CASE WHEN classification IS NOT NULL THEN 1 ELSE 3 END AS tier, CASE WHEN classification IS NOT NULL OR reason IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN classification IS NULL THEN reason END AS rejection_reason FROM c")
def o04(spark, d):
    return pipelines.cascade(terms(spark, d), "term", alias_dim(spark, d)).select("term", "classification", "tier", "confidence", "rejection_reason")


@query("s18_classify_client", f"WITH {CASCADE} SELECT term, CASE WHEN length(term) % 2 = 0 THEN 'concept' ELSE 'keyword' END AS classification, (CASE WHEN length(term) > 8 THEN 0.95 ELSE 0.6 END)::DOUBLE AS confidence, term AS canonical_term FROM c WHERE classification IS NULL AND reason IS NULL")
def s18(spark, d):
    def client(term: str) -> dict:
        return {"classification": "keyword" if len(term) % 2 else "concept", "confidence": 0.95 if len(term) > 8 else 0.6, "canonical_term": term}

    aliases = materialize(spark, alias_dim(spark, d))  # both are read more than once
    undecided = materialize(spark, pipelines.cascade(terms(spark, d), "term", aliases).where("classification = 'unknown'").select("term"))  # rows that no tier decided
    answers, _ = http.classify_open(undecided, "term", client, aliases)
    return answers


@query("o05_keyword_graph", f"""WITH q AS (SELECT conv_id, turn, list_filter(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''), lambda w: length(w) > 2 AND w NOT IN ({literals(V.SIMPLE_STOPWORDS)})) AS w FROM conversations),
s AS (SELECT conv_id, turn, list_filter((list_filter(w, lambda x, i: list_position(w, x) = i))[1:10], lambda x: x NOT IN ({literals(V.GRAPH_GENERIC_TERMS)})) AS t FROM q), e AS (SELECT conv_id, turn, unnest(t) AS term, unnest(range(len(t))) AS pos FROM s)
SELECT conv_id, turn, term, pos::INT AS pos, round(greatest(0.1, 1 - pos * 0.1), 6)::DOUBLE AS score FROM e""")
def o05(spark, d):
    return pipelines.keyword_graph(table(spark, d, "conversations"), ["conv_id", "turn"]).withColumn("score", F.round("score", 6))


#: Generators that fail: some conversations time out a few times, some are refused.
FAILS = "CASE WHEN conv_id % 11 = 10 THEN 'GenerateError: bad input' WHEN conv_id % 7 = 0 AND retry_count < conv_id % 5 THEN 'GenerateError: Timeout of the service' END"


@query("o05_keyword_states", f"""WITH q AS (SELECT conv_id, turn, list_filter(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''), lambda w: length(w) > 2 AND w NOT IN ({literals(V.SIMPLE_STOPWORDS)})) AS w FROM conversations),
s AS (SELECT *, (list_filter(w, lambda x, i: list_position(w, x) = i))[1:10] AS t, CASE WHEN conv_id % 11 = 10 THEN 0 WHEN conv_id % 7 = 0 THEN conv_id % 5 ELSE 0 END AS fails, conv_id % 11 = 10 AS refused FROM q),
r AS (SELECT *, refused OR fails > 3 AS ended, list_filter(t, lambda x: x NOT IN ({literals(V.GRAPH_GENERIC_TERMS)})) AS good, list_filter(t, lambda x: x IN ({literals(V.GRAPH_GENERIC_TERMS)})) AS bad FROM s)
SELECT conv_id, turn, least(fails, 3)::INT AS retry_count, CASE WHEN refused THEN 1 ELSE least(fails, 4) END::INT AS n_errors,
 CASE WHEN ended THEN '' WHEN len(good) = 0 THEN 'generate validate consensus' ELSE 'generate validate rank consensus' END AS stages,
 CASE WHEN ended THEN '' ELSE array_to_string(list_transform(good, lambda x, i: x || ':' || round(greatest(0.1, 1 - (i - 1) * 0.1), 1)::VARCHAR || ':3'), ' ') END AS final, CASE WHEN ended THEN '' ELSE array_to_string(bad, ' ') END AS excluded FROM r""")
def o05_states(spark, d):
    x = state_graph.keywords(table(spark, d, "conversations"), error=F.expr(FAILS))
    final = F.transform("final_terms", lambda t: F.concat_ws(":", t["term"], F.format_number(t["score"], 1), t["models_agreed"].cast("string")))
    return x.select("conv_id", "turn", "retry_count", F.size("errors").alias("n_errors"), F.array_join("stages_completed", " ").alias("stages"), F.array_join(final, " ").alias("final"), F.array_join(F.transform("excluded_terms", lambda t: t["term"]), " ").alias("excluded"))


@query("o06_extract_terms")
def o06(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return pipelines.extract_terms(q, STOP)


@query("o07_search_and_curate", f"WITH {BM25}, r AS (SELECT query_id, source AS book, doc_id AS chapter, round(score, 6) AS score FROM bm JOIN documents USING (doc_id)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chapter) AS rank FROM r WHERE score >= 1) WHERE rank <= 5")
def o07(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return pipelines.search(q, docs(spark, d), "query_id", 5, None, 1.0)


@query("o08_topics_and_assignments")
def o08(spark, d):
    assigned, topics = discovered(spark, d)
    return assigned.join(topics.select("topic", "size", "name"), "topic").select("doc_id", "topic", "size", "name", F.round("confidence", 4).alias("confidence"))


@query("o09_cross_references", f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS match, round({COS}, 6) AS base, CASE WHEN a.label = b.label THEN 0.15 ELSE 0.0 END::DOUBLE AS boost FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
s AS (SELECT *, round(base + boost, 6) AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, match) AS rank FROM s WHERE score >= 0.2) SELECT * FROM r WHERE rank <= 5""")
def o09(spark, d):
    e = table(spark, d, "embeddings")
    return pipelines.cross_references(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", "label", least=0.2)


@query("o10_label_batches", "WITH t AS (SELECT p_type AS topic, round(count(*) / max(count(*)) OVER (), 6) AS quality FROM part GROUP BY 1) SELECT topic, quality, (row_number() OVER (ORDER BY quality DESC, topic) - 1) // 50 AS batch FROM t WHERE quality >= 0.5")
def o10(spark, d):
    n = table(spark, d, "part").groupBy(F.col("p_type").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n").alias("m"))  # one row
    t = n.join(F.broadcast(most)).select("topic", F.round(F.col("n") / F.col("m"), 6).alias("quality"))
    return pipelines.label_batches(t, "topic", "quality")


HOURS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def streamed(spark, d, f, name, mode="complete"):
    """The function over events as a stream, every file of the folder read."""
    folder = scratch_path(spark, "events")
    table(spark, d, "events").repartition(2).write.parquet(folder)
    return events.run_to_table(spark, f(events.read_stream(spark, folder, 1)), name, mode, scratch_path(spark, "stream"))


@query("st01_tumbling_windows", HOURS)
def st01(spark, d):
    return events.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("st02_tumbling_windows_streamed", HOURS)
def st02(spark, d):
    return streamed(spark, d, events.tumbling, "tumbling").withColumn("total", F.round("total", 4))


@query("st03_sliding_windows", "WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, event_type, value FROM events, range(2) t(k)) SELECT start, start + INTERVAL 2 HOURS AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL")
def st03(spark, d):
    return events.sliding(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("st04_session_windows", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS \"end\", user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def st04(spark, d):
    return events.sessions(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("st05_deduplicated", "SELECT count(DISTINCT event_id) AS n FROM events")
def st05(spark, d):
    twice = table(spark, d, "events").unionByName(table(spark, d, "events"))
    return events.deduplicated(twice).agg(F.count(F.lit(1)).alias("n"))


TOTALS = "SELECT user_id, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY user_id"


@query("st06_running_totals", TOTALS)
def st06(spark, d):
    return events.running_totals(table(spark, d, "events")).withColumn("total", F.round("total", 3))


@query("st07_running_totals_streamed", TOTALS)
def st07(spark, d):
    x = streamed(spark, d, events.running_totals, "totals", "update")
    return x.groupBy("user_id").agg(F.max_by("n", "n").alias("n"), F.round(F.max_by("total", "n"), 3).alias("total"))
