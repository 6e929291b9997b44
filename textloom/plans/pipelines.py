"""Composite dataflows: chains of DataFrame transforms over all documents at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import classify, cluster, concepts, filters, lexical, ranking
from textloom.operators import vectors as X
from textloom.sources.scratch import materialize


def extract_metadata(docs: DataFrame, keywords: DataFrame, domains: DataFrame, approved: DataFrame | None = None, stopwords: list[str] | None = None, top: int = 20, key: str = "doc_id", approved_concepts: DataFrame | None = None) -> DataFrame:
    """(key, keywords, n_keywords, n_concepts, n_noise, domain, share, quality, concepts, rejected, stages, stats): the whole extraction of every document.

    Words are weighed with each document as its own corpus, so by their counts; noise goes, then words that are not
    approved, and the `top` heaviest stay (of equal ones those that sort last). Concepts come from the taxonomy, those
    that are not approved go; domain, share and quality follow. `rejected` is the array of (term, reason) of all that went,
    by term, words before concepts; `stages` names what was done, `stats` counts what each stage saw. A chunk of
    documents has its distinct words judged once, by one join with the dictionary (lexical.judged_words). Keys are distinct.
    """
    def judge(terms: DataFrame) -> DataFrame:
        out = terms.withColumn("noise", filters.noise_reason("term"))
        if approved is None:
            return out.withColumn("reason", F.col("noise"))
        known = approved.select(T.strip(F.lower(F.col("term"))).alias("term")).distinct().withColumn("_ok", F.lit(True))
        return out.join(known, "term", "left").withColumn("reason", F.coalesce("noise", F.when(F.col("_ok").isNull(), "not_in_approved_keywords")))

    lists = lexical.judged_words(docs, judge, key, stopwords=stopwords, top=top)
    hits = concepts.taxonomy_hits(docs, keywords, key)
    rows = concepts.concept_rows(hits, concepts.domain_scores(hits, domains, key), key)
    refused = F.lit(None).cast("string")
    if approved_concepts is not None:
        known = approved_concepts.select(T.strip(F.lower(F.col("term"))).alias("_name")).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, F.lower("name") == F.col("_name"), "left")
        refused = F.when(F.col("_known").isNull(), "not_in_approved_concepts")
    rows = rows.withColumn("_refused", refused)
    names = rows.groupBy(key).agg(
        F.count_if(F.col("_refused").isNull()).alias("n_concepts"), F.count(F.lit(1)).alias("n_hits"), F.array_sort(F.collect_set(F.when(F.col("_refused").isNull(), F.col("name")))).alias("concepts"),
        F.array_sort(F.collect_set(F.when(F.col("_refused").isNotNull(), F.struct(F.col("name").alias("term"), F.col("_refused").alias("reason"))))).alias("_out"),
    )
    x = lists.join(names, key, "left").join(concepts.detect_domain(rows.where("_refused is null"), key), key, "left")
    n_keywords, n_concepts = F.size("keywords"), F.coalesce("n_concepts", F.lit(0))
    none = F.array().cast("array<string>")
    done = F.array_compact(F.array(F.lit("keywords"), F.lit("noise_filter"), F.lit(None if approved is None else "dictionary_validation"), F.lit("concepts"), F.when(n_concepts > 0, "domain"), F.lit("quality")))
    stats = {"words": F.col("n_words"), "after_noise": F.col("n_words") - F.col("n_noise"), "after_dictionary": F.col("n_good"), "keywords": n_keywords, "taxonomy_concepts": F.coalesce("n_hits", F.lit(0)), "concepts": n_concepts}
    return x.select(
        key, "keywords", n_keywords.alias("n_keywords"), n_concepts.alias("n_concepts"), "n_noise", "domain", "share", concepts.quality_score(n_keywords, n_concepts, "share", F.coalesce("length", F.lit(0))).alias("quality"),
        F.coalesce("concepts", none).alias("concepts"), F.concat("rejected", F.coalesce("_out", F.array().cast("array<struct<term:string,reason:string>>"))).alias("rejected"), done.alias("stages"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in stats]), F.array(*[v.cast("long") for v in stats.values()])).alias("stats"),
    )


@dataclass(frozen=True)
class Stages:
    """Which stages hybrid_concepts() has, and their thresholds (None: the stage is left out)."""

    clean: bool = True
    phrases: bool = True
    stems: bool = True
    patterns: bool = True
    seeds: float | None = 0.35
    clusters: int | None = 2
    similar: float | None = 0.15


def concept_candidates(docs: DataFrame, stopwords: list[str], key: str = "doc_id", top: int = 20, clean: bool = True) -> DataFrame:
    """(key, term, score, source): the best `top` statistical keywords and graph keywords of each document, merged."""
    texts = docs.select(key, (filters.clean_text("text") if clean else F.col("text")).alias("text"))
    if clean:
        texts = materialize(docs.sparkSession, texts)  # both extractors read it
    scored = lexical.keyword_scores(texts, key, stopwords=stopwords, top=top).select(key, F.col("rank").alias("pos"), F.col("word").alias("term"), "score")
    ranked = lexical.word_ranks(texts, key, stopwords=stopwords, top=top).withColumn("rank", F.round("rank", 9))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rank"), "word"))
    ranked = ranked.withColumn("pos", best).where(F.col("pos") <= top).select(key, "pos", F.col("word").alias("term"))
    return concepts.merge_terms(scored, ranked, key)


def audited_concepts(docs: DataFrame, stopwords: list[str], key: str = "doc_id", top: int = 20, stages: Stages = Stages(), seeds: list[str] | None = None, embed: X.Embedder = X.hash_embedding) -> DataFrame:
    """(key, term, score, source, dropped): all candidates, with the stage that dropped each, or null.

    Noise out, statistical and graph keywords merged, noisy phrases out (phrases), one term a stem (stems), concept
    patterns (patterns), similarity to a seed phrase (seeds), the shortest of each density cluster (clusters), similarity
    to the document (similar). A stage judges only what the stages before it left; nothing is computed twice.
    """
    out = concept_candidates(docs, stopwords, key, top, stages.clean).withColumn("dropped", F.lit(None).cast("string"))
    left = F.col("dropped").isNull()
    drop = lambda df, name, bad: df.withColumn("dropped", F.when(left & bad, name).otherwise(F.col("dropped")))
    if stages.phrases:
        out = drop(out, "phrases", ~filters.clean_phrase("term"))
    if stages.stems:
        place = F.row_number().over(Window.partitionBy(key, F.lower(T.stem("term")), F.col("dropped").isNull()).orderBy("score", "term"))
        out = drop(out.withColumn("_place", place), "stems", F.col("_place") > 1).drop("_place")
    if stages.patterns:
        out = drop(out, "patterns", filters.concept_reason("term").isNotNull())
    out = out.withColumn("_v", F.when(left, embed(F.col("term"))))  # terms that are dropped are compared no more
    if stages.seeds is not None and seeds:
        known = docs.sparkSession.range(1).select(*[embed(F.lit(s)) for s in seeds]).first()  # a stated list of phrases
        nearest = F.array_max(F.array(*[X.cosine("_v", F.array(*[F.lit(float(x)) for x in v])) for v in known]))
        out = drop(out, "seeds", nearest < stages.seeds)
    if stages.clusters is not None:
        out = materialize(docs.sparkSession, out)  # read twice from here
        labels = cluster.term_clusters(out.where("dropped is null"), key, "term", "_v", stages.clusters)
        out = out.join(labels, [key, "term"], "left")
        place = F.row_number().over(Window.partitionBy(key, "label").orderBy(F.length("term"), "score", "term"))
        out = drop(out.withColumn("_place", place), "clusters", (F.col("label") >= 0) & (F.col("_place") > 1)).drop("_place", "label")
    if stages.similar is not None:
        out = out.join(docs.select(key, embed(F.col("text")).alias("_d")), key)
        out = drop(out, "similar", X.cosine("_v", "_d") < stages.similar).drop("_d")
    return out.drop("_v")


def hybrid_concepts(docs: DataFrame, stopwords: list[str], key: str = "doc_id", top: int = 20, stages: Stages = Stages(), seeds: list[str] | None = None, embed: X.Embedder = X.hash_embedding) -> DataFrame:
    """(key, term, score, source): what all stages of audited_concepts() leave."""
    return audited_concepts(docs, stopwords, key, top, stages, seeds, embed).where("dropped is null").drop("dropped")


def stage_counts(audited: DataFrame) -> DataFrame:
    """(stage, terms): how many candidates each stage dropped, and how many were kept."""
    return audited.groupBy(F.coalesce("dropped", F.lit("kept")).alias("stage")).agg(F.count(F.lit(1)).alias("terms"))


def keyword_graph(queries: DataFrame, key: list[str], text: str = "text", top: int = 5, related: int = 5) -> DataFrame:
    """(key, pos, term, score): terms of a query, generic ones out, scored by place, generated before related ones."""
    state = queries.select(*key, T.simple_terms(text).alias("_t"))
    good, _ = filters.graph_split(F.slice("_t", 1, top), F.slice("_t", top + 1, related))
    return state.select(*key, F.posexplode(good).alias("pos", "term")).withColumn("score", ranking.positional_score("pos"))


def extract_terms(queries: DataFrame, stopwords: list[str], key: str = "doc_id", limit: int = 10, validate: float | None = None) -> DataFrame:
    """(key, term, score, models_agreed): candidates of both extractors, validated, ranked, in consensus, the best `limit`."""
    merged = concept_candidates(queries, stopwords, key, clean=False)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    place = F.row_number().over(Window.partitionBy(key).orderBy("score", "term")) - 1
    ok = F.lit(True) if validate is None else X.dot(X.hash_embedding("term", 16), X.hash_embedding(F.lit("general programming"), 16)) >= validate
    staged = merged.select(key, "term", F.lit(0.8).alias("generator_score"), ok.alias("validator_approved"), ranking.fallback_score(place, n, "term").alias("ranker_score"))
    agreed = ranking.consensus(staged).where("accepted")
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "term"))
    return agreed.withColumn("rank", best).where(F.col("rank") <= limit).select(key, "term", F.round("score", 6).alias("score"), "models_agreed", "rank")


def search(queries: DataFrame, docs: DataFrame, query: str, k: int = 5, domain: str | None = None, least: float = 0.0) -> DataFrame:
    """(query, book, chapter, score, rank): BM25 retrieval over the documents, curated: one result a chapter, a domain's books only, the best k."""
    found = lexical.bm25(docs, queries, query=query).join(docs.select("doc_id", F.col("source").alias("book")), "doc_id")
    results = found.withColumn("score", F.round("score", 6)).where(F.col("score") >= least)
    if domain:
        results = results.where(filters.matches_domain("book", domain))
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "doc_id"))
    return results.withColumn("rank", best).where(F.col("rank") <= k).select(query, "book", F.col("doc_id").alias("chapter"), "score", "rank")


def cross_references(vectors: DataFrame, queries: DataFrame, key: str, vector: str, topic: str, k: int = 5, bonus: float = 0.15, least: float = 0.5) -> DataFrame:
    """(query, match, base, boost, score, rank): cosine plus a bonus for one topic, above a threshold, the best k."""
    q = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("_q"), F.col(vector).alias("_v"), F.col(topic).alias("_t"))
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).alias("_v"), F.col(topic).alias("_t"))

    def work(asked, pack):
        import numpy as np
        import pyarrow as pa

        dots, base = X.products(asked, pack)
        base = X.rounded(np.where(np.isnan(dots), np.nan, base))
        one, two = (np.array(p.columns["_t"].to_pylist(), object) for p in (asked, pack))
        boost = np.where((one[:, None] == two[None, :]) & (two != None)[None, :], bonus, 0.0)  # noqa: E711
        score = X.rounded(base + boost)
        with np.errstate(invalid="ignore"):
            score[(score < least) | (asked.ids("_q")[:, None] == pack.ids("_k")[None, :])] = np.nan
        row, column = X.best_of(score, pack.ids("_k"), k)
        ids = {"query": asked.columns["_q"].combine_chunks().take(pa.array(row)), "match": pack.columns["_k"].combine_chunks().take(pa.array(column))}
        yield pa.RecordBatch.from_pydict(ids | {"base": base[row, column], "boost": boost[row, column], "score": score[row, column]})

    scored = X.compared(q, rows, "_v", work, f"query {dict(q.dtypes)['_q']}, match {dict(rows.dtypes)['_k']}, base double, boost double, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "match"))
    return scored.withColumn("rank", best).where(F.col("rank") <= k)


def label_batches(topics: DataFrame, topic: str, quality: str, least: float = 0.5, size: int = 50) -> DataFrame:
    """topics of enough quality with the number of the batch that a model labels them in."""
    place = F.row_number().over(Window.orderBy(F.desc(quality), topic)) - 1  # one row a topic
    return topics.where(F.col(quality) >= least).withColumn("batch", F.floor(place / size))


def cascade(terms: DataFrame, term: str, aliases: DataFrame, model=None, last=None) -> DataFrame:
    return classify.cascade(terms, term, aliases, model, last)
