"""Keyword statistics, word ranks, density clusters and the hybrid chain against plain computations; clients against a local server."""

from __future__ import annotations

import json
import math
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import cluster, lexical
from textloom.operators import vectors as X
from textloom.plans import pipelines
from textloom.sources import http, services

TEXT = "Machine learning systems use data. Machine learning of data is old. The Deep Learning of Google AI, and data; data systems."
STOP = ["the", "of", "is", "use", "and"]


def test_keyword_scores_by_hand():
    """The statistics of one text, written out."""
    got = {w: (n, s) for w, n, s in lexical.keywords_of(TEXT, frozenset(STOP), 3, None, 1.0)}
    tf = {"machine": 2, "learning": 3, "systems": 2, "data": 4, "old": 1, "deep": 1, "google": 1}
    mean = sum(tf.values()) / 7
    std = math.sqrt(sum((n - mean) ** 2 for n in tf.values()) / 7)

    def weight(n, left, right, case, sentences):
        related = 1 + (left + right) * n / 4
        return math.log(math.log(3 + np.median(sentences))) * related / (case / (1 + math.log(n)) + n / (mean + std) / related + len(sentences) / 3 / related)

    # learning: left machine 2, deep 1; right systems 1, of 2; one capital inside a sentence
    learning = weight(3, 2 / 3, 2 / 3, 1, [0, 1, 2])
    machine = weight(2, 0, 1 / 2, 0, [0, 1])
    assert got["learning"] == (3, pytest.approx(learning / (3 * (1 + learning)), abs=1e-8))
    assert got["machine learning"] == (2, pytest.approx(machine * learning / (2 * (1 + machine + learning)), abs=1e-8))
    google = weight(1, 1, 1, 1, [2])
    chance = 2 / 3 * 1  # two of three times learning is followed by of, and google always comes after it
    assert got["learning of google"] == (1, pytest.approx(learning * (2 - chance) * google / (learning + google - (1 - chance) + 1), abs=1e-8))
    assert "data systems" in got and "data data" not in got and not any(w.split()[0] in STOP or w.split()[-1] in STOP for w in got)


def test_keywords_that_are_alike_go():
    assert lexical.edits("kitten", "sitting") == 3 and lexical.alike("data structures", "data structure", 0.9) and not lexical.alike("data", "date", 0.9)
    words = [w for w, _, _ in lexical.keywords_of("Distributed computation systems. Distributed computations systems. Other things matter.", frozenset(), 3, None, 0.9)]
    assert sum(w.startswith("distributed computation") and w.endswith("systems") for w in words) == 1


def test_keyword_scores_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " .\n! "), (4, "a b c"), (5, TEXT), (6, "word " * 5000), (None, TEXT)], "doc_id long, text string")
    got = lexical.keyword_scores(docs, stopwords=STOP, top=5).collect()
    assert {r.doc_id for r in got} == {5, 6, None} and [r.rank for r in got if r.doc_id == 5] == [1, 2, 3, 4, 5]
    assert [(r.word, r.tf, r.score) for r in got if r.doc_id == 5] == lexical.keywords_of(TEXT, frozenset(STOP), 3, 5, 0.9)


def test_word_ranks_against_the_eigenvector(spark):
    r = random.Random(3)
    words = [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()) for _ in range(200)]
    got = {x.word: x.rank for x in lexical.word_ranks(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), tolerance=1e-12).collect()}
    names = sorted(set(words))
    m = np.zeros((len(names), len(names)))
    for k in (1, 2):
        for a, b in zip(words, words[k:]):
            if a != b:
                m[names.index(a), names.index(b)] += 1
                m[names.index(b), names.index(a)] += 1
    m = 0.85 * (m / m.sum(1, keepdims=True)).T + 0.15 / len(names)
    values, vectors = np.linalg.eig(m)
    main = np.abs(vectors[:, values.real.argmax()].real)
    assert [got[n] for n in names] == pytest.approx((main / main.sum()).tolist(), abs=1e-6)


def blobs(seed, sizes, spread=0.03):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(0, spread, (n, 6)) + np.eye(6)[i] for i, n in enumerate(sizes)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, np.repeat(np.arange(len(sizes)), sizes)


@pytest.mark.parametrize("sizes", [(5, 7, 4), (3, 3), (12, 3, 3, 9)])
def test_density_clusters_of_separate_groups(sizes):
    x, own = blobs(sum(sizes), sizes)
    labels = cluster.hierarchy_labels(np.clip(1 - x @ x.T, 0, 2))
    for a in set(labels) - {-1}:
        assert len(set(own[labels == a])) == 1  # no cluster joins two groups
    assert len(set(labels) - {-1}) >= len(sizes) and (labels == -1).mean() < 0.5


def test_density_clusters_of_few_points():
    assert cluster.hierarchy_labels(np.zeros((0, 0))).tolist() == [] and cluster.hierarchy_labels(np.zeros((1, 1))).tolist() == [-1]
    assert cluster.hierarchy_labels(np.zeros((4, 4))).tolist() == [0] * 4  # equal points are one cluster
    line = np.abs(np.subtract.outer(np.array([0, 1, 2, 50, 51, 52, 500.0]), np.array([0, 1, 2, 50, 51, 52, 500.0])))
    labels = cluster.hierarchy_labels(line)
    assert len(set(labels[:3])) == 1 and len(set(labels[3:6])) == 1 and labels[0] != labels[3] and labels[6] == -1


def test_hybrid_concepts_stage_by_stage(spark, sf_dir):
    """Every stage's flag, and counts that add up to all candidates."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).select("doc_id", "text").cache()
    every = pipelines.Stages(seeds=-0.2, similar=-0.4)
    audited = pipelines.audited_concepts(docs, STOP, stages=every, seeds=["data structure"]).cache()
    rows = audited.collect()
    merged = pipelines.concept_candidates(docs, STOP).collect()
    assert sorted((r.doc_id, r.term) for r in rows) == sorted((r.doc_id, r.term) for r in merged)
    counts = {r.stage: r.terms for r in pipelines.stage_counts(audited).collect()}
    assert sum(counts.values()) == len(merged) and counts["patterns"] > 0 and counts["kept"] > 0
    kept = [r for r in rows if r.dropped is None]
    assert all(" " in r.term for r in kept)  # concepts have several words
    got = pipelines.hybrid_concepts(docs, STOP, stages=every, seeds=["data structure"]).collect()
    assert sorted((r.doc_id, r.term) for r in got) == sorted((r.doc_id, r.term) for r in kept)
    none = pipelines.Stages(False, False, False, False, None, None, None)
    assert pipelines.audited_concepts(docs, STOP, stages=none).where("dropped is not null").count() == 0
    # of a cluster the shortest term stays
    left = [r for r in rows if r.dropped in (None, "clusters", "similar")]
    labels = {(r.doc_id, r.term): r.label for r in cluster.term_clusters(audited.where("dropped is null or dropped in ('clusters', 'similar')").withColumn("v", X.hash_embedding("term")), "doc_id", "term", "v").collect()}
    best = {}
    for r in left:
        if labels[r.doc_id, r.term] >= 0:
            k = (r.doc_id, labels[r.doc_id, r.term])
            best[k] = min(best.get(k, (math.inf,)), (len(r.term), r.score, r.term))
    for r in left:
        lab = labels[r.doc_id, r.term]
        assert (r.dropped == "clusters") == (lab >= 0 and best[r.doc_id, lab][2] != r.term)


def test_topics_and_outliers(spark):
    x, own = blobs(5, (60, 50, 40))
    far = np.array([[1.0, 1, 0, 0, 0, 0], [0, 1.0, 1, 0, 0, 0]]) / 2**0.5
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, far]))]
    got = {r.k: (r.topic, r.confidence) for r in cluster.topic_model(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 3, 4, 6.0).collect()}
    assert got[150] == got[151] == (-1, 0.0)
    of = [{got[i][0] for i in np.flatnonzero(own == g).tolist()} - {-1} for g in range(3)]
    assert all(len(t) == 1 for t in of) and len(set.union(*of)) == 3 and all(0 <= c <= 1 for _, c in got.values())


def test_discovery_of_two_vocabularies(spark):
    r = random.Random(1)
    worlds = ["apple banana cherry grape melon".split(), "engine wheel brake clutch gear".split()]
    texts = [(i, " ".join(r.choice(worlds[i % 2]) for _ in range(40))) for i in range(40)]
    docs = spark.createDataFrame([*texts, (98, ""), (99, None)], "doc_id long, text string")
    assigned = cluster.topic_model(cluster.text_vectors(docs, size=64), "doc_id", "vector", 2, 2, 5.0).cache()
    topics = {x.doc_id: x.topic for x in assigned.collect()}
    assert set(topics) == set(range(40)) and len({topics[i] for i in range(0, 40, 2)}) == len({topics[i] for i in range(1, 40, 2)}) == 1 and topics[0] != topics[1]
    found = {x.topic: x for x in cluster.discover(docs, assigned, min_df=2).collect()}
    for k in (0, 1):
        t = found[topics[k]]
        assert t.size == 20 and t.representatives == [k, k + 2, k + 4] and {w for x in t.terms for w in x.split()} <= set(worlds[k]) and t.name == "_".join(t.terms[:3])
    out = {x.topic: x for x in cluster.discover(docs, assigned.withColumn("topic", F.when(F.col("doc_id") < 4, -1).otherwise(F.col("topic")))).collect()}
    assert out[-1].name == "Outlier" and out[-1].terms is None and out[-1].size == 4


def test_trained_classifier_by_its_own_arithmetic(spark, sf_dir, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    from textloom.operators import classify
    from textloom.queries import QUERIES

    x, own = blobs(9, (80, 30), 0.3)
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, own, strict=True))], "vec_id long, embedding array<double>, y int")
    model = classify.train(df, "embedding", "y")
    model.save(str(tmp_path / "model"))
    again = LogisticRegressionModel.load(str(tmp_path / "model"))
    got = {r.vec_id: r for r in classify.predict(df, "embedding", model, ["keyword", "concept"]).collect()}
    same = {r.vec_id: r for r in classify.predict(df, "embedding", again, ["keyword", "concept"]).collect()}
    p = 1 / (1 + np.exp(-(x @ np.array(model.coefficients) + model.intercept)))
    for i in range(len(x)):
        best = max(p[i], 1 - p[i])
        assert got[i].confidence == pytest.approx(best) and same[i] == got[i]
        assert got[i].predicted == ("unknown" if best < 0.7 else "concept" if p[i] >= 0.5 else "keyword")
    sure = [i for i in range(len(x)) if got[i].predicted != "unknown"]
    assert sum((got[i].predicted == "concept") == bool(own[i]) for i in sure) > 0.9 * len(sure)
    from collections import Counter

    one = Counter(r.predicted for r in QUERIES["v18_trained_inference"](spark, sf_dir).collect())
    assert one == {r.predicted: r.n for r in QUERIES["s15_model_artifact"](spark, sf_dir).collect()}


def test_extract_terms_by_hand(spark, sf_dir):
    """Candidates, their places, the ranker's score and the vote, for each query."""
    docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text").limit(15).cache()
    by = {}
    for r in pipelines.concept_candidates(docs, STOP, clean=False).collect():
        by.setdefault(r.doc_id, []).append((r.score, r.term))
    wanted = []
    for i, found in by.items():
        rows = []
        for place, (_, term) in enumerate(sorted(found)):
            rank = ((1 - place / len(found) * 0.3) + min(len(term) / 10, 1.0)) / 2
            agreed = 2 + (rank >= 0.5)
            rows.append((round((0.8 + rank) / 3, 9), term, agreed))
        rows.sort(key=lambda x: (-x[0], x[1]))
        wanted += [(i, t, round(s, 6), a, n) for n, (s, t, a) in enumerate(rows[:10], 1)]
    got = sorted(tuple(r) for r in pipelines.extract_terms(docs, STOP).collect())
    assert [(i, t, a, n) for i, t, _, a, n in got] == [(i, t, a, n) for i, t, _, a, n in sorted(wanted)]
    assert [s for _, _, s, _, _ in got] == pytest.approx([s for _, _, s, _, _ in sorted(wanted)], abs=2e-6)


def test_approximate_distinct_counts(spark, sf_dir):
    from textloom.queries import QUERIES

    assert all(abs(r.estimate - r.n) <= 0.1 * r.n for r in QUERIES["x04_approximate_distinct"](spark, sf_dir).collect())


def test_queries_in_blocks(spark):
    rows = spark.range(50).select(F.col("id").alias("k"))
    asked = spark.range(7).select(F.col("id").alias("q"))
    one, many = (sorted(map(tuple, X.against(asked, rows, F.col("k") != F.col("q"), 100, most).select("q", "k").collect())) for most in (10_000, 250))
    assert one == many == [(q, k) for q in range(7) for k in range(50) if q != k]


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        seen: dict = {}

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            key = json.dumps(body, sort_keys=True)
            n = Handler.seen[key] = Handler.seen.get(key, 0) + 1
            status, out = 200, {}
            if self.path == "/search":
                if "missing" in body["keywords"]:
                    status = 404
                if "flaky" in body["keywords"] and n < 3 or "down" in body["keywords"]:
                    status = 503
                if "slow" in body["keywords"]:
                    time.sleep(1)
                out = {"results": [{"book": w, "chapter": i, "score": 1 / (i + 1)} for i, w in enumerate(body["keywords"][: body["top_k"]])]}
            elif self.path == "/chat":
                out = {"model": body["model"], "choices": [{"message": {"content": " short: " + body["messages"][0]["content"][-5:]}}], "usage": {"total_tokens": 12}}
            elif self.path == "/classify":
                out = {"classification": "concept", "confidence": 0.95 if "Sure" in body["term"] else 0.5, "canonical_term": body["term"].lower()} if body["term"] != "bad" else {"confidence": 1}
            raw = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    own = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", Handler
    own.shutdown()


def test_search_over_http(spark, server):
    url, handler = server
    queries = spark.createDataFrame([(1, "clean code"), (2, "flaky words"), (3, "down now")], "id long, words string")
    got = http.search(queries.coalesce(1), "words", http.Endpoint(f"{url}/search", 5), 2).orderBy("id", "chapter").collect()
    assert [(r.id, r.book, r.chapter) for r in got] == [(1, "clean", 0), (1, "code", 1), (2, "flaky", 0), (2, "words", 1)]
    assert handler.seen['{"keywords": ["down", "now"], "top_k": 2}'] == 3
    call = http.search_client(http.Endpoint(f"{url}/search", 0.2))
    with pytest.raises(services.ClientError):
        services.with_retries(call)("missing")
    assert services.with_retries(call, 2, sleep=lambda s: None)("slow") is None
    assert http.Endpoint("http://x/y", 3).__getstate__()["_open"] is None


def test_summaries_over_http(spark, server):
    url, _ = server
    df = spark.createDataFrame([(1, "a text about things")], "id long, text string")
    got = services.request(df, ["text"], http.SUMMARY, http.summary_client(http.Endpoint(f"{url}/chat"), "small")).first()
    assert (got.summary, got.model, got.tokens_used) == ("short: hings", "small", 12)


def test_classification_over_http_keeps_sure_answers(spark, server, tmp_path):
    url, handler = server
    aliases = spark.createDataFrame([("known", "known_term", "keyword")], "alias string, canonical_term string, classification string")
    terms = spark.createDataFrame([("Known",), ("Sure Thing",), ("maybe",), ("Sure Thing",)], "term string")
    client = http.classify_client(http.Endpoint(f"{url}/classify"))
    answers, more = http.classify_open(terms, "term", client, aliases)
    got = sorted((r.term, r.classification, r.confidence, r.canonical_term) for r in answers.collect())
    assert got == [("Known", "keyword", 1.0, "known_term"), ("Sure Thing", "concept", 0.95, "sure thing"), ("Sure Thing", "concept", 0.95, "sure thing"), ("maybe", "concept", 0.5, "maybe")]
    more.write.parquet(str(tmp_path / "aliases"))
    again = spark.read.parquet(str(tmp_path / "aliases"))
    assert {r.alias for r in again.collect()} == {"known", "sure thing"}
    with pytest.raises(services.ClientError):
        services.with_retries(client)("bad")
