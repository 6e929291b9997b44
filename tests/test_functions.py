"""Exact values of scalar functions and small operators."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import classify, cluster, concepts, documents, filters, metrics, ranking
from textloom.operators import vectors as X
from textloom.sources import files, services
from textloom.streaming import events


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("word", "expected"),
    [("implementation", "implement"), ("configuration", "configur"), ("simplicity", "simplic"), ("complexity", "complex"), ("processing", "process"), ("dependencies", "dependency"),
     ("services", "servic"), ("models", "model"), ("bus", "bus"), ("APIs", "APIs"), ("microservices", "microservices"), ("", "")],
)
def test_stem(spark, word, expected):
    assert one(spark, T.stem("w"), w=word) == expected


@pytest.mark.parametrize(
    ("term", "reason"),
    [("", "single_char"), ("x", "single_char"), ("42", "pure_number"), ("'ll", "contraction"), ("n't", "contraction"), ("__init__", "code_artifact"), ("Packt", "watermark"), ("safari", "watermark"),
     ("www", "url_fragment"), ("using", "generic_filler"), ("lambda", "code_artifact"), ("Chapter", "page_marker"), ("microservice", None)],
)
def test_noise(spark, term, reason):
    assert one(spark, filters.noise_reason("t"), t=term) == reason


@pytest.mark.parametrize(("term", "reason"), [("  ", "noise_empty"), ("3.14", "noise_pure_number"), ("_add", "noise_underscore_prefix"), ("ll", "noise_broken_contraction"), ("safari", None), ("packt", "noise_watermarks")])
def test_heuristic(spark, term, reason):
    assert one(spark, filters.heuristic_reason("t"), t=term) == reason


@pytest.mark.parametrize(("term", "reason"), [("word", "single_word_not_concept"), ("John Ousterhout", "author_pattern"), ("Robert C. Martin", "author_pattern"), ("All rights  Reserved x", "author_pattern"), ("load balancing", None)])
def test_concept_pattern(spark, term, reason):
    assert one(spark, filters.concept_reason("t"), t=term) == reason


def test_texts(spark):
    assert one(spark, T.canonical("t"), t=" API Gate-way! ") == "api_gate_way"
    assert set(one(spark, T.aliases("t"), t="API Gateway")) == {"api gateway", "api-gateway", "api_gateway", "apigateway"}
    assert one(spark, T.without_thoughts("t"), t="<think>a\nb</think> c <think>open") == "c"
    assert one(spark, T.fenced_json("t"), t='x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert one(spark, T.keep_first("t"), t=["A", "b", "a", "B", "c"]) == ["A", "b", "c"]
    assert one(spark, T.simple_terms("t"), t="The API for an api and tests") == ["api", "tests"]
    assert one(spark, T.title_domain("t"), t="Maintaining Memory") == "ai-ml"
    assert one(spark, T.title_domain("t"), t="Concurrency") == "systems"


@pytest.mark.parametrize(
    ("line", "expected"),
    [("binary tree, 12, 15-17", ("binary tree", [12, 15, 16, 17])), ("load balancing  7n, 9", ("load balancing", [7, 9])), ("Index", None), ("42", None), ("see also, 12", None), ("wide, 5-400", None)],
)
def test_index_line(spark, line, expected):
    got = one(spark, T.index_entry("l"), l=line)
    assert (tuple(got) if got else None) == expected


def test_metrics(spark):
    assert one(spark, metrics.recall("p", "r", 5), p=[1, 2, 3, 4, 5], r=[1, 3, 5]) == 1.0
    assert one(spark, metrics.recall("p", "r", 5), p=[1, 2, 9, 8, 7], r=[1, 2, 3, 4, 5]) == 0.4


def test_vectors(spark):
    assert one(spark, X.cosine("a", "b"), a=[3.0, 4.0], b=[6.0, 8.0]) == pytest.approx(1.0)
    assert one(spark, X.cosine("a", "b"), a=[0.0, 0.0], b=[6.0, 8.0]) == 0.0
    assert one(spark, X.cosine("a", "b", "zero"), a=[1.0, 0.0], b=[-1.0, 0.0]) == 0.0
    v = one(spark, X.hash_embedding(F.lit("x"), 16))
    assert sum(x * x for x in v) == pytest.approx(1.0)
    assert one(spark, X.fuse(["a", "b"]), a=[1.0, 0.0], b=[0.0, 1.0]) == pytest.approx([0.5**0.5] * 2)


def test_merge(spark):
    scored = spark.createDataFrame([(1, 0, "Api", 0.1), (1, 1, "API", 0.3), (1, 2, "node", 0.2)], "doc_id long, pos int, term string, score double")
    ranked = spark.createDataFrame([(1, 0, "api"), (1, 1, "Graph")], "doc_id long, pos int, term string")
    got = {r.term: (r.score, r.source) for r in concepts.merge_terms(scored, ranked).collect()}
    assert got == {"API": (0.3, "both"), "node": (0.2, "yake"), "Graph": (0.5, "textrank")}


def test_consensus(spark):
    rows = [("a", 0.8, True, 0.9), ("b", 0.8, False, 0.1), ("c", 0.2, True, 0.5)]
    got = {r.term: r for r in ranking.consensus(spark.createDataFrame(rows, "term string, generator_score double, validator_approved boolean, ranker_score double")).collect()}
    assert got["a"].models_agreed == 3 and got["a"].score == pytest.approx(1.7 / 3)
    assert not got["b"].accepted and got["b"].reason == "insufficient_agreement: 1/2"
    assert got["c"].accepted and got["c"].models_agreed == 2


def test_ranges_first_and_last(spark):
    points = spark.createDataFrame([(5,), (99,), (150,), (-3,), (None,)], "page long")
    spans = spark.createDataFrame([(0, 1, 6), (1, 4, 9), (2, -300, 300), (3, 8, 2), (4, None, 99)], "idx int, start int, end int")
    for last, idx in ((True, 2), (False, 0)):
        for cell in (None, 1, 7, 50, 1000):
            got = documents.in_intervals(points, spans, "page", "start", "end", "idx", last, cell=cell).collect()
            assert sorted((r.page, r.idx) for r in got) == [(-3, 2), (5, idx), (99, 2), (150, 2)]


def test_diagrams(spark):
    text = "intro\n+--+\n|  |\n+--+\nend\nFigure 2: A tree\narchitecture diagram"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    block = documents.art_blocks(docs).first()
    assert (block.first_line, block.n_lines, block.caption) == (2, 3, "ASCII Diagram: intro")
    assert {(r.line_no, r.type, r.caption) for r in documents.labelled_diagrams(docs).collect()} == {(6, "figure", "A tree"), (7, "architecture", "architecture diagram")}


def test_density_clusters(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.99, 0.05]), (1, 2, [0.0, 1.0]), (2, 0, [1.0, 0.0])]
    got = cluster.density_clusters(spark.createDataFrame(rows, "doc_id long, pos long, v array<double>"), "doc_id", "pos", "v").collect()
    assert {(r.doc_id, r.pos): r.label for r in got} == {(1, 0): 0, (1, 1): 0, (1, 2): -1, (2, 0): -1}


def test_density_clusters_in_blocks(spark, tmp_path):
    """Every vector has a row, whatever its id, and blocks change nothing."""
    import math
    import random

    from textloom.queries import QUERIES

    r = random.Random(5)
    rows = [(1980 + i, [r.gauss(0, 1) for _ in range(4)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = {i: [x / math.hypot(*v) for x in v] for i, v, _ in rows}

    def expected(similarity):
        out = {}
        for k in range(3):
            ids, n = [i for i, _, y in rows if y == k], 0
            for i in ids:
                if (k, i) in out:
                    continue
                members, todo = {i}, [i]
                while todo:
                    a = todo.pop()
                    new = {b for b in ids if b not in members and sum(x * y for x, y in zip(unit[a], unit[b], strict=True)) >= similarity}
                    members |= new
                    todo += new
                out |= {(k, m): n if len(members) > 1 else -1 for m in members}
                n += len(members) > 1
        return out

    as_dict = lambda d: {(x[0], x[1]): x[2] for x in d.collect()}
    assert as_dict(QUERIES["v14_similarity_clusters"](spark, str(tmp_path))) == expected(0.5)
    assert len(set(expected(0.9).values())) > 3
    assert as_dict(cluster.density_clusters(df, "label", "vec_id", "embedding", 0.9, block=7)) == expected(0.9)


def test_cascade_tiers(spark):
    terms = spark.createDataFrame([("API gateway",), ("www",), ("anything",), ("model says",)], "term string")
    aliases = classify.build_aliases(spark.createDataFrame([("api gateway", "concept", 0), ("api-gateway", "keyword", 1)], "term string, kind string, pos int"))

    def model(df):
        assert "www" in {r.term for r in df.collect()} and "API gateway" not in {r.term for r in df.collect()}
        return df.withColumn("predicted", F.when(F.col("term") == "model says", "concept").otherwise("unknown")).withColumn("confidence", F.lit(0.9))

    got = {r.term: (r.classification, r.tier) for r in classify.cascade(terms, "term", aliases, model).collect()}
    assert got == {"API gateway": ("concept", 1), "www": ("rejected", 3), "anything": ("unknown", 3), "model says": ("concept", 2)}


def test_service_retries(spark):
    waits = []
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return {"n": x}

    assert services.with_retries(flaky, 3, 0.5, waits.append)(1) == {"n": 1} and waits == [0.5, 1.0]

    def refused(x):
        raise services.ClientError

    with pytest.raises(services.ClientError):
        services.with_retries(refused, 3, 0.5, waits.append)(1)


def test_limit_does_not_commute(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.8)], "k int, pos int, s double")
    assert [r.pos for r in ranking.limit_then_filter(df, "k", ["pos"], 2, F.col("s") > 0.5).collect()] == [2]


def test_missing_concept_file(spark, tmp_path):
    assert files.load_concepts(spark, str(tmp_path / "none"), "a int").isEmpty()


def test_stream_twins(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "events")
    batch.repartition(3).write.parquet(folder)
    stream = events.run_to_table(spark, events.sliding(events.read_stream(spark, folder)), "twin", "complete", str(tmp_path / "state"))
    assert sorted(map(tuple, stream.select("start", "event_type", "n").collect())) == sorted(map(tuple, events.sliding(batch).select("start", "event_type", "n").collect()))
