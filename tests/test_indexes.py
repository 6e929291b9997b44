"""Phrase automata, q-gram joins, ranks of all rows, and the stored indexes, against plain computations."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import grams, lexical, phrases, ranking, text_index, vector_index
from textloom.operators.vectors import top_similar


def words(r, n, letters="ab c"):
    return "".join(r.choice(letters) for _ in range(n))


@pytest.mark.parametrize("most", [phrases.TABLE, 600])
def test_automaton(most, monkeypatch):
    """Overlaps, phrases in phrases, texts across pieces."""
    monkeypatch.setattr(phrases, "PIECE", 16)
    r = random.Random(1)
    listed = sorted({words(r, r.randrange(1, 9)) for _ in range(60)} | {"é", "ab", "b", "aé漢", "\x00"})
    for text in ["", "a", "aé漢b", *(words(r, n, "abc é漢\x00") for n in (5, 15, 16, 17, 100, 3000))]:
        data = text.encode()
        got = Counter()
        for automaton, numbers in phrases.automata([p.encode() for p in listed], most):
            at, which = automaton.found(np.frombuffer(data, np.uint8))
            got.update((a, listed[numbers[w]]) for a, w in zip(at.tolist(), which.tolist(), strict=True))
        wanted = Counter((i + len(p.encode()) - 1, p) for p in listed for i in range(len(data)) if data.startswith(p.encode(), i))
        assert got == wanted


@pytest.mark.parametrize("block", [phrases.BLOCK, 40])
def test_holding(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "STEP", 300)
    r = random.Random(2)
    texts = [(i, words(r, r.randrange(40), "abc é")) for i in range(300)] + [(300, None), (301, ""), (302, "x" * 5000 + "needle"), (302, "x" * 10)]
    listed = sorted({words(r, r.randrange(1, 6), "abc é") for _ in range(30)}) + ["needle", "not there", "x"]
    docs = spark.createDataFrame(texts, "id long, t string")
    asked = spark.createDataFrame([(p,) for p in [*listed, *listed[:3], "", None]], "p string")
    got = phrases.holding(docs, asked, "id", "t", "p", block=block).collect()
    wanted = [(i, p) for i, t in texts for p in listed if t and p in t]
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert phrases.holding(docs, asked.where("p is null"), "id", "t", "p").count() == 0 and phrases.holding(docs.where("id < 0"), asked, "id", "t", "p").count() == 0


def test_containing(spark):
    r = random.Random(3)
    texts = sorted({words(r, r.randrange(30), "abcd ") for _ in range(200)})
    patterns = sorted({words(r, r.randrange(1, 7), "abcd ") for _ in range(80)}) + ["zzz", ""]
    left, right = (spark.createDataFrame([(x,) for x in [*rows, None, rows[0]]], f"{c} string") for c, rows in (("p", patterns), ("t", texts)))
    got = grams.containing(left, right, "p", "t")
    assert sorted(map(tuple, got.collect())) == sorted((p, t) for p in patterns for t in texts if p and p in t)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_similar(spark, edits):
    r = random.Random(4)
    rows = sorted({words(r, r.randrange(12), "abc") for _ in range(150)})
    a, b = rows[::2], rows[1::2] + rows[:20]
    got = grams.similar(spark.createDataFrame([(x,) for x in [*a, None]], "a string"), spark.createDataFrame([(x,) for x in [*b, b[0]]], "b string"), "a", "b", edits)
    pairs = {(x, y): lexical.edits(x, y) for x in a for y in b}
    assert sorted(map(tuple, got.collect())) == sorted((*p, n) for p, n in pairs.items() if n <= edits)


def test_ranks_of_all_rows(spark):
    r = random.Random(5)
    rows = [(r.choice([0, 0, 0, 1, None]), r.randrange(20), i) for i in range(500)]
    got = ranking.ranked(spark.createDataFrame(rows, "k long, x long, i long"), ["k"], [F.desc("x"), "i"]).collect()
    wanted = {}
    for k, own in itertools.groupby(sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, -t[1], t[2])), key=lambda t: t[0]):
        wanted |= {t[2]: n for n, t in enumerate(own, 1)}
    known = {t[2] for t in rows if t[0] is not None}
    assert {r.i: r.rank for r in got if r.i in known} == {i: n for i, n in wanted.items() if i in known}


def test_packed_numbers():
    for x in ([], [0], [127, 128, 0, 2**40, 1, 16_383, 16_384]):
        assert text_index.unpack(text_index.pack(np.array(x, np.int64))).tolist() == x


@pytest.mark.parametrize(("block", "first"), [(256, 4), (3, 1)])
def test_search_of_the_index(spark, tmp_path, block, first):
    """Blocks that can't matter are left out, and the rows are those of scoring everything."""
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [(i * 7, " ".join(r.choices(vocabulary, weights, k=r.randrange(1, 60)))) for i in range(400)] + [(-5, ""), (10**12, "W0 w1 w59")]
    asked = [(0, "w0 w59"), (1, "w5 w5 w40 W30"), (2, "absent"), (3, " ".join(vocabulary)), (4, "")]
    docs, queries = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    path = str(tmp_path / "index")
    text_index.build(docs, path, buckets=5, block=block)
    got = text_index.search(spark, path, queries, 7, first=first).collect()
    wanted = ranking.top_by(lexical.bm25(docs, queries), ["query_id"], [F.desc(F.round("score", 6)), "doc_id"], 7).collect()
    assert sorted((x.query_id, x.rank, x.doc_id, round(x.score, 5)) for x in got) == sorted((x.query_id, x.rank, x.doc_id, round(x.score, 5)) for x in wanted)
    assert len({x.query_id for x in got}) == 3


def test_only_folders_of_asked_words_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    text_index.build(spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta epsilon")], "doc_id long, text string"), path, buckets=50)
    for p in (tmp_path / "index" / "blocks").glob("bucket=*"):
        kept = {x.term for x in spark.read.parquet(str(p)).collect()}
        if "alpha" not in kept:
            for f in p.glob("*.parquet"):
                f.write_bytes(b"damaged")
    assert [tuple(x)[:2] for x in text_index.search(spark, path, spark.createDataFrame([(9, "Alpha")], "query_id long, text string")).collect()] == [(9, 1)]


def test_recall_of_the_vector_index(spark, tmp_path):
    r = np.random.default_rng(7)
    centres = r.standard_normal((30, 24))
    x = np.concatenate([centres[i % 30] + 0.5 * r.standard_normal(24) for i in range(3000)]).reshape(3000, 24)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24)], "id long, v array<double>")
    path = str(tmp_path / "vectors")
    vector_index.build(df, path, "id", "v", sample=1000)
    assert vector_index.entries(spark, path).count() == 3001
    queries = df.where("id % 100 = 0")
    exact = {(q.query, q.match) for q in top_similar(queries.where("v is not null"), df.where("v is not null"), "id", "id", "v", 10, -1.0).collect()}
    got = vector_index.search(spark, path, queries, "id", "v", 10)
    rows = got.collect()
    assert len({(q.query, q.match) for q in rows} & exact) >= 0.9 * len(exact)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(q.score == pytest.approx(float(u[q.query] @ u[q.match])) for q in rows if q.match < 3000 and q.query < 3000)
    whole = {(q.query, q.match) for q in vector_index.search(spark, path, queries.where("v is not null"), "id", "v", 10, probes=None).collect()}
    assert whole == exact


def test_index_of_little(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    vector_index.build(df, str(tmp_path / "two"), "id", "v")
    got = vector_index.search(spark, str(tmp_path / "two"), df, "id", "v", 3).collect()
    assert sorted((q.query, q.match, round(q.score, 6)) for q in got) == [(1, 2, 0.0), (2, 1, 0.0)]
    vector_index.build(df.where("id > 5"), str(tmp_path / "none"), "id", "v")
    assert vector_index.search(spark, str(tmp_path / "none"), df, "id", "v", 3).count() == 0
    assert math.isclose(sum(q.score for q in got), 0.0, abs_tol=1e-9)


@pytest.mark.parametrize("segment", [1, 200])
def test_segments_of_the_index(spark, tmp_path, monkeypatch, segment):
    """Documents are scored where their postings lie: no row for each posting of a query is shuffled, and segments and packs of queries change no result."""
    monkeypatch.setattr(text_index, "ASKED", 3)
    r = random.Random(8)
    docs = spark.createDataFrame([(i * 3, " ".join(r.choices([f"w{j}" for j in range(30)], k=r.randrange(1, 30)))) for i in range(120)] + [(1, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "w0 w29 w3"), (1, "w5"), (2, "w7 w8 w9 w10")], "query_id long, text string")
    path = str(tmp_path / "index")
    text_index.build(docs, path, buckets=3, block=4, segment=segment)
    got = text_index.search(spark, path, queries, 9)
    assert "sum(part" not in got._jdf.queryExecution().optimizedPlan().toString()
    wanted = ranking.top_by(lexical.bm25(docs, queries), ["query_id"], [F.desc(F.round("score", 6)), "doc_id"], 9).collect()
    assert sorted((x.query_id, x.rank, x.doc_id, round(x.score, 5)) for x in got.collect()) == sorted((x.query_id, x.rank, x.doc_id, round(x.score, 5)) for x in wanted)
