"""Density clusters at scale against the matrix form of the same hierarchy, and each of their parts against plain computations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import density
from textloom.operators.cluster import hierarchy_labels


def blobs(seed, sizes, dims=3, noise=20, spread=0.4):
    r = np.random.default_rng(seed)
    centres = r.uniform(-10, 10, (len(sizes), dims))
    x = np.concatenate([c + spread * r.standard_normal((n, dims)) for c, n in zip(centres, sizes, strict=True)] + [r.uniform(-12, 12, (noise, dims))])
    return x[r.permutation(len(x))]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def groups(labels):
    out = {}
    for i, label in enumerate(labels):
        if label >= 0:
            out.setdefault(label, set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize(("sizes", "least", "batch"), [((40, 30, 50), 5, 100_000), ((40, 30, 50), 5, 40), ((60,), 8, 100_000), ((15, 9, 12, 7, 20), 4, 30), ((3, 3), 4, 100_000)])
def test_clusters_of_exact_graphs(spark, sizes, least, batch):
    """All neighbours known: the clusters of the matrix, whether in one task or many. (With equal weights, of which a small `least` makes many, several trees are right.)"""
    x = blobs(1, sizes)
    got = density.clusters(frame(spark, x), "id", "v", least, k=len(x) - 1, trees=1, batch=batch, leaf=len(x)).collect()
    labels = np.full(len(x), -1)
    for r in got:
        labels[r.id] = r.cluster
    assert len(got) == len(x) and groups(labels) == groups(hierarchy_labels(distances(x), least))
    assert all(r.cluster == -1 or r.cluster == min(i for i in range(len(x)) if labels[i] == r.cluster) for r in got)
    assert all(0 < r.confidence <= 1 if r.cluster >= 0 else r.confidence == 0 for r in got)


def test_equal_vectors(spark):
    """A third of the rows are copies of one: the clusters of the matrix, in which each copy is a row."""
    x = blobs(2, (30, 25), noise=10)
    x = np.concatenate([x, np.repeat(x[:1], 33, axis=0), np.repeat(x[5:6], 3, axis=0)])
    got = density.clusters(frame(spark, x), "id", "v", 6, k=len(x), trees=1, leaf=len(x)).collect()
    labels = np.full(len(x), -1)
    for r in got:
        labels[r.id] = r.cluster
    assert groups(labels) == groups(hierarchy_labels(distances(x), 6))


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (None, [1.0, 1.0]), (2, None), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert {(r.id, r.cluster) for r in density.clusters(df, "id", "v", 5).collect()} == {(1, -1), (3, -1)}
    assert density.clusters(df.where("id > 5"), "id", "v", 5).count() == 0
    assert {r.cluster for r in density.clusters(df, "id", "v", 2).collect()} == {1}


def test_recall_of_the_graph(spark):
    """Of small leaves and runs, the trees find nine tenths of the nearest ten."""
    x = blobs(3, (500, 400, 600), dims=6, noise=500, spread=1.5)
    got = density.neighbours(frame(spark, x), "id", "v", 10, trees=8, sample=600, run=300, leaf=150).collect()
    exact = np.argsort(distances(x) + np.diag(np.full(len(x), np.inf)), axis=1)[:, :10]
    found = {r.id: [e.match for e in r.near] for r in got}
    assert len(found) == len(x) and sum(len(set(found[i]) & set(exact[i].tolist())) for i in range(len(x))) >= 0.9 * exact.size
    assert all(e.distance == pytest.approx(np.linalg.norm(x[r.id] - x[e.match])) for r in got[:50] for e in r.near)
    assert all([e.distance for e in r.near] == sorted(e.distance for e in r.near) for r in got)


@pytest.mark.parametrize("batch", [100_000, 50])
def test_spanning_forest(spark, batch):
    r = np.random.default_rng(4)
    edges = [(int(u), int(v), float(w)) for (u, v), w in zip(r.integers(0, 120, (900, 2)), r.integers(1, 60, 900), strict=True)] + [(200, 201, 5.0), (201, 200, 4.0), (300, 300, 1.0)]
    got = density.spanning_forest(spark.createDataFrame(edges, "u long, v long, w double").repartition(6), batch).collect()
    parent = list(range(400))
    kept = []
    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in edges):
        i, j = density._top(parent, u), density._top(parent, v)
        if i != j:
            parent[i] = j
            kept.append((u, v, w))
    assert sorted(map(tuple, got)) == sorted(kept)


def test_topics_of_documents(spark, sf_dir):
    """Most rows of the embeddings' labels are found again."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = density.clusters(e, "vec_id", "embedding", 5).join(e.select("vec_id", "label"), "vec_id")
    assert got.count() == e.count()
    assert got.where("cluster >= 0").groupBy("cluster").agg(F.count_distinct("label")).count() >= 1
