"""The corpus pipeline, stage by stage, against brute force."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
from test_leaks import brute
from test_llm import IDENTITY, ODD, frame, linked, python_feistel

import corpus_pipeline
from textloom.llm import quality
from textloom.llm.common import materialize, table


def kept_by_model(spark, docs, sf_dir):
    """Rows whose score, computed one text at a time, reaches the threshold."""
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), table(spark, sf_dir, "labels"))
    return [r for r in docs if model.scores(np.array([quality.features(r[1] or "")]))[0] >= 0.3]


def copies(i, text, rate):
    """The smallest k with P(X <= k) >= u, summed over parts of a mean of 16 at most."""
    key = str(i) if i is not None else hashlib.md5((text or "").encode()).hexdigest()
    parts = max(1, math.ceil(rate / 16))
    total = 0
    for part in range(parts):
        u = (int(hashlib.md5(f"0:{key}:{part}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rate / parts)
        c = p
        while c < u and k < 80:
            k += 1
            p *= rate / parts / k
            c += p
        total += k
    return total


def mixed(docs):
    """How often each row comes out."""
    size = Counter()
    for _, t, s in docs:
        size[s or ""] += len((t or "").encode())
    with_bytes = [s for s, n in size.items() if n]
    rate = {s: sum(size.values()) / len(with_bytes) / n if n else 0.0 for s, n in size.items()}
    out = Counter()
    for i, t, s in docs:
        if n := copies(i, t, rate[s or ""]):
            out[i, t, s] += n
    return out


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def check(spark, docs, sf_dir):
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    seen = [rows_of(docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir))
        if name != "sharding":
            assert docs.columns == columns
        seen.append(rows_of(docs))
    return seen, docs


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seen, last = check(spark, docs, sf_dir)
    start, good, unique, clean, mix, sharded = seen
    assert Counter(good) == Counter(kept_by_model(spark, start, sf_dir))
    assert sorted(i for i, _, _ in unique) == sorted(i for i, _, c in linked([r[:2] for r in good], 5, 80) if c == i)
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    leaking = {d for d, *_ in brute([r[:2] for r in unique], items)}
    assert leaking and Counter(clean) == Counter(r for r in unique if r[0] not in leaking)
    assert Counter(mix) == mixed(clean) and Counter(sharded) == Counter(mix)
    n = len(mix)
    wide = math.ceil(math.sqrt(n))
    high = math.ceil(n / wide)
    for r in last.collect():
        place = python_feistel(r.row_no, wide, high, 0)
        while place >= n:
            place = python_feistel(place, wide, high, 0)
        assert (r.shard, r.slot) == (place % 16, place // 16)
    assert sorted(r.row_no for r in last.collect()) == list(range(n))
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    wrong = [i for i in labels if (i in {r[0] for r in good}) != bool(labels[i])]
    assert len(wrong) <= 0.1 * len(labels)


def test_odd_documents(spark, sf_dir, tmp_path):
    """Null and repeated ids, null, empty and long texts, clashing columns, and an empty table go through every stage."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for rows in (ODD + IDENTITY, []):
        docs = frame(spark, rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            before = rows_of(docs)
            docs = materialize(spark, stage(spark, docs, str(tmp_path)))
            after = rows_of(docs)
            assert set(after) <= set(before) and (name == "sharding" or docs.columns == columns)
            if name == "ngram_jaccard_join":
                groups = {c for _, n, c in linked([r[:2] for r in before], 5, 80) if n and c is not None}
                assert {r[0] for r in after if r[0] is not None} >= groups
            if name == "source_mixing":
                assert Counter(after) == mixed(before)
    assert docs.count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
