"""Repeated lines and fill-in-the-middle rows against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_llm import IDENTITY, LONG, LOW, ODD, frame, prose
from pyspark.sql import functions as F

from textloom.llm import linedup, middle

# ---- lines -------------------------------------------------------------------------------------------------------


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def left(docs, least=10):
    """(doc_id, lines, dropped, digest, kept) by a dictionary of all lines."""
    owner = {}
    for i, t in docs:
        if i is not None:
            for x in (t or "").split("\n"):
                owner[key(x)] = min(owner.get(key(x), i), i)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < least or key(x) not in owner or i is not None and owner[key(x)] == i]
        text = "\n".join(kept)
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=repr)


LINES = [
    "A line of text", "  a LINE of text\t", "a line of text\x0b", "\xa0a line of text", "short", "ten chars.", "nine char", "", " ", "é ü ñ 漢字 漢字 x", "É ü ñ 漢字 漢字 x", "same same same same", "\r\n carriage return", "x" * 70_000,
]


def made(seed, n):
    r = random.Random(seed)
    return [(r.choice([None, *range(n // 2)]), "\n".join(r.choice(LINES[:-1]) + r.choice(["", "", f" {r.randrange(20)}"]) for _ in range(r.randrange(8)))) for _ in range(n)] + [(n + 1, LINES[-1]), (n, f"{LINES[-1]}\n{LINES[-1]}\nleft")]


@pytest.mark.parametrize("docs", [[x[:2] for x in ODD], [x[:2] for x in IDENTITY], made(1, 150), [(5, "the same line here\nother")] * 60 + [(2, "the same line here")] * 3 + [(None, "the same line here")] * 5])
@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (7, 2)])
def test_lines(spark, docs, batches, fanout):
    df = frame(spark, [(i, t, "a") for i, t in docs])
    got = linedup.dedup(df, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"]
    assert sorted(map(tuple, got.collect()), key=repr) == left(docs)


def test_shorter_keys_and_empty(spark, odd_lines):
    assert sorted(map(tuple, linedup.dedup(odd_lines, least=1, batches=3).collect()), key=repr) == left([(r.doc_id, r.text) for r in odd_lines.collect()], 1)
    assert linedup.dedup(odd_lines.where("doc_id > 10000")).count() == 0


@pytest.fixture
def odd_lines(spark):
    return frame(spark, [(i, t, "a") for i, t in made(2, 60)])


def test_runs_are_levelled(spark, odd_lines):
    """No hash is in two runs, owners are the least ids, and there are few runs."""
    lines = linedup.lines_of(odd_lines.where("doc_id is not null"), 1)
    runs = linedup.Runs(spark, fanout=2, buckets=3)
    for b in range(7):
        runs.append(lines.where(F.col("doc_id").between(b * 10, b * 10 + 9)))
        assert max(map(len, runs.levels)) < 2 and len(runs.tables()) == (b + 1).bit_count()
    rows = [tuple(r) for t in runs.tables() for r in t.select("one", "two", "owner").collect()]
    owner = {}
    for r in lines.collect():
        owner[r.one, r.two] = min(owner.get((r.one, r.two), r.doc_id), r.doc_id)
    assert len(rows) == len(owner) and {r[:2]: r[2] for r in rows} == owner
    names = [name for level in runs.levels for name, _ in level]
    runs.drop()
    assert not set(names) & {t.name for t in spark.catalog.listTables()}


def test_runs_are_merged_without_a_shuffle_of_theirs(spark, odd_lines):
    lines = linedup.lines_of(odd_lines, 1)
    runs = linedup.Runs(spark)
    runs.append(lines.where("doc_id < 20"))
    with runs._merging():
        fresh = lines.where("known").groupBy(*linedup.KEY).agg(F.min("doc_id").alias("owner")).join(runs.tables()[0].hint("merge"), linedup.KEY, "left_anti")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    runs.drop()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and plan.index("HashAggregate") > plan.index("SortMergeJoin")


# ---- fill in the middle ------------------------------------------------------------------------------------------


def expected(i, t, rule=middle.Rule()):
    t = t or ""
    name = hashlib.sha256(t.encode()).hexdigest() if i is None else str(i)
    digest = hashlib.sha256(f"{rule.seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(t)
    p, s, m = rule.sentinels
    if not t or any(x in t for x in (p, s, m)) or h3 % 100 >= 100 - rule.plain:
        return i, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = t[:a], t[a:b], t[b:]
    return (i, n, "spm", a, b - a, s + suf + p + pre + m + mid) if h4 % 100 < rule.suffix_first else (i, n, "psm", a, b - a, p + pre + s + suf + m + mid)


def texts():
    r = random.Random(4)
    signs = ["a", "é", "漢", "😀", "<", "P", "S", "M", ">", "<P>", "\n", " ", "\x00", "́"]
    return [(i, "".join(r.choice(signs) for _ in range(r.randrange(60)))) for i in range(400)] + [(1000, "漢😀é" * 40_000), (1001, "<P"), (1002, "<S>")]


@pytest.mark.parametrize("docs", [[x[:2] for x in ODD], [x[:2] for x in IDENTITY], texts()])
@pytest.mark.parametrize("rule", [middle.Rule(), middle.Rule("[p]", "[s]", "[m]", plain=0, suffix_first=50, seed=7)])
def test_middle(spark, docs, rule):
    df = frame(spark, [(i, t, "a") for i, t in docs])
    got = middle.transform(df, rule).withColumn("text", middle.restored(F.col("output"), F.col("form"), rule)).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(expected(i, t, rule) for i, t in docs)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t in docs)
    assert len({r.form for r in got}) == 3 or rule.plain == 0 or len(docs) < 100


def test_digests(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall() + [(None, "x"), (-3, LONG)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = middle.digest(frame(spark, [(i, t, "a") for i, t in rows]))
    wanted = [(*x[:5], sha(x[5]), sha(t or "")) for (i, t) in rows for x in [expected(i, t)]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)
    assert middle.digest(frame(spark, [(1, prose(1, 3), "a")]).where("doc_id > 1")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_rank_and_select(n):
    r = random.Random(n)
    data = "".join(r.choice("aé漢😀") for _ in range(n)).encode()
    bits = middle.Boundaries(np.frombuffer(data, np.uint8))
    begins = [i for i, c in enumerate(data) if c & 0xC0 != 0x80]
    assert bits.before[-1] == n and bits.rank(np.array([len(data)])).tolist() == [n]
    assert bits.rank(np.arange(len(data) + 1)).tolist() == np.searchsorted(begins, np.arange(len(data) + 1)).tolist()
    assert not n or bits.select(np.arange(n)).tolist() == begins
