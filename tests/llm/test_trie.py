"""The trie of conversation prefixes against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from textloom.llm import queries, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth string, node string, n_convs string, base string, seq string, kind string"


def frame(spark, rows):
    """Conversations with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(rows):
    """All nodes, each from the conversations that start with it."""
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += own
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n, hot=0, long=0):
    """Conversations of a few different turns, so that beginnings are shared; `hot` of them are equal, one has `long` turns."""
    r = random.Random(seed)
    say = [("user", "a b c"), ("assistant", "a"), ("user", "  two\twords\x0b"), ("", ""), (None, None), ("user", None), ("system", "é 漢字\xa0x y"), ("u", "ser")]
    rows = []
    for c in range(n):
        for t in range(r.randrange(7)):
            rows.append((c, t, *r.choice(say[: 2 + t])))
    rows += [(1000 + c, t, "user", f"hot {t}") for c in range(hot) for t in range(5)]
    rows += [(1500, t, "user", f"turn {t % 7}") for t in range(long)]
    r.shuffle(rows)
    return rows


ODD = [
    (None, 0, "user", "belongs to none"), (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "second"), (2, 3, "user", "b"), (2, 3, "user", "a"), (2, 3, "assistant", "a"),
    (21, 0, "user", "no base"), (21, 1, "user", "no base"), (40, 0, None, None), (41, 0, "", ""), (41, 1, "user", "x" * 50_000), (-5, 0, "user", "negative"), (43, 0, "user", "one turn, absent at last"),
]


@pytest.mark.parametrize("rows", [ODD, made(1, 80), made(2, 300, hot=200), made(3, 60, long=300), made(4, 1, hot=400), [(7, 0, "user", "only")]])
@pytest.mark.parametrize("part", [16_000_000, 400])
def test_nodes(spark, rows, part, monkeypatch):
    """Whole runs, and runs so short that equal sequences and their ids lie in several."""
    monkeypatch.setattr(trie, "PART_BYTES", part)
    monkeypatch.setattr(trie, "ENDS", 3)
    got = trie.nodes(frame(spark, rows))
    assert got.columns == trie.NODE
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_no_conversations(spark):
    assert trie.nodes(frame(spark, ODD).where("conv_id > 1000")).count() == 0
    assert trie.nodes(frame(spark, ODD[:1])).count() == 0


def test_all_conversations_of_the_table(spark, sf_dir):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf_dir}/conversations.parquet'").fetchall()
    got = queries.QUERIES["op12_trie"](spark, sf_dir)
    assert sorted(map(tuple, got.select(*trie.NODE).collect()), key=repr) == brute(rows)


def test_tree_has_branch_end_and_leaf_points_only():
    r = random.Random(5)
    unit = [bytes([i]) * trie.DIGEST + i.to_bytes(4, "big") for i in range(3)]
    seqs = sorted({b"".join(r.choices(unit, k=r.randrange(9))) for _ in range(60)})
    tree = trie.Patricia(seqs, [[i] for i in range(len(seqs))])
    children = [sum(p == v for p in tree.parent) for v in range(len(tree.depth))]
    assert all(children[v] != 1 or tree.ends[v] >= 0 or tree.parent[v] < 0 for v in range(len(tree.depth)))
    assert tree.n[0] == len(seqs) and sorted(e for e in tree.ends if e >= 0) == list(range(len(seqs)))
