"""The trie of conversation prefixes: rebuilt conversations are sorted, a Patricia tree is built over each run of them, and unary nodes come from its edges."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialize, shuffle_parts

#: Bytes of a turn in a sequence: md5 of its role and text, and the number of words of its text.
DIGEST, UNIT = 16, 20

#: Bytes of sequences that one task builds a tree over.
PART_BYTES = 16_000_000

#: Ids of members that one row of ends holds.
ENDS = 100_000

NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

#: Rows that a task gives: whole nodes; nodes whose parent lies on the first or last path of the run; nodes on these paths, as far as the run knows them; ids of conversations that end there.
WHOLE, HANGING, PATH, ENDING = range(4)
PARTIAL = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary, path long, words long, ids string"


def rebuilt(conversations: DataFrame, period: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, seq): each conversation c after the first h turns of conversation c - c % period took the place of its own; h = crc32(c) % shared. seq has UNIT bytes for each turn.

    Turns are ordered by (turn, digest of role and text), null first. One shuffle of digests; the turns of one
    conversation are one value (UNIT bytes each, no texts).
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    code = F.concat(digest, F.lpad(F.hex(words.cast("long")), 8, "0"))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    turns = conversations.where("conv_id is not null").select((conv - conv % period).alias("base"), conv.alias("conv_id"), F.struct(turn.alias("turn"), code.alias("code")).alias("item"))
    # turns of a base and of the conversations that share its head are brought together once
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.transform(F.sort_array(F.collect_list("item")), lambda x: x["code"]).alias("codes"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("codes", 1, shared - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    parts = own.select("conv_id", "codes", F.coalesce(head, F.array().cast("array<string>")).alias("head"), h.alias("h"))
    rest = F.slice("codes", F.col("h") + 1, F.greatest(F.size("codes") - F.col("h"), F.lit(0)))
    return parts.select("conv_id", F.unhex(F.array_join(F.concat(F.slice("head", F.lit(1), F.col("h")), rest), "")).alias("seq"))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // UNIT
    i = 0
    while a[i : i + UNIT] == b[i : i + UNIT]:
        i += UNIT
    return i // UNIT


def prefix_names(seq: bytes) -> list[bytes]:
    """A name for each prefix of the sequence, the empty one first."""
    h = hashlib.blake2b(digest_size=DIGEST)
    out = [h.digest()]
    for i in range(0, len(seq), UNIT):
        h.update(seq[i : i + UNIT])
        out.append(h.digest())
    return out


class Patricia:
    """The compressed tree over distinct sorted sequences: nodes where sequences branch, end or are leaves.

    A node is on a path if its interval of sequences has the first or the last one of the run: other runs may have
    members of it, so what hangs from it is only summed. All other nodes are complete.
    """

    def __init__(self, seqs: list[bytes], members: list[list[int]]) -> None:
        self.seqs, self.members = seqs, members
        words = np.frombuffer(b"".join(seqs), np.dtype([("digest", f"V{DIGEST}"), ("words", ">u4")]))["words"].astype(np.int64)
        self.upto = np.concatenate([[0], np.cumsum(words)])  # words of all turns before each
        self.begins = np.cumsum([0] + [len(s) // UNIT for s in seqs])
        self.depth, self.first, self.parent, self.ends, self.on_path = [], [], [], [], []
        self.n, self.least, self.children, self.leaves, self.saved = [], [], [], [], []
        self._build()

    def _new(self, depth: int, first: int) -> int:
        for column, value in ((self.depth, depth), (self.first, first), (self.parent, -1), (self.ends, -1), (self.on_path, False), (self.n, 0), (self.least, None), (self.children, 0), (self.leaves, 0), (self.saved, 0)):
            column.append(value)
        return len(self.depth) - 1

    def _member(self, v: int, n: int, least: int) -> None:
        self.n[v] += n
        self.least[v] = least if self.least[v] is None else min(least, self.least[v])

    def _close(self, v: int, p: int, upto: list[int], begins: list[int], last: bool) -> None:
        """Node v has all its members: it is counted in its parent."""
        self.parent[v] = p
        self._member(p, self.n[v], self.least[v])
        self.on_path[v] = last or self.first[v] == 0
        if self.on_path[v]:
            return
        at = begins[self.first[v]]
        end, before, above = at + self.depth[v], at + self.depth[v] - 1, at + self.depth[p]
        self.leaves[v] = self.leaves[v] or 1
        self.saved[v] += (self.n[v] - 1) * (upto[end] - upto[before])
        self.children[p] += 1
        self.leaves[p] += self.leaves[v]
        self.saved[p] += self.saved[v] + (self.n[v] - 1) * (upto[before] - upto[above])

    def _build(self) -> None:
        upto, begins = self.upto.tolist(), self.begins.tolist()
        root = self._new(0, 0)
        self.on_path[root] = True
        open_ = [root]
        for g, seq in enumerate(self.seqs):
            common = common_turns(self.seqs[g - 1], seq) if g else 0
            while self.depth[open_[-1]] > common:
                v = open_.pop()
                if self.depth[open_[-1]] < common:
                    open_.append(self._new(common, self.first[v]))
                self._close(v, open_[-1], upto, begins, False)
            if len(seq) // UNIT > self.depth[open_[-1]]:
                open_.append(self._new(len(seq) // UNIT, g))
            self.ends[open_[-1]] = g
            self._member(open_[-1], len(self.members[g]), self.members[g][0])
        while len(open_) > 1:
            v = open_.pop()
            self._close(v, open_[-1], upto, begins, True)

    def sha_of_ends(self, v: int) -> str:
        g = self.ends[v]
        return NO_ENDS if g < 0 else hashlib.sha256(",".join(map(str, self.members[g])).encode()).hexdigest()

    def path(self, g: int) -> list[int]:
        """The nodes on the way to a sequence, from the root."""
        v = next(v for v in range(len(self.depth) - 1, -1, -1) if self.ends[v] == g)
        out = [v]
        while self.parent[out[-1]] >= 0:
            out.append(self.parent[out[-1]])
        return out[::-1]


def expanded(tree: Patricia, names: dict[int, bytes]) -> dict[str, list | np.ndarray]:
    """Columns of all nodes, unary ones too, that hang off the paths: each edge gives a node for each of its turns, whose saved tokens are those of the node below and a suffix sum over the edge."""
    v = np.flatnonzero(~np.array(tree.on_path))
    take = lambda column, t=np.int64: np.array([column[i] for i in v], t)
    parent, depth, n, least, first = (take(x) for x in (tree.parent, tree.depth, tree.n, tree.least, tree.first))
    above = np.array(tree.depth)[parent] if len(v) else depth
    long = depth - above
    at = np.repeat(np.arange(len(v)), long)
    d = np.arange(len(at)) - np.repeat(np.cumsum(long) - long, long) + above[at] + 1
    bottom, top = d == depth[at], d == above[at] + 1
    begin = tree.begins[first][at]
    parents = np.array([0 if x is None else x for x in tree.least], np.int64)[parent] if len(v) else parent
    hanging = top & np.array([p in names for p in parent], bool)[at]
    sha = np.array([tree.sha_of_ends(i) for i in v], object)
    return {
        "kind": np.where(hanging, HANGING, WHOLE), "conv_id": least[at], "depth": d, "parent_conv_id": np.where(top, parents[at], least[at]), "n_convs": n[at], "n_children": np.where(bottom, take(tree.children)[at], 1),
        "n_leaves": take(tree.leaves)[at], "saved_tokens": take(tree.saved)[at] + (n[at] - 1) * (tree.upto[begin + depth[at] - 1] - tree.upto[begin + d - 1]), "ends_sha256": np.where(bottom, sha[at], NO_ENDS) if len(v) else [],
        "node": [names[p] if h else None for p, h in zip(parent[at].tolist(), hanging.tolist(), strict=True)],
    }


def on_paths(tree: Patricia, run: int) -> tuple[dict[str, list], dict[str, list], dict[int, bytes]]:
    """Columns of the nodes on the first and last path, one for each turn; of what ends there; and the names of the path's nodes in the tree."""
    rows: dict[str, list] = {k: [] for k in ("path", "depth", "node", "parent", "words", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens")}
    ends: dict[str, list] = {k: [] for k in ("node", "conv_id", "ids")}
    names: dict[int, bytes] = {}
    seen: set[bytes] = set()
    last = len(tree.seqs) - 1
    for side, g in enumerate(dict.fromkeys((0, last))):
        hashes = prefix_names(tree.seqs[g])
        nodes = tree.path(g)
        names |= {v: hashes[tree.depth[v]] for v in nodes}
        words = np.diff(tree.upto[tree.begins[g] : tree.begins[g + 1] + 1]).tolist()
        below = iter(nodes)
        v = next(below)
        for d, name in enumerate(hashes):
            if d > tree.depth[v]:
                v = next(below)
            here = d == tree.depth[v]
            # nodes on both paths are counted on the first
            own = (tree.n[v], tree.least[v], *((tree.children[v], tree.leaves[v], tree.saved[v]) if here else (0, 0, 0))) if name not in seen else (0, None, 0, 0, 0)
            for k, x in zip(rows, (2 * run + side, d, name, hashes[d - 1] if d else None, words[d - 1] if d else 0, *own), strict=True):
                rows[k].append(x)
            if here and tree.ends[v] >= 0 and name not in seen:
                ids = tree.members[tree.ends[v]]
                for i in range(0, len(ids), ENDS):
                    for k, x in zip(ends, (name, ids[i], ",".join(map(str, ids[i : i + ENDS]))), strict=True):
                        ends[k].append(x)
            seen.add(name)
    return rows, ends, names


def _batches(columns: dict, kind: int | None, rows: int = 100_000):
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    n = len(columns["conv_id"])
    for i in range(0, n, rows):
        m = min(rows, n - i)
        arrays = []
        for field in PARTIAL.split(", "):
            name, t = field.split()
            if name in columns:
                arrays.append(pa.array(columns[name][i : i + m], types[t]))
            else:
                arrays.append(pa.array([kind] * m, types[t]) if name == "kind" else pa.nulls(m, types[t]))
        yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PARTIAL.split(", ")])


def _trees(batches):
    """One run of sorted (conv_id, seq): a tree over its distinct sequences."""
    seqs: list[bytes] = []
    members: list[list[int]] = []
    for batch in batches:
        for conv, seq in zip(batch.column("conv_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
            if seqs and seqs[-1] == seq:
                members[-1].append(conv)
            else:
                seqs.append(seq)
                members.append([conv])
    if seqs:
        tree = Patricia(seqs, members)
        rows, ends, names = on_paths(tree, TaskContext.get().partitionId())
        yield from _batches(expanded(tree, names), None)
        yield from _batches(rows, PATH)
        yield from _batches(ends, ENDING)


def _digests(batches):
    """(node, ends_sha256) from rows sorted by node and first id: the digest of a node's joined ids goes on from row to row."""
    node, h = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name == node:
                h.update(b",")
            else:
                if node is not None:
                    done.append((node, h.hexdigest()))
                node, h = name, hashlib.sha256()
            h.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["node", "ends_sha256"])


def _joined(partial: DataFrame) -> DataFrame:
    """The nodes on paths, one row each under the name of their prefix: what runs know of them is added up. Sums over a subtree go along each path from its end; a node counts on the first of its paths."""
    paths = partial.where(F.col("kind") == PATH).select("path", "depth", "node", "parent", "words", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = paths.groupBy("node").agg(F.min("path").alias("owner"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("words").alias("words"), F.min("conv_id").alias("conv_id"), *sums)
    forks = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("forks"))
    nodes = nodes.join(forks, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("forks", F.lit(0)))
    leaf = (F.col("n_children") == 0).cast("long")
    nodes = nodes.withColumn("own_leaves", F.col("n_leaves") + leaf).withColumn("own_saved", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
    nodes = materialize(partial.sparkSession, nodes.select("node", "owner", "depth", "parent", "conv_id", "n_convs", "n_children", "own_leaves", "own_saved"))
    from_end = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = lambda c: F.sum(F.when(F.col("owner") == F.col("path"), F.col(c)).otherwise(0)).over(from_end)
    along = paths.select("path", "node", "depth").join(nodes.select("node", "owner", "own_leaves", "own_saved"), "node").select("node", mine("own_leaves").alias("n_leaves"), mine("own_saved").alias("saved_tokens"))
    totals = along.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = partial.where(F.col("kind") == ENDING).select("node", "conv_id", "ids").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_digests, "node binary, ends_sha256 string")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(totals, "node").join(ends, "node", "left").join(above, "parent", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return materialize(partial.sparkSession, whole.select("node", *NODE), nodes)


def nodes(conversations: DataFrame, period: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of rebuilt conversations, the textless root included.

    All (sequence, conv_id) are sorted once, into runs of bounded bytes; equal sequences and common beginnings may lie
    in several runs. A task builds the compressed tree of its run and gives all of its nodes that no other run can
    have. Those on the paths to its first and last sequence are named by a hash of their prefix and added up by
    aggregation: two paths a run, of as many nodes as the sequence has turns. The ids that end at such a node are
    hashed in order, row by row.

    Null roles and texts are empty, a null turn comes first, rows without conv_id belong to no conversation; turns of
    one number are ordered by the digest of role and text; repeated turns all count; a conversation without turns of
    its own left may end at the root; an empty table gives an empty result; other columns are ignored.
    """
    spark = conversations.sparkSession
    seqs = materialize(spark, rebuilt(conversations, period, shared))
    size = seqs.agg(F.coalesce(F.sum(F.octet_length("seq") + 16), F.lit(0)).alias("n")).first().n
    parts = max(shuffle_parts(spark), -(-int(size) // PART_BYTES))
    runs = seqs.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    partial = materialize(spark, runs.mapInArrow(_trees, PARTIAL), seqs, by=["kind"])
    paths = _joined(partial)
    hanging = partial.where(F.col("kind") == HANGING).drop("parent_conv_id").join(paths.select("node", F.col("conv_id").alias("parent_conv_id")), "node")
    return partial.where(F.col("kind") == WHOLE).select(*NODE).unionByName(hanging.select(*NODE)).unionByName(paths.select(*NODE))
