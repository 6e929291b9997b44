"""Exact n-gram Jaccard join of documents: prefix filters under several global token orders, intersected, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.llm.common import ROW, discard, documents_of, materialize, row_identity, shuffle_parts, text_steps
from textloom.llm.components import components


@dataclass(frozen=True)
class Join:
    """Shingles of `words` words; two sets link at 100 * intersection >= percent * union. Document frequencies are counted for chunks of about `chunk` bytes of text in parts of about `part` tokens, block bounds the shingles that one task compares."""

    words: int = 3
    percent: int = 90
    orders: int = 3
    chunk: int = 16_000_000
    part: int = 16_000_000
    block: int = 2_000_000
    step: int = 2_000_000

    @property
    def least_size(self) -> int:
        """Smaller sets link to equal ones only: with one element more the similarity is n / (n + 1) at most."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 2**62

    def prefix(self, n: int) -> int:
        """Tokens of a set of n that must hold one of any linked set's prefix, in any order."""
        return n - -(-self.percent * n // 100) + 1


#: One seed an order: within a tier of document frequency, tokens are ordered by their hash with it.
ORDER_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)


def shingle_sets(batch: pa.RecordBatch, join: Join) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingles) of each text that has a word. Words are lower-cased in A-Z; fewer words than a shingle make one."""
    for row, _, data, offsets in text_steps(batch, step=join.step):
        _, _, words, bounds = H.words(data, offsets, H.FOLDED)
        p = H.prefix(words, H.BASE_WORDS)
        grams = H.mix(H.windows(p, join.words, H.BASE_WORDS) + H.U(join.words))
        back = H.powers(H.inverse(H.BASE_WORDS), len(p))
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b - a >= join.words:
                yield row + i, np.unique(grams[a : b - join.words + 1])
            elif b > a:
                yield row + i, H.mix((p[b : b + 1] - p[a : a + 1]) * back[a] + H.U(b - a))


#: Bytes of text for a shingle, about.
SHINGLE_BYTES = 6
#: A row of the exchange of counts, about: shingles of one chunk in one part.
ROW_TOKENS = 16


def _places(docs: DataFrame, join: Join) -> tuple[DataFrame, int]:
    """docs with the chunk that counts its shingles, and the number of bits that name a part; both follow from the counted bytes."""
    total = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n)
    bits = max(2 * shuffle_parts(docs.sparkSession), total // SHINGLE_BYTES // join.part).bit_length()
    chunks = max(1, -(-total // max(join.chunk, ROW_TOKENS * SHINGLE_BYTES << bits)))
    return docs.select(*ROW, "text", F.pmod(F.xxhash64(F.lit("chunk"), *ROW), F.lit(chunks)).alias("chunk")), bits


def _asked(tokens: np.ndarray, counts: np.ndarray, chunk: int, bits: int) -> pa.RecordBatch:
    """A chunk's distinct shingles, ascending, as rows of (part, chunk, cells, counts): the first bits of a shingle are its part, the next 32 its cell there."""
    part = (tokens >> H.U(64 - bits)).astype(np.int64)
    cells = ((tokens >> H.U(32 - bits)) & H.U(0xFFFFFFFF)).astype(np.uint32)
    edges = np.searchsorted(part, np.arange((1 << bits) + 1))
    met = np.flatnonzero(np.diff(edges))
    cut = lambda x: pa.array([x[edges[p] : edges[p + 1]].tobytes() for p in met.tolist()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(np.full(len(met), chunk)), cut(cells), cut(np.minimum(counts, 65535).astype(np.uint16))], ["part", "chunk", "cells", "counts"])


def count_cells(table: pa.Table) -> pa.Table:
    """Of one part, the answers (chunk, part, levels) to its rows: for each cell a byte, 0 where one document has it, else 1 + 4 * log2 of the documents. Cells that two shingles share count both: never too few."""
    cells = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("cells")])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("counts")])
    _, inverse = np.unique(cells, return_inverse=True)
    total = np.bincount(inverse, counts)
    level = np.where(total < 2, 0, 1 + np.floor(4 * np.log2(np.maximum(total, 2)))).astype(np.uint8)[inverse]
    ends = np.cumsum([len(x.as_py()) // 4 for x in table.column("cells")])
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "levels": pa.array([x.tobytes() for x in np.split(level, ends[:-1])], pa.binary())})


def _levels(placed: DataFrame, join: Join, bits: int) -> DataFrame:
    """(chunk, part, levels): how many documents have each distinct shingle of a chunk.

    Chunks ask parts: a shingle goes to the part of its hash once a chunk, however many documents have it there, and a
    byte comes back for it. So counts are complete whatever the size of the corpus, nothing is broadcast, and a frequent
    shingle has one row a chunk.
    """

    def run(batches):
        chunk, held = None, []

        def flush():
            return _asked(*np.unique(np.concatenate(held), return_counts=True), chunk, bits)

        for batch in batches:
            of = batch.column("chunk").to_numpy()
            for row, s in shingle_sets(batch.select(["text"]), join):
                if of[row] != chunk:
                    if held:
                        yield flush()
                    chunk, held = int(of[row]), []
                held.append(s)
        if held:
            yield flush()

    dealt = placed.select("chunk", "text").repartition("chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(run, "part int, chunk long, cells binary, counts binary").groupBy("part").applyInArrow(count_cells, "chunk long, part int, levels binary")


def prefixes(shingles: np.ndarray, join: Join, repeated: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """For each order, the prefix tokens that other documents may have; empty lists if one order has none.

    Tokens of one document come first, then the others by their frequency, rare ones first, and within a quarter octave by
    a hash: any function of a token is a valid global order. Where tokens of this document alone fill
    the prefix, no other set can reach the threshold.
    """
    n = join.prefix(len(shingles)) - int((~repeated).sum())
    if n <= 0:
        return []
    tokens = shingles[repeated]
    out = []
    for seed in ORDER_SEEDS[: join.orders]:
        order = np.lexsort((H.mix(tokens ^ H.U(seed)), level))[:n]
        out.append(tokens[order])
    return out if all(len(x) for x in out) else []


SETS = "doc_id long, known boolean, tag long, n long, sig1 long, sig2 long, prefixes array<binary>, shingles binary"
#: What names a set: its size and 128 bits of it.
CLASS = ["sig1", "sig2", "n"]


def _sets(placed: DataFrame, levels: DataFrame, join: Join) -> DataFrame:
    """A row a document: the size and a 128-bit signature of its set; its prefixes and the set itself only if it can have a partner."""
    names = [c.split()[0] for c in SETS.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in SETS.split(", ")])

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        rows, sets = [], []
        for first, batch in enumerate_rows(table):
            for row, s in shingle_sets(batch.select(["text"]), join):
                rows.append(first + row)
                sets.append(s)
        n, one, two = (np.zeros(table.num_rows, np.int64) for _ in range(3))
        tokens, kept = [None] * table.num_rows, [None] * table.num_rows
        if sets:
            answers = answers.sort_by("part")
            level = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in answers.column("levels")])
            distinct, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            if len(distinct) != len(level):
                raise ValueError("a chunk has other shingles than when it was counted")
            own = np.split(level[inverse], np.cumsum([len(s) for s in sets])[:-1])
            for row, s, lev in zip(rows, sets, own, strict=True):
                n[row] = len(s)
                one[row] = H.mix(s ^ H.U(0x452821E638D01377)).sum(dtype=np.uint64).astype(np.int64)
                two[row] = H.mix(s ^ H.U(0xBE5466CF34E90C6C)).sum(dtype=np.uint64).astype(np.int64)
                repeated = lev > 0
                if len(s) >= join.least_size and len(s) - repeated.sum() < join.prefix(len(s)):
                    found = prefixes(s, join, repeated, lev[repeated])
                    if found:
                        tokens[row], kept[row] = [x.tobytes() for x in found], s.tobytes()
        columns = [*(table.column(c) for c in ROW), pa.array(n), pa.array(one), pa.array(two), pa.array(tokens, pa.list_(pa.binary())), pa.array(kept, pa.binary())]
        return pa.table(columns, schema=schema).select(names)

    return placed.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(run, SETS)


def enumerate_rows(table: pa.Table) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches of a table, each with the number of rows before it."""
    before = 0
    for batch in table.to_batches():
        yield before, batch
        before += batch.num_rows


def _first_tokens(reps: DataFrame) -> DataFrame:
    """(rep, token) of the first order's prefixes."""

    def run(batches):
        for batch in batches:
            for rep, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.frombuffer(lists[0], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), rep)), pa.array(tokens)], ["rep", "token"])

    return reps.select("node", "prefixes").mapInArrow(run, "rep long, token long")


def link_block(members: list[dict], join: Join, across: bool = False) -> list[tuple[int, int]]:
    """Links that join what is linked among members (rep, side, prefixes, shingles): a spanning forest, not all pairs.

    A pair is verified only if it shares prefix tokens in every order, its sizes allow the threshold, and nothing joins
    it yet. With `across`, members of two sides are compared across sides only.
    """
    m = len(members)
    if m < 2 or across and len({x["side"] for x in members}) < 2:
        return []
    reps = np.array([x["rep"] for x in members])
    sides = np.array([x["side"] for x in members])
    sets = [np.frombuffer(x["shingles"], np.uint64) for x in members]
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    ids = [flat[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mark = np.zeros(int(flat.max()) + 1, bool)
    posted, prefixes_of = [], []
    for order in range(len(members[0]["prefixes"])):
        tokens = [np.frombuffer(x["prefixes"][order], np.uint64) for x in members]
        owner = np.repeat(np.arange(m), [len(t) for t in tokens])
        values, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
        by = np.argsort(inverse, kind="stable")
        bounds = np.searchsorted(inverse[by], np.arange(len(values) + 1))
        posted.append((owner[by], bounds))
        splits = np.cumsum([len(t) for t in tokens])[:-1]
        prefixes_of.append(np.split(inverse, splits))
    group = np.arange(m)
    links = []
    for x in range(m - 1):
        wanted = (np.arange(m) > x) & (group != group[x]) & (100 * np.minimum(sizes, sizes[x]) >= join.percent * np.maximum(sizes, sizes[x]))
        if across:
            wanted &= sides != sides[x]
        for (owner, bounds), own in zip(posted, prefixes_of, strict=True):
            if not wanted.any():
                break
            shares = np.zeros(m, bool)
            for t in own[x].tolist():
                shares[owner[bounds[t] : bounds[t + 1]]] = True
            wanted &= shares
        candidates = np.flatnonzero(wanted)
        if not len(candidates):
            continue
        mark[ids[x]] = True
        both = np.array([int(mark[ids[y]].sum()) for y in candidates])
        mark[ids[x]] = False
        for y in candidates[100 * both >= join.percent * (sizes[x] + sizes[candidates] - both)].tolist():
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                links.append((int(reps[x]), int(reps[y])))
    return links


def _compare(placed: DataFrame, pairs: F.Column, join: Join) -> DataFrame:
    """Links (u, v) found in pairs of blocks: each member (root, side, node, prefixes, shingles) goes to the blocks that `pairs` lists, and blocks i <= j of a root meet in one task."""
    dealt = placed.withColumn("_other", F.explode(pairs)).select("root", F.least("side", "_other").alias("i"), F.greatest("side", "_other").alias("j"), "side", F.col("node").alias("rep"), "prefixes", "shingles")

    def run(batches):
        key, members, out = (0, 0, 0), [], []
        for batch in batches:
            for r in batch.to_pylist():
                if (own := (r["root"], r["i"], r["j"])) != key:
                    out += link_block(members, join, key[1] != key[2])
                    key, members = own, []
                members.append(r)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])
                out = []
        out += link_block(members, join, key[1] != key[2])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

    return dealt.repartition(2 * shuffle_parts(placed.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "rep").mapInArrow(run, "u long, v long")


def _blocks(grouped: DataFrame, join: Join, by: list[str]) -> DataFrame:
    """Adds the number of blocks of each group and each member's block."""
    blocks = grouped.groupBy(*by).agg(F.ceil(F.sum("n") / join.block).cast("int").alias("blocks"))
    return grouped.join(blocks, by).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _linked(reps: DataFrame, join: Join) -> DataFrame:
    """(node, root): components of verified links between sets (node, n, prefixes, shingles).

    Whoever shares a prefix token of the first order comes into one group (their transitive closure, found without any
    list of a token's documents), which is cut into blocks of bounded size. First each block is compared with itself and
    with its group's first block. That links the copies in a large group; after it only members outside of their group's
    largest component are compared with all blocks.
    """
    spark = reps.sparkSession
    posted = materialize(spark, _first_tokens(reps))
    least = posted.groupBy("token").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "v")
    shared = materialize(spark, posted.join(least, "token").where("rep != v").select(F.col("rep").alias("u"), "v").distinct(), posted)
    near = components(shared)
    grouped = _blocks(reps.join(near, "node"), join, ["root"])
    first = F.when(F.col("side") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("side")))
    links = materialize(spark, _compare(grouped, first, join), shared)
    if grouped.where("blocks > 2").limit(1).count():
        own = components(links)
        large = grouped.where("blocks > 2").select("root", "blocks", "node", "n", "prefixes", "shingles").join(own.withColumnRenamed("root", "own"), "node", "left").withColumn("own", F.coalesce("own", "node"))
        largest = large.groupBy("root", "own").agg(F.count(F.lit(1)).alias("_c")).groupBy("root").agg(F.max(F.struct("_c", "own")).alias("_m")).select("root", F.col("_m.own").alias("_largest"))
        marked = large.join(largest, "root").withColumn("rest", F.col("own") != F.col("_largest"))
        rest = _blocks(marked.where("rest").drop("blocks"), join, ["root"])
        counts = rest.select("root", F.col("blocks").alias("_k")).distinct()
        # blocks of the rest are 0 to k - 1, those of the largest component follow
        other = _blocks(marked.where(~F.col("rest")).drop("blocks").join(counts, "root"), join, ["root"])
        columns = ["root", "side", "node", "prefixes", "shingles", "_pairs"]
        everything = F.sequence(F.lit(0), F.col("blocks") - 1)
        of_rest = rest.join(other.select("root", F.col("blocks").alias("_b")).distinct(), "root", "left")
        of_rest = of_rest.withColumn("_pairs", F.sequence(F.lit(0), F.col("blocks") + F.coalesce("_b", F.lit(0)) - 1))
        of_other = other.withColumn("side", F.col("side") + F.col("_k")).withColumn("_pairs", F.sequence(F.lit(0), F.col("_k") - 1))
        more = _compare(of_rest.select(columns).unionByName(of_other.select(columns)), F.col("_pairs"), join)
        links = materialize(spark, links.unionByName(more), links, own)
    found = components(links)
    discard(spark, links, near)
    return found


def _components(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, known, tag, n, chief), a row a row of docs (which documents_of made); chief is the first row of its component: (unknown, doc_id, tag)."""
    spark = docs.sparkSession
    placed, bits = _places(docs, join)
    levels = materialize(spark, _levels(placed, join, bits))
    sets = materialize(spark, _sets(placed, levels, join), levels)
    whole = materialize(spark, sets.select(*ROW, *CLASS))
    chief = F.struct((~F.col("known")).alias("unknown"), "doc_id", "tag")
    classes = whole.where("n > 0").groupBy(*CLASS).agg(F.min(chief).alias("first"))
    candidates = sets.where("shingles is not null").join(classes, CLASS).where(chief == F.col("first"))
    # a number of its own for each set that may link, fixed by writing it
    reps = candidates.dropDuplicates(CLASS).select(F.monotonically_increasing_id().alias("node"), *CLASS, "first", "prefixes", "shingles")
    reps = materialize(spark, reps, sets)
    found = _linked(reps.select("node", "n", "prefixes", "shingles"), join)
    members = reps.select("node", *CLASS, "first").join(found, "node")
    chiefs = members.groupBy("root").agg(F.min("first").alias("chief"))
    moved = materialize(spark, members.join(chiefs, "root").select(*CLASS, "chief"), reps, found)
    rooted = classes.join(moved, CLASS, "left").select(*CLASS, F.coalesce("chief", "first").alias("chief"))
    linked = whole.where("n > 0").join(rooted, CLASS).select(*ROW, "n", "chief")
    return linked.unionByName(whole.where("n = 0").select(*ROW, "n", chief.alias("chief")))


def classify(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id): size of each document's shingle set, and the least doc_id that links lead to.

    Equal sets are one class, whose first row stands for it; links are looked for between classes only. Nulls and texts
    without words have no shingles and link with nothing; a null doc_id counts as larger than any other and is returned
    as null; each row is a document of its own, whether its id is null, repeated or neither; an empty table gives an
    empty result; other columns are ignored.
    """
    component = F.when(~F.col("chief.unknown"), F.col("chief.doc_id"))
    return _components(documents_of(docs), join).select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The documents that come first in their component, by doc_id (null ids last, by their texts' hashes), with their own columns; of rows with equal id and text one stays, but all rows without words do."""
    spark = docs.sparkSession
    marked = docs.drop("_row").withColumn("_row", F.struct(*row_identity()))
    found = _components(documents_of(docs), join)
    first = (F.col("n") == 0) | (F.struct((~F.col("known")).alias("unknown"), "doc_id", "tag") == F.col("chief"))
    found = materialize(spark, found.where(first).groupBy(*ROW).agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")))
    out = marked.join(found.where("copies = 1 or n = 0").select(F.struct(*ROW).alias("_row")), "_row", "left_semi")
    several = found.where("copies > 1 and n > 0").select(F.struct(*ROW).alias("_row"))
    if several.limit(1).count():
        out = out.unionByName(marked.join(several, "_row", "left_semi").dropDuplicates(["_row"]))
    return out.drop("_row")
