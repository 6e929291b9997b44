"""What the removal of repeated passages has in common, over words and over bytes: windows, their anchors, and what is left of a text.

A window's anchor is the first of its shorter grams with the least hash. Equal windows have equal anchors at the same
place, so all copies of a window meet where its anchor's key leads, and neighbouring windows mostly share one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.llm.common import ROW, documents_of, id_out, materialize, order_ids, text_steps
from textloom.llm.sketch import ROWS, Sketch, merge, partition_sketch


@dataclass(frozen=True)
class Kind:
    """Words or bytes; window and gram in units. log2 and depth size the sketch; keys estimated `hot` times go a way without groups."""

    words: bool
    window: int = 50
    gram: int = 10
    log2: int = 25
    depth: int = 2
    hot: int = 8192
    step: int = 2_000_000


@dataclass
class Runs:
    """Runs of windows of one text that share an anchor; places are units from the start of their text."""

    doc: np.ndarray  # row in the batch
    first: np.ndarray  # of the first window
    count: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    at: np.ndarray  # first window's place in the arrays of the step
    units: np.ndarray  # prefix hashes of the step's words, or its bytes
    words: np.ndarray  # the step's words as hashes, or its bytes


def runs_of(batch: pa.RecordBatch, kind: Kind) -> Iterator[Runs]:
    """The runs of all windows of a batch (column text), a step of texts at a time; longer texts of bytes in overlapping pieces."""
    for row, last, data, offsets in text_steps(batch, step=kind.step):
        pieces = [(data, offsets, 0)]
        if not kind.words and len(data) > 2 * kind.step:  # one long text
            pieces = [(x := data[a : a + kind.step + kind.window - 1], np.array([0, len(x)]), a) for a in range(0, len(data), kind.step)]
        for part, bounds, base in pieces:
            if kind.words:
                _, _, units, bounds = H.words(part, bounds)
            else:
                units = part
            n = len(units) - kind.window + 1
            if n <= 0:
                continue
            p = H.prefix(units if kind.words else H.VALUES[units], H.BASE_WORDS)
            grams = H.mix(H.windows(p, kind.gram, H.BASE_WORDS))
            anchor = H.sliding_first_min(grams, kind.window - kind.gram + 1)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            valid = owner[:n] == owner[kind.window - 1 :]
            start = valid.copy()
            start[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
            at = np.flatnonzero(start)
            if not len(at):
                continue
            numbered = np.cumsum(start) - 1
            count = np.bincount(numbered[valid], minlength=len(at))
            doc = owner[at]
            yield Runs(doc + row, at - bounds[doc] + base, count, anchor[at] - bounds[doc] + base, grams[anchor[at]], at, p if kind.words else units, units)


def sketch_of(docs: DataFrame, kind: Kind) -> Sketch:
    """Counts for each anchor key the documents that have it: never fewer than have any one of its windows."""

    def run(batches):
        def keys():
            for batch in batches:
                for r in runs_of(batch, kind):
                    order = np.lexsort((r.key, r.doc))
                    key, doc = r.key[order], r.doc[order]
                    yield key[np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])]

        yield from partition_sketch(keys(), kind.depth, kind.log2)

    return merge(docs.select("text").mapInArrow(run, ROWS), kind.depth, kind.log2, kind.hot)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 1]: owners [0, 0, 1] and places in the owner [0, 1, 0]."""
    total = int(counts.sum(dtype=np.int64))
    kind = np.int32 if total < 2**31 else np.int64
    counts = counts.astype(kind)
    inside = np.arange(total, dtype=kind)
    inside -= np.repeat(np.cumsum(counts, dtype=kind) - counts, counts)
    return np.repeat(np.arange(len(counts), dtype=kind), counts), inside


def window_hashes(r: Runs, chosen: np.ndarray, kind: Kind, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, run and place within the run of each window of words of the chosen runs; the second hash has another base and other values of the words."""
    owner, inside = spread(r.count[chosen])
    at = r.at[chosen][owner] + inside
    base = H.BASE_BYTES if second else H.BASE_WORDS
    p = H.prefix(H.mix(r.words ^ H.U(0x3C6EF372FE94F82B)), base) if second else r.units
    return H.mix((p[at + kind.window] - p[at]) * H.powers(H.inverse(base), len(p))[at]), chosen[owner], inside


REMOVED = "doc_id long, known boolean, tag long, first int, count int"


def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of ROW."""
    return batch.column("doc_id").to_numpy(), batch.column("known").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy()


def hot_windows(docs: DataFrame, kind: Kind, sketch) -> DataFrame:
    """Removed windows with a hot anchor, without groups: the least doc_id of each window is aggregated with partial sums, and joined back to the windows by a join whose skewed partitions Spark splits. Windows of bytes are compared as they are, those of words by two hashes."""

    def run(batches):
        for batch in batches:
            ids, known, tags = ids_of(batch)
            for r in runs_of(batch.select(["text"]), kind):
                chosen = np.flatnonzero(sketch.value.hot(r.key))
                for a in range(0, len(chosen), 1 << 14):
                    if kind.words:
                        one, owner, inside = window_hashes(r, chosen[a : a + (1 << 14)], kind)
                        two, _, _ = window_hashes(r, chosen[a : a + (1 << 14)], kind, second=True)
                        raw = np.stack([one, two], axis=1).view(np.uint8)
                    else:
                        counts, inside = spread(r.count[chosen[a : a + (1 << 14)]])
                        owner = chosen[a : a + (1 << 14)][counts]
                        raw = np.lib.stride_tricks.sliding_window_view(r.units, kind.window)[r.at[owner] + inside]
                    width, n = raw.shape[1], len(raw)
                    windows = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(raw.tobytes())])
                    doc = r.doc[owner]
                    yield pa.RecordBatch.from_arrays([windows, pa.array(ids[doc]), pa.array(known[doc]), pa.array(tags[doc]), pa.array((r.first[owner] + inside).astype(np.int32))], ["window", *ROW, "first"])

    found = materialize(docs.sparkSession, docs.select(*ROW, "text").mapInArrow(run, "window binary, doc_id long, known boolean, tag long, first int"))
    least = found.groupBy("window").agg(F.min(F.when(F.col("known"), F.col("doc_id"))).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 and least is not null").select("window", "least")
    return found.join(least, "window").where("doc_id > least or not known").select(*ROW, "first", F.lit(1).alias("count"))


def ranges(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross owners."""
    change = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    before = np.concatenate([[False], flags[:-1]]) & ~change
    after_change = np.concatenate([change[1:], [True]]) if len(owner) else change
    after = np.concatenate([flags[1:], [False]]) & ~after_change
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


def _covered(n: int, packed: np.ndarray, window: int) -> np.ndarray:
    """Which of n units runs of windows cover; a run is its first window's place and, in the low 32 bits, its number of windows."""
    firsts, counts = packed >> 32, packed & 0xFFFFFFFF
    marks = np.bincount(firsts, minlength=n + 1) - np.bincount(firsts + counts + window - 1, minlength=n + 1)
    return np.cumsum(marks)[:n] > 0


def apply_removals(docs: DataFrame, removed: DataFrame, kind: Kind, with_text: bool) -> DataFrame:
    """Takes what the removed windows cover out of each text: counts, a digest of what is left, and the rest itself if asked for. One shuffle of the texts, by document."""
    packed = F.shiftleft(F.col("first").cast("long"), 32) + F.col("count")  # a set: equal rows bring the same windows
    lists = removed.groupBy(*ROW).agg(F.collect_set(packed).alias("runs"))
    joined = docs.join(lists, list(ROW), "left").select(id_out().alias("doc_id"), "text", "runs")
    names = ["doc_id", "n_words" if kind.words else "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches):
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                units = raw.split() if kind.words else np.frombuffer(raw, np.uint8)
                n, gone, spans, kept = len(units), 0, 0, None
                if runs.is_valid:
                    mask = _covered(n, runs.values.to_numpy(), kind.window)
                    gone, spans = int(mask.sum()), int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                    kept = [w for w, m in zip(units, mask.tolist(), strict=True) if not m] if kind.words else units[~mask].tobytes()
                rest = b" ".join(units if kept is None else kept) if kind.words else raw if kept is None else kept
                rows.append((n, gone, spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace") if with_text else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(columns[: 4 + with_text], types, strict=False)], names)

    return joined.mapInArrow(run, f"doc_id long, {names[1]} long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)


def remove(docs: DataFrame, kind: Kind, found, with_text: bool) -> DataFrame:
    """Sketch, removed windows by found(docs, kind, sketch) for keys that aren't hot, those of hot keys, and the texts without them."""
    spark: SparkSession = docs.sparkSession
    own = documents_of(docs)
    sketch = sketch_of(own, kind)
    sent = spark.sparkContext.broadcast(sketch)  # depth * 2 ** log2 bits, a parameter, and the hot cells
    removed = found(own, kind, sent)
    if any(len(x) for x in sketch.hot_cells):
        removed = removed.unionByName(hot_windows(own, kind, sent))
    return apply_removals(own, removed, kind, with_text)
