"""Removal of repeated passages of words: count-min prefilter, then exact groups of the windows estimated repeated."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.llm.common import ROW, counted_parts, order_ids, shuffle_parts
from textloom.llm.repeats import REMOVED, Kind, ids_of, ranges, remove, runs_of, spread, window_hashes

#: Bytes of windows that a task gathers before it deals them out.
GATHERED = 16_000_000
PACKED = "part int, keys binary, docs binary, known binary, tags binary, firsts binary, counts binary, hashes binary, checks binary"
#: Bytes of text whose windows one part holds, were all of them to repeat.
PART_BYTES = 32_000_000
WORDS = Kind(words=True, gram=10, log2=26, depth=2)


def _deal(docs: DataFrame, kind: Kind, sketch, parts: int) -> DataFrame:
    """Windows estimated repeated, as arrays, dealt by their anchors' keys."""
    names = [c.split()[0] for c in PACKED.split(", ")][1:]

    def run(batches):
        held, size = [], 0

        def flush():
            runs = [np.concatenate(x) for x in zip(*[h[:6] for h in held], strict=True)]
            counts = runs[5]
            part = (H.mix(runs[0] ^ H.U(0xA5A5)) % H.U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            owner, inside = spread(counts[order])
            begins = np.cumsum(counts, dtype=np.int64) - counts
            at = begins[order][owner] + inside
            hashes, checks = (np.concatenate([h[i] for h in held])[at] for i in (6, 7))
            runs = [x[order] for x in runs]
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            ends = np.concatenate([[0], np.cumsum(counts[order], dtype=np.int64)])
            met = np.flatnonzero(np.diff(edges))
            rows = [(p, *[x[edges[p] : edges[p + 1]].tobytes() for x in runs], *[x[ends[edges[p]] : ends[edges[p + 1]]].tobytes() for x in (hashes, checks)]) for p in met.tolist()]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], ["part", *names])

        for batch in batches:
            ids, known, tags = ids_of(batch)
            for r in runs_of(batch.select(["text"]), kind):
                met = sketch.value.repeated(r.key)
                met[met] = ~sketch.value.hot(r.key[met])
                chosen = np.flatnonzero(met)
                if len(chosen):
                    h, _, _ = window_hashes(r, chosen, kind)
                    check, _, _ = window_hashes(r, chosen, kind, second=True)
                    doc = r.doc[chosen]
                    held.append((r.key[chosen], ids[doc], known[doc], tags[doc], r.first[chosen].astype(np.uint32), r.count[chosen].astype(np.uint32), h, check))
                    size += 2 * h.nbytes + 33 * len(chosen)
                if size > GATHERED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select(*ROW, "text").mapInArrow(run, PACKED)


def group_windows(table: pa.Table) -> pa.Table:
    """Exact groups of one part's windows, by their anchor's and two hashes of their own: a window goes where a smaller doc_id has it."""
    read = lambda c, t: np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)])
    kinds = {"keys": np.uint64, "docs": np.int64, "known": bool, "tags": np.int64, "firsts": np.uint32, "counts": np.uint32, "hashes": np.uint64, "checks": np.uint64}
    keys, docs, known, tags, firsts, counts, hashes, checks = (read(c, t) for c, t in kinds.items())
    owner, inside = spread(counts)
    key, doc = keys[owner], order_ids(docs, known)[owner]
    order = np.lexsort((checks, hashes, key))
    new = np.ones(len(order), bool)
    new[1:] = False
    for x in (key, hashes, checks):
        new[1:] |= x[order][1:] != x[order][:-1]
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], starts)[np.cumsum(new) - 1]
    gone = np.empty(len(doc), bool)
    gone[order] = doc[order] > least
    a, b = ranges(gone, owner)
    run = owner[a]
    return pa.table({"doc_id": docs[run], "known": known[run], "tag": tags[run], "first": (firsts[run] + inside[a]).astype(np.int32), "count": (b - a).astype(np.int32)})


def _found(docs: DataFrame, kind: Kind, sketch) -> DataFrame:
    parts = counted_parts(docs, PART_BYTES, 2 * shuffle_parts(docs.sparkSession))
    return _deal(docs, kind, sketch, parts).groupBy("part").applyInArrow(group_windows, REMOVED)


def dedup(docs: DataFrame, kind: Kind = WORDS, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256[, kept_text]): each text without the words that a window covers which a document with a smaller doc_id has too.

    First pass: every partition sketches its windows (through their anchors' keys, a document counting once for each),
    the sketches are added up by blocks and broadcast as bits of fixed number; they overestimate counts, so no repeated
    window is lost. Second pass: windows estimated repeated are dealt by key and grouped exactly; keys estimated in
    `hot` documents or more go by aggregation and a skew-split join instead of a group. Windows are judged on the input.

    Null texts have no words; a null doc_id counts as larger than any other and is returned as null (rows without one
    are documents of their own, which take nothing from each other); windows don't repeat within one doc_id; rows with
    equal id and text get equal results; texts of fewer words than a window stay
    whole; an empty table gives an empty result; other columns are ignored.
    """
    return remove(docs, kind, _found, with_text)
