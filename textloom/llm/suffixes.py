"""Removal of repeated byte strings by a hash-compared suffix sort of the passages that may repeat."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import hashing as H
from textloom.llm.common import ROW, counted_parts, order_ids, shuffle_parts
from textloom.llm.repeats import REMOVED, Kind, ids_of, ranges, remove, runs_of, spread

#: Passages that one step of a match works on.
BLOCK = 1 << 14
#: Bytes of passages that a task gathers before it deals them out.
GATHERED = 4_000_000
PACKED = "part int, runs int, rest binary"
#: What stands in rest, compressed: ids, whether they are known, row tags, first windows' places, bytes before the anchor, windows; then the passages.
REST = (np.int64, np.bool_, np.int64, np.uint32, np.uint8, np.uint8)
#: Bytes of text whose passages one part holds, were all of them to repeat.
PART_BYTES = 8_000_000
BYTES = Kind(words=False, gram=18, log2=28, depth=1, hot=50_000, step=500_000)


def _deal(docs: DataFrame, kind: Kind, sketch, parts: int) -> DataFrame:
    """The passages of runs whose anchors are estimated repeated, dealt by the anchors' keys."""
    more = kind.window - 1

    def run(batches):
        held, size = [], 0

        def flush():
            runs = [np.concatenate(x) for x in zip(*[h[:7] for h in held], strict=True)]
            texts = np.concatenate([h[7] for h in held])
            part = (H.mix(runs[0] ^ H.U(0xA5A5)) % H.U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            lengths = runs[6].astype(np.int64) + more
            begins = np.cumsum(lengths) - lengths
            owner, inside = spread(lengths[order])
            texts = texts[begins[order][owner] + inside]
            runs = [x[order] for x in runs]
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            ends = np.concatenate([[0], np.cumsum(lengths[order])])
            rows = []
            for p in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[p], edges[p + 1]
                rest = b"".join([*[x[a:b].tobytes() for x in runs[1:]], texts[ends[a] : ends[b]].tobytes()])
                rows.append((p, b - a, zlib.compress(rest, 1)))
            part, counts, rest = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts, pa.int32()), pa.array(rest, pa.binary())], ["part", "runs", "rest"])

        for batch in batches:
            ids, known, tags = ids_of(batch)
            for r in runs_of(batch.select(["text"]), kind):
                met = sketch.value.repeated(r.key)
                met[met] = ~sketch.value.hot(r.key[met])
                chosen = np.flatnonzero(met)
                if len(chosen):
                    owner, inside = spread(r.count[chosen] + more)
                    doc = r.doc[chosen]
                    lefts = (r.anchor[chosen] - r.first[chosen]).astype(np.uint8)
                    held.append((r.key[chosen], ids[doc], known[doc], tags[doc], r.first[chosen].astype(np.uint32), lefts, r.count[chosen].astype(np.uint8), r.units[r.at[chosen][owner] + inside]))
                    size += len(owner) + 31 * len(chosen)
                if size > GATHERED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select(*ROW, "text").mapInArrow(run, PACKED)


class Suffixes:
    """Byte strings, one a column of a matrix, with the polynomial hashes of all their prefixes."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int, most: int):
        """Column i reads text[starts[i]], text[starts[i] + step] and so on, lengths[i] bytes and at most `most`."""
        self.lengths = np.minimum(lengths, most).astype(np.int64)
        self.bytes = np.zeros((most, len(starts)), np.uint8)
        self.hashes = np.zeros((most + 1, len(starts)), np.uint64)
        for m in range(most):
            there = self.lengths > m
            self.bytes[m, there] = text[starts[there] + step * m]
            self.hashes[m + 1] = self.hashes[m] * H.U(H.BASE_BYTES) + H.VALUES[self.bytes[m]]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair of rows: a binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.lengths[x], self.lengths[y])
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = self.hashes[middle, x] == self.hashes[middle, y]
            low = np.where(same & open_, middle, low)
            high = np.where(same | ~open_, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, equal: bool) -> np.ndarray:
        """Whether row x sorts before row y; `equal` for equal ones."""
        n = self.common(x, y)
        end_x, end_y = n == self.lengths[x], n == self.lengths[y]
        at = np.minimum(n, len(self.bytes) - 1)
        differ = self.bytes[at, x] < self.bytes[at, y]
        return np.where(end_x & end_y, equal, np.where(end_x, True, np.where(end_y, False, differ)))

    def sort(self, groups: np.ndarray) -> np.ndarray:
        """Order of the rows by (group, suffix): bottom-up mergesort of all groups at once, a place in the merged run being a rank found by binary search. Groups are ascending."""
        order = np.arange(len(groups))
        begin = np.searchsorted(groups, groups, "left")
        size = np.searchsorted(groups, groups, "right") - begin
        inside = order - begin
        width = 1
        while len(size) and width < size.max():
            pair = inside // (2 * width) * (2 * width)
            right = (inside // width) % 2 == 1
            low = begin + pair + np.where(right, 0, width)
            high = begin + np.minimum(pair + np.where(right, width, 2 * width), size)
            todo = np.flatnonzero(low < high)
            lo, hi = low[todo], high[todo]
            mine = order[todo]
            is_right = right[todo]
            first = lo.copy()
            active = np.arange(len(todo))
            while len(active):
                middle = (lo[active] + hi[active]) >> 1
                other = order[middle]
                # from the left run: how many of the right sort strictly before; from the right: how many of the left before or equal
                before = np.where(is_right[active], self.less(other, mine[active], True), self.less(other, mine[active], False))
                lo[active] = np.where(before, middle + 1, lo[active])
                hi[active] = np.where(before, hi[active], middle)
                active = active[lo[active] < hi[active]]
            place = np.arange(len(order))
            place[todo] = begin[todo] + pair[todo] + (inside[todo] - pair[todo] - np.where(is_right, width, 0)) + (lo - first)
            merged = np.empty_like(order)
            merged[place] = order
            order = merged
            width *= 2
        return order

    def classes(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order, and of each row in it the common extension with the row before it in its group (-1 for a group's first), verified byte by byte."""
        order = self.sort(groups)
        common = np.full(len(order), -1, np.int64)
        near = np.flatnonzero(groups[order][1:] == groups[order][:-1]) + 1
        for a in range(0, len(near), BLOCK):
            at = near[a : a + BLOCK]
            x, y = order[at - 1], order[at]
            found = self.common(x, y)
            same = self.bytes[:, x] == self.bytes[:, y]
            true = np.minimum(np.where(same.all(0), len(same), same.argmin(0)), np.minimum(self.lengths[x], self.lengths[y]))
            if (found != true).any():  # two strings of one hash: the bytes themselves decide
                return self._plain(groups)
            common[at] = found
        return order, common

    def _plain(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.array(sorted(range(len(groups)), key=lambda i: (groups[i], self.bytes[: self.lengths[i], i].tobytes())), np.int64)
        common = np.full(len(order), -1, np.int64)
        for k in range(1, len(order)):
            x, y = order[k - 1], order[k]
            if groups[x] == groups[y]:
                n = min(self.lengths[x], self.lengths[y])
                same = self.bytes[:n, x] == self.bytes[:n, y]
                common[k] = n if same.all() else same.argmin()
        return order, common


def _ids(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number for each row, equal for rows whose strings agree in their first `depth` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def _unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
    parts: list[list[np.ndarray]] = [[] for _ in range(len(REST) + 1)]
    for runs, packed in zip(table.column("runs").to_pylist(), table.column("rest"), strict=True):
        raw, at = zlib.decompress(packed.as_py()), 0
        for into, kind in zip(parts, REST, strict=False):
            size = runs * np.dtype(kind).itemsize
            into.append(np.frombuffer(raw[at : at + size], kind))
            at += size
        parts[-1].append(np.frombuffer(raw[at:], np.uint8))
    return tuple(np.concatenate(x) for x in parts)


def _anchors(text: np.ndarray, places: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the anchors, from the passages."""
    out = np.zeros(len(places), np.uint64)
    for m in range(gram):
        out += H.VALUES[text[places + m]] * H.powers(H.BASE_WORDS, gram)[m]
    return H.mix(out)


def distinct(keys: np.ndarray, lefts: np.ndarray, begins: np.ndarray, lengths: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages that stand for all equal ones, ascending by key, and each passage's place among them. Equal ones are found by hash and compared byte by byte."""
    whole = np.zeros(len(keys), np.uint64)
    for a in range(0, len(keys), BLOCK):
        at = slice(a, a + BLOCK)
        owner, inside = spread(lengths[at])
        terms = H.VALUES[text[begins[at][owner] + inside]] * H.powers(H.BASE_BYTES, 1 << 10)[inside]
        whole[at] = np.add.reduceat(terms, np.cumsum(lengths[at]) - lengths[at])
    whole = H.mix(whole + (lengths * 256 + lefts).astype(np.uint64))
    order = np.lexsort((whole, keys))
    new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (whole[order][1:] != whole[order][:-1])])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    chosen = order[new]
    stands = chosen[number]
    same = (lengths == lengths[stands]) & (lefts == lefts[stands])
    for a in range(0, len(keys), BLOCK):
        at = slice(a, a + BLOCK)
        owner, inside = spread(lengths[at])
        differ = text[begins[at][owner] + inside] != text[np.minimum(begins[stands[at]][owner] + inside, len(text) - 1)]
        same[a + owner[differ]] = False
    if not same.all():  # two passages of one hash: none stands for another
        order = np.argsort(keys, kind="stable")
        number[order] = np.arange(len(keys))
        return order, number
    return chosen, number


def match(table: pa.Table, kind: Kind) -> pa.Table:
    """Of one part's passages, the windows that a smaller doc_id has too.

    Equal passages of one key are sorted once, with their least doc_id. Passages of one key are aligned at their
    anchors. The suffixes that start there and the reversed prefixes that end there are sorted; neighbours' common
    extensions give, for each place of a window around its anchor, classes of equal left and right parts, and the
    least doc_id of a class of both decides.
    """
    ids, known, tags, firsts, lefts, counts, text = _unpack(table)
    docs = order_ids(ids, known)
    lefts, counts = lefts.astype(np.int64), counts.astype(np.int64)
    lengths = counts + kind.window - 1
    begins = np.cumsum(lengths) - lengths
    keys = _anchors(text, begins + lefts, kind.gram)
    chosen, number = distinct(keys, lefts, begins, lengths, text)
    doc = np.full(len(chosen), np.iinfo(np.int64).max)
    np.minimum.at(doc, number, docs)
    groups = np.cumsum(np.concatenate([[True], keys[chosen][1:] != keys[chosen][:-1]])) - 1
    own_lefts, own_counts = lefts[chosen], counts[chosen]
    reach = kind.window - kind.gram
    anchor = begins[chosen] + own_lefts
    right, right_common = Suffixes(text, anchor, lengths[chosen] - own_lefts, 1, kind.window).classes(groups)
    left, left_common = Suffixes(text, anchor - 1, own_lefts, -1, reach).classes(groups)
    least = np.full((len(chosen), reach + 1), np.iinfo(np.int64).max)  # by the window's place in its run
    for before in range(reach + 1):  # bytes of the window that stand before the anchor
        place = own_lefts - before
        rows = np.flatnonzero((place >= 0) & (place < own_counts))
        if len(rows):
            both = _ids(left, left_common, before)[rows] * (len(chosen) + 1) + _ids(right, right_common, kind.window - before)[rows]
            order = np.argsort(both, kind="stable")
            new = np.concatenate([[True], both[order][1:] != both[order][:-1]])
            lowest = np.minimum.reduceat(doc[rows][order], np.flatnonzero(new))[np.cumsum(new) - 1]
            least[rows[order], place[rows[order]]] = lowest
    out = []
    for a in range(0, len(docs), BLOCK):
        own = slice(a, a + BLOCK)
        gone = docs[own, None] > least[number[own]]
        starts, ends = ranges(gone.ravel(), np.repeat(np.arange(len(gone)), reach + 1))
        run, inside = starts // (reach + 1), starts % (reach + 1)
        out.append(pa.table({"doc_id": ids[own][run], "known": known[own][run], "tag": tags[own][run], "first": (firsts[own][run] + inside).astype(np.int32), "count": (ends - starts).astype(np.int32)}))
    return pa.concat_tables(out)


def _found(docs: DataFrame, kind: Kind, sketch) -> DataFrame:
    parts = counted_parts(docs, PART_BYTES, 8 * shuffle_parts(docs.sparkSession))
    return _deal(docs, kind, sketch, parts).groupBy("part").applyInArrow(lambda t: match(t, kind), REMOVED)


def dedup(docs: DataFrame, kind: Kind = BYTES, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]): each text's UTF-8 bytes without those that a window covers which a document with a smaller doc_id has too.

    A suffix array of a whole corpus can't be held by one machine. So passages meet by their anchors' keys (see
    repeats.py; anchors that a sketch knows to be in one document only stay at home), each part sorts its passages'
    suffixes by mergesort with hash comparisons, and equal windows stand next to each other there. Anchors estimated in
    `hot` documents or more don't go into such groups, which they would fill: each of their windows is a row, grouped and
    joined by its bytes.

    Null texts have no bytes; a null doc_id counts as larger than any other and is returned as null (rows without one
    are documents of their own, which take nothing from each other); strings don't repeat within one doc_id; rows with equal id and text get equal results; texts shorter than a window stay whole;
    kept_text replaces what is no longer UTF-8; an empty table gives an empty result; other columns are ignored.
    """
    return remove(docs, kind, _found, with_text)
