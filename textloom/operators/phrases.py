"""Which texts hold which phrases: an automaton of all phrases, walked once over each text."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one automaton's table, of text that is walked at a time, and of the pieces that it is cut into, which are walked side by side.
TABLE, STEP, PIECE = 64_000_000, 2_000_000, 512
#: Bytes of phrases that are sent to tasks at a time.
BLOCK = 32_000_000


class Automaton:
    """Aho-Corasick over bytes: table[state, class of a byte] is the next state; ends[state] the phrase that ends there or -1; other[state] the next shorter suffix where one ends, 0 for none."""

    def __init__(self, phrases: list[bytes]) -> None:
        self.longest = max(map(len, phrases), default=1)
        used = sorted(set(b"".join(phrases)))
        self.classes = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        goes: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, phrase in enumerate(phrases):
            at = 0
            for c in self.classes[np.frombuffer(phrase, np.uint8)].tolist():
                if c not in goes[at]:
                    goes[at][c] = len(goes)
                    goes.append({})
                    ends.append(-1)
                at = goes[at][c]
            ends[at] = i
        self.table = np.zeros((len(goes), width), np.int32)
        self.ends, self.other = np.array(ends), np.zeros(len(goes), np.int32)
        fail = np.zeros(len(goes), np.int32)
        todo = deque([0])
        while todo:
            s = todo.popleft()
            row = self.table[fail[s]].copy() if s else np.zeros(width, np.int32)
            for c, t in goes[s].items():
                fail[t] = row[c] if s else 0
                self.other[t] = fail[t] if self.ends[fail[t]] >= 0 else self.other[fail[t]]
                row[c] = t
                todo.append(t)
            self.table[s] = row
        self.stops = (self.ends >= 0) | (self.other > 0)

    def found(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last byte, phrase) of all occurrences. Bytes in no phrase lead back to the start, so texts are told apart by one."""
        before = self.longest - 1
        pieces = max(1, -(-len(data) // PIECE))
        padded = np.zeros(before + pieces * PIECE, self.classes.dtype)
        padded[before : before + len(data)] = self.classes[data]
        side = np.lib.stride_tricks.sliding_window_view(padded, before + PIECE)[::PIECE].T.copy()
        flat, width = self.table.ravel(), self.table.shape[1]
        state = np.zeros(pieces, np.int32)
        at, states = [], []
        for j in range(before + PIECE):
            state = flat[state * width + side[j]]
            if j >= before and (hit := np.flatnonzero(self.stops[state])).size:
                at.append(hit * PIECE + (j - before))
                states.append(state[hit])
        if not at:
            return np.zeros(0, int), np.zeros(0, int)
        at, state = np.concatenate(at), np.concatenate(states)
        where, which = [], []
        while len(at):
            own = self.ends[state] >= 0
            where.append(at[own])
            which.append(self.ends[state[own]])
            at, state = at[self.other[state] > 0], self.other[state][self.other[state] > 0]
        return np.concatenate(where), np.concatenate(which)


def automata(phrases: list[bytes], most: int = TABLE) -> list[tuple[Automaton, list[int]]]:
    """Automata whose tables have at most about `most` bytes, and the numbers of their phrases."""
    width = len(set(b"".join(phrases))) + 1
    out, part, size = [], [], 0
    for i in sorted(range(len(phrases)), key=phrases.__getitem__):
        if part and 4 * width * (size + len(phrases[i]) + 1) > most:
            out.append((Automaton([phrases[p] for p in part]), part))
            part, size = [], 0
        part.append(i)
        size += len(phrases[i])
    return out + ([(Automaton([phrases[p] for p in part]), part)] if part else [])


def holding(docs: DataFrame, phrases: DataFrame, key: str, text: str, phrase: str, block: int = BLOCK, table: int = TABLE) -> DataFrame:
    """(key, phrase): each text with the phrases that it holds anywhere, once each; compared byte by byte.

    The phrases are a dimension: its distinct values are taken `block` bytes at a time, and the texts are read once for
    each block. In a task, texts are walked about 2 MB at a time over automata of bounded size: the work grows with the
    text and the occurrences, not with the number of phrases. Null and empty phrases are held by none.
    """
    spark = docs.sparkSession
    wanted = phrases.where(F.length(phrase) > 0).select(F.col(phrase).cast("string").alias("p")).distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("p")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-int(size) // block))
    schema = docs.select(F.col(key)).schema
    out = None
    for b in range(blocks):
        some = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b)
        listed = [r.p for r in some.collect()]  # of counted size
        shared = spark.sparkContext.broadcast(listed)

        def run(batches, shared=shared):
            encoded = [p.encode() for p in shared.value]
            parts = automata(encoded, table)
            names = pa.array(shared.value, pa.string())
            for batch in batches:
                texts = batch.column(1).cast(pa.large_string())
                lengths = np.array([0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()], np.int64)
                row = 0
                while row < len(lengths):
                    last = row + max(1, int(np.searchsorted(np.cumsum(lengths[row:]), STEP, "right")))
                    own = [t or "" for t in texts[row:last].to_pylist()]
                    data = np.frombuffer(b"\xff".join(t.encode() for t in own), np.uint8)  # no text has that byte
                    ends = np.cumsum(lengths[row:last] + 1) - 1
                    pairs = []
                    for automaton, numbers in parts:
                        at, which = automaton.found(data)
                        pairs.append(np.stack([np.searchsorted(ends, at, "right"), np.array(numbers, int)[which]], axis=1))
                    doc, which = np.unique(np.concatenate(pairs), axis=0).T if pairs else (np.zeros(0, int),) * 2
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + row)), names.take(pa.array(which))], [key, phrase])
                    row = last

        schema_out = f"{key} {schema[0].dataType.simpleString()}, {phrase} string"
        found = docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema_out)
        out = found if out is None else out.unionByName(found)
    return out
