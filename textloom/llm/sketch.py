"""Count-min sketches of 64-bit keys: built by partition, merged by blocks of cells, read through a broadcast of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import shuffle_parts
from textloom.llm.hashing import U, mix

#: Cells of one block: a row of the sketch is merged in blocks, so no task holds a whole row.
BLOCK_LOG2 = 20
#: Keys that a partition's sketch gathers before it is passed on.
GATHERED = 2_000_000
#: Hot cells that a row keeps at most.
MOST_HOT = 1 << 22
SEEDS = tuple(int(x) for x in np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 8))


def cells(keys: np.ndarray, row: int, log2: int) -> np.ndarray:
    return mix(keys ^ U(SEEDS[row])) >> U(64 - log2)


def pack_gaps(sorted_distinct: np.ndarray) -> bytes:
    """Ascending distinct numbers as gaps, a byte each; 255 stands for 255 more."""
    gaps = np.diff(sorted_distinct.astype(np.int64), prepend=-1) - 1
    ends = np.cumsum(gaps // 255 + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = gaps % 255
    return out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    sums = np.cumsum(raw, dtype=np.int64)[raw != 255]
    return sums + np.arange(len(sums))


@dataclass
class Sketch:
    """Of each row: a bit for cells counted twice or more, and the cells counted `hot` times or more with the quarter octave of their count."""

    log2: int
    bits: list[np.ndarray]
    hot_cells: list[np.ndarray]
    levels: list[np.ndarray]

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Keys whose estimated count is two or more; never False for one that came twice."""
        out = np.ones(len(keys), bool)
        for row, bits in enumerate(self.bits):
            at = cells(keys, row, self.log2)
            out &= (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
        return out

    def level(self, keys: np.ndarray) -> np.ndarray:
        """4 * log2 of the estimated count, rounded down, and 0 below `hot`."""
        out = np.full(len(keys), 255, np.uint8)
        for row, found in enumerate(self.hot_cells):
            at = cells(keys, row, self.log2)
            place = np.minimum(np.searchsorted(found, at), max(0, len(found) - 1))
            out = np.minimum(out, np.where(found[place] == at, self.levels[row][place], 0) if len(found) else 0)
        return out

    def hot(self, keys: np.ndarray) -> np.ndarray:
        return self.level(keys) > 0


ROWS = "row int, block int, cells binary, more binary"


def partition_sketch(parts: Iterable[np.ndarray], depth: int, log2: int) -> Iterator[pa.RecordBatch]:
    """Rows of one partition's sketch, from arrays of keys (one entry for each time that a key counts)."""
    schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("cells", pa.binary()), ("more", pa.binary())])
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        rows = []
        keys = np.concatenate(held)
        for row in range(depth):
            found, counts = np.unique(cells(keys, row, log2), return_counts=True)
            edges = np.searchsorted(found >> U(min(log2, BLOCK_LOG2)), np.arange((1 << max(0, log2 - BLOCK_LOG2)) + 1, dtype=np.uint64))
            for block, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if a < b:
                    inside = (found[a:b] & U((1 << BLOCK_LOG2) - 1)).astype(np.uint32)
                    many = counts[a:b] > 1
                    more = np.stack([inside[many], (counts[a:b][many] - 1).astype(np.uint32)])
                    rows.append((row, block, pack_gaps(inside), more.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for keys in parts:
        if len(keys):
            held.append(keys)
        if sum(map(len, held)) >= GATHERED:
            yield flush()
            held.clear()
    if held:
        yield flush()


def _merge(log2: int, hot: int) -> Callable:
    width = 1 << min(log2, BLOCK_LOG2)
    most = max(64, MOST_HOT * width >> log2)

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own = sums.setdefault((r["row"], r["block"]), np.zeros(width, np.uint32))
                own[unpack_gaps(r["cells"])] += 1
                at, extra = np.frombuffer(r["more"], np.uint32).reshape(2, -1)
                own[at] += extra
        for (row, block), own in sums.items():
            least = hot
            while len(at := np.flatnonzero(own >= least)) > most:
                least *= 2
            level = np.floor(4 * np.log2(own[at])).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_pydict({
                "row": pa.array([row], pa.int32()), "block": pa.array([block], pa.int32()),
                "bits": pa.array([np.packbits(own >= 2, bitorder="little").tobytes()], pa.binary()),
                "hot": pa.array([at.astype(np.uint32).tobytes()], pa.binary()), "level": pa.array([level.tobytes()], pa.binary()),
            })

    return run


def merge(rows: DataFrame, depth: int, log2: int, hot: int) -> Sketch:
    """Adds up the partitions' sketches, a block of cells a key, and brings what estimates need to the driver: depth * 2 ** log2 bits, and MOST_HOT cells a row with a byte each (blocks with more raise their threshold), whatever the number of documents."""
    spark = rows.sparkSession
    merged = rows.repartition(shuffle_parts(spark), "row", "block").mapInArrow(_merge(log2, hot), "row int, block int, bits binary, hot binary, level binary")
    bits = [np.zeros(max(1, 1 << max(0, log2 - 3)), np.uint8) for _ in range(depth)]
    found: list[list[tuple]] = [[] for _ in range(depth)]
    size = max(1, (1 << min(log2, BLOCK_LOG2)) >> 3)
    for r in merged.toLocalIterator():
        bits[r.row][r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
        found[r.row].append((r.block, np.frombuffer(r.hot, np.uint32).astype(np.uint64) + U(r.block << BLOCK_LOG2), np.frombuffer(r.level, np.uint8)))
    ordered = [sorted(x, key=lambda y: y[0]) for x in found]
    join = lambda row, i, kind: np.concatenate([np.zeros(0, kind), *[y[i] for y in row]])
    return Sketch(log2, bits, [join(x, 1, np.uint64) for x in ordered], [join(x, 2, np.uint8) for x in ordered])
