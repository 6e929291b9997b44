"""Vector functions as Column expressions over arrays of numbers, and joins by similarity."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import col, once


class Embedder(Protocol):
    """What turns a text into a vector; the default needs no model."""

    def __call__(self, text: Column) -> Column: ...


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector at length 1; zeros stay zeros."""
    scaled = lambda v, n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))
    return once(col(a), lambda v: once(norm(v), lambda n: scaled(v, n)))


def cosine(a: Column | str, b: Column | str, clamp: str = "none") -> Column:
    """0 where a vector has length 0. clamp: none, zero (not below 0), unit (0 to 1), both (-1 to 1)."""
    n = norm(a) * norm(b)
    c = F.when(n > 0, dot(a, b) / n).otherwise(0.0)
    limits = {"none": (None, None), "zero": (0.0, None), "unit": (0.0, 1.0), "both": (-1.0, 1.0)}[clamp]
    c = F.greatest(c, F.lit(limits[0])) if limits[0] is not None else c
    return F.least(c, F.lit(limits[1])) if limits[1] is not None else c


def hash_embedding(text: Column | str, size: int = 16, seed: str = "") -> Column:
    """A deterministic vector of length 1 from digests of the text: the offline stand-in for a model."""
    t = col(text)
    part = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), t, i.cast("string"))), 1, 8), 16, 10).cast("double") / 2147483648.0 - 1.0
    return unit(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), part))


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the mean of a key's vectors, place by place."""
    flat = df.select(key, F.posexplode(vector).alias("_p", "_v")).groupBy(key, "_p").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda x: x["_m"]).alias(vector))


def fuse(vectors: list[Column | str], weights: list[float] | None = None) -> Column:
    """The weighted mean of vectors of one size, at length 1."""
    weights = weights or [1.0 / len(vectors)] * len(vectors)
    scaled = [_scaled(v, w) for v, w in zip(vectors, weights, strict=True)]
    return unit(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled))


def _scaled(v: Column | str, weight: float) -> Column:
    return F.transform(col(v), lambda x: x.cast("double") * weight)


#: Bytes of queries that are broadcast at most; more are dealt in blocks.
MOST_BYTES = 64_000_000


def against(queries: DataFrame, rows: DataFrame, on: Column | None = None, bytes_a_row: int = 1000, most: int = MOST_BYTES) -> DataFrame:
    """Every query with every row (`on`: of which this holds): a stated set of queries against all rows.

    The queries are counted. Up to `most` bytes they are broadcast and the rows stay where they are; beyond, they are cut
    into blocks of that size, and each row goes to each block.
    """
    blocks = -(-queries.count() * bytes_a_row // max(1, most))
    if blocks <= 1:
        joined = rows.crossJoin(F.broadcast(queries))
        return joined if on is None else joined.where(on)
    asked = queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)).cast("int"))
    dealt = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, "_block").drop("_block")
    return dealt if on is None else dealt.where(on)


#: Pairs that all_pairs() sorts at a time: about 24 bytes each, and as many for a while.
SORTED_PAIRS = 4_194_304

#: Rows of a pack, and pairs that one task compares of each partition.
PACK, TASK_PAIRS = 1024, 8_000_000


def packed(df: DataFrame, name: str, rows: int = PACK) -> DataFrame:
    """(name): df in packs of at most `rows` rows, each an Arrow stream."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(i, rows))
                yield pa.RecordBatch.from_pydict({name: pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return df.mapInArrow(run, f"{name} binary")


class Pack:
    """Rows of a pack: its Arrow columns, and their vectors as one matrix of doubles, padded by zeros."""

    def __init__(self, data: bytes, vector: str):
        import numpy as np
        import pyarrow as pa

        self.columns = pa.ipc.open_stream(data).read_all().combine_chunks()
        lists = self.columns[vector].combine_chunks()
        size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(size)), size)
        self.known = np.asarray(lists.is_valid()).copy()  # false: null or with a null in it
        if flat.null_count:
            self.known[row[np.asarray(flat.is_null())]] = False
        self.size = size
        self.matrix = np.zeros((len(size), int(size.max(initial=0))))
        self.matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(flat.cast(pa.float64()).fill_null(0.0))
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.matrix, self.matrix))

    def ids(self, name: str):
        import numpy as np

        return np.asarray(self.columns[name].combine_chunks())


def products(q: Pack, r: Pack):
    """(dot, cosine) of all pairs of two packs; NaN in the place of a null, as dot() and cosine() have it."""
    import numpy as np

    wide = min(q.matrix.shape[1], r.matrix.shape[1])
    dots = q.matrix[:, :wide] @ r.matrix[:, :wide].T
    known = q.known[:, None] & r.known[None, :]
    if not known.all() or (q.size[:, None] != r.size[None, :]).any():
        dots[~known | (q.size[:, None] != r.size[None, :])] = np.nan
    length = q.norm[:, None] * r.norm[None, :]
    with np.errstate(all="ignore"):
        return dots, np.where((length <= 0) | ~known, 0.0, dots / length)


def rounded(x, places: int = 6):
    """Halves away from zero, as round() in SQL."""
    import numpy as np

    return np.trunc(x * 10.0**places + np.copysign(0.5, x)) / 10.0**places + 0.0


def compared(queries: DataFrame, rows: DataFrame, vector: str, work, schema: str, most: int = MOST_BYTES, pairs: int = TASK_PAIRS, *, load=Pack, cells: int = PACK * PACK) -> DataFrame:
    """What work(query pack, row pack) yields, a record batch at a time, for every pack of queries with every pack of rows: a stated set of queries against all rows, by products of matrices.

    Both are counted: rows are dealt evenly into as many tasks as their pairs ask for, and packs of queries are broadcast
    up to `most` bytes or dealt in blocks beyond, see against(). Two packs have about `cells` pairs, and at most so many.
    """
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(vector)), F.lit(0)).alias("size")).first()
    parts = -(-asked.n * rows.count() // pairs)
    wide = min(4 * PACK, max(1, asked.n)) if cells > PACK * PACK else PACK
    q = packed(queries.repartition(max(1, -(-asked.n // wide))), "_qp", wide)
    r = packed(rows.repartition(max(1, parts)), "_rp", max(1, cells // wide))

    def run(batches):
        last = None, None
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                a, b = a.as_py(), b.as_py()
                if last[0] != b:
                    last = b, load(b, vector)
                yield from work(load(a, vector), last[1])

    return against(q, r, bytes_a_row=min(wide, max(1, asked.n)) * (16 * max(0, asked.size) // max(1, asked.n) + 64), most=most).select("_qp", "_rp").mapInArrow(run, schema)


def best_of(score, order, k: int):
    """(row, column) of each row's k highest scores, of equal ones those of the least `order`; NaN is not taken."""
    import numpy as np

    n = score.shape[1]
    usable = ~np.isnan(score)
    low = np.where(usable, score, -np.inf)
    if n > k:
        edge = np.partition(low, n - k, axis=1)[:, n - k]
        usable &= low >= edge[:, None]  # ties of the last one stay until they are ordered
    row, column = np.nonzero(usable)
    by = np.lexsort((order[column], -score[row, column], row))
    row, column = row[by], column[by]
    starts = np.searchsorted(row, np.arange(score.shape[0]))
    first = np.arange(len(row)) - starts[row] < k
    return row[first], column[first]


#: A query's scores with the rows of one pack: codes are 2 * millionths + mark as int32; ids count from base, as uint32 or int64.
SCORE_PACK = "q long, base long, ids binary, codes binary"


def score_packs(query_ids, row_ids, score, mark):
    """Record batches of SCORE_PACK for scores (rounded to six places, at most 1000 in size; NaN: left out) and marks of all pairs."""
    import numpy as np
    import pyarrow as pa

    if not len(row_ids):
        return
    base = int(row_ids.min())
    ids = row_ids - base
    ids = ids.astype(np.uint32 if ids.max() < 2**32 else np.int64)
    there = ~np.isnan(score)
    codes = (np.rint(np.where(there, score, 0) * 1e6).astype(np.int64) * 2 + mark).astype(np.int32)
    packs = [(ids[t].tobytes(), c[t].tobytes()) for t, c in zip(there, codes, strict=True)]
    for i in range(0, len(packs), 256):
        a, b = zip(*packs[i : i + 256], strict=True)
        yield pa.RecordBatch.from_pydict({"q": query_ids[i : i + 256], "base": np.full(len(a), base), "ids": pa.array(a, pa.binary()), "codes": pa.array(b, pa.binary())})


def ranked_packs(packs: DataFrame, measure, schema: str) -> DataFrame:
    """What measure(query, scores, ids, marks) gives for each query, its rows sorted by falling score and then by id.

    A query's group holds 8 to 12 bytes a row: 7 MB for 600,000 rows.
    """

    def run(table):
        import numpy as np

        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.int32)
        own = []
        for base, ids, c in zip(table["base"].to_pylist(), table["ids"].to_pylist(), table["codes"].to_pylist(), strict=True):
            own.append(np.frombuffer(ids, np.uint32 if len(ids) == len(c) else np.int64).astype(np.int64) + base)
        ids = np.concatenate(own)
        by = np.lexsort((ids, -(codes >> 1)))
        codes, ids = codes[by], ids[by]
        return measure(table["q"][0].as_py(), (codes >> 1) / 1e6, ids, (codes & 1).astype(bool))

    return packs.groupBy("q").applyInArrow(run, schema)


def top_similar(queries: DataFrame, base: DataFrame, query: str, key: str, vector: str, k: int, threshold: float = 0.0, places: int = 12) -> DataFrame:
    """(query, key, score, rank): the k most similar rows of base for each query, itself excluded, by cosine of at least `threshold`.

    A stated set of queries goes against all rows, see compared(); scores are rounded to `places`, so that equal vectors
    tie wherever they are multiplied, and only the k best of each pack leave its task. Ties go by key.
    """
    asked = queries.select(F.col(query).alias("_q"), F.col(vector).alias("_v"))
    rows = base.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).alias("_v"))

    def work(q, r):
        import numpy as np
        import pyarrow as pa

        dots, score = products(q, r)
        score = rounded(score, places)
        with np.errstate(invalid="ignore"):
            score[np.isnan(dots) | (q.ids("_q")[:, None] == r.ids("_k")[None, :]) | (score < threshold)] = np.nan
        row, column = best_of(score, r.ids("_k"), k)
        yield pa.RecordBatch.from_pydict({"_q": q.columns["_q"].combine_chunks().take(pa.array(row)), "_k": r.columns["_k"].combine_chunks().take(pa.array(column)), "score": score[row, column]})

    types = dict(asked.dtypes) | dict(rows.dtypes)
    pairs = compared(asked.where("_q is not null"), rows, "_v", work, f"_q {types['_q']}, _k {types['_k']}, score double")
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "_k"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_q").alias("query"), F.col("_k").alias("match"), "score", "rank")


def all_pairs(queries: DataFrame, rows: DataFrame, key: str, vector: str, values, columns: str, apart: bool = True) -> DataFrame:
    """(i, j and `columns`, all doubles): what values(dot, cosine), two arrays of pairs, gives for each query with each row, or (`apart`) each row of another key.

    The rows of two packs leave in order of their cosine: neighbours have nearly the same values, so that the files of such
    rows, of which there are as many as pairs, take a fraction of the bytes. Batches have at most half a million pairs.
    """
    names = [c.strip() for c in columns.split(",")]

    def work(q, r):
        import numpy as np
        import pyarrow as pa

        i, j = (p.columns[key].combine_chunks() for p in (q, r))
        dots, score = products(q, r)
        n = len(j)
        dots, score = dots.ravel(), score.ravel()
        order = np.argsort(score)
        for at in range(0, len(order), 500_000):
            some = order[at : at + 500_000]
            out = {"i": i.take(pa.array(some // n)), "j": j.take(pa.array(some % n))} | {c: pa.array(x, from_pandas=True) for c, x in zip(names, values(dots[some], score[some]), strict=True)}
            batch = pa.RecordBatch.from_pydict(out)
            if apart:
                import pyarrow.compute as pc

                batch = batch.filter(pc.not_equal(batch.column(0), batch.column(1)))  # null: neither
            yield batch

    return compared(queries.select(key, vector), rows.select(key, vector), vector, work, "i long, j long, " + ", ".join(f"{c} double" for c in names), cells=SORTED_PAIRS)


def nearest_reference(vector: Column | str, references: dict[str, list[float]], least: float = 0.3, other: str = "general") -> Column:
    """The name of the most similar of a few given vectors, or `other` below `least`: one expression, no join."""
    scored = F.array(*[F.struct(cosine(vector, F.array(*[F.lit(float(x)) for x in v])).alias("score"), F.lit(name).alias("name")) for name, v in references.items()])
    best = F.array_max(scored)
    return F.when(best["score"] < least, other).otherwise(best["name"])
