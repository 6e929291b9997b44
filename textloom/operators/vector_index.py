"""A stored index for similar vectors: inverted lists about centres, residuals as product codes, and exact rescoring."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.vectors import dot, top_similar, unit
from textloom.sources.scratch import materialize

#: Vectors that centres and codes are fitted on at most; rows of a list, and queries, that one group has at most.
SAMPLE, SLAB, ASKED = 50_000, 100_000, 1_000
ENTRY = "list int, slab int, key long, code binary, vector array<double>"


def means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k centres of the rows by Lloyd's rounds from distinct rows; a centre without rows stays."""
    own = np.unique(x, axis=0)
    centres = own[rng.permutation(len(own))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, d], len(centres)) for d in range(x.shape[1])], axis=1)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = ((centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T).argmin(1)
    return out


def _fit(x: np.ndarray, lists: int, parts: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centres of the lists, and codebooks of at most 256 entries for each part of the residuals."""
    rng = np.random.default_rng(seed)
    centres = means(x, lists, rng)
    rest = x - centres[nearest(x, centres)]
    return centres, [means(p, 256, rng) for p in np.array_split(rest, parts, axis=1)]


def build(df: DataFrame, path: str, key: str, vector: str, lists: int | None = None, parts: int = 16, sample: int = SAMPLE, seed: int = 0) -> None:
    """Writes the index of all rows to `path`: centres and codebooks, and entries in folders by list, in slabs of at most about SLAB rows.

    Centres and codebooks are fitted on `sample` rows at most, those of the least hashes of their keys; the number of
    lists is the square root of the rows, bounded by the sample, or as given. Vectors are taken at length 1. Keys are
    distinct numbers; rows without a vector are left out.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), unit(vector).alias("vector"))
    drawn = rows.orderBy(F.xxhash64(F.col("key") + seed)).limit(sample).collect()  # a bounded sample
    n = len(drawn) if len(drawn) < sample else rows.count()
    x = np.array([r.vector for r in drawn], float) if drawn else np.zeros((1, parts))
    lists = lists or max(1, min(int(math.sqrt(n)), len(drawn) // 16, 4096))
    centres, books = _fit(x, lists, min(parts, x.shape[1]), seed)
    if not drawn:  # centres of no size, to which no entry belongs
        centres, books = centres[:0], []
    spark.createDataFrame(pd.DataFrame({"name": ["centres", *[f"book {i:03d}" for i in range(len(books))]], "rows": [len(a) for a in (centres, *books)], "data": [np.ascontiguousarray(a, "<f8").tobytes() for a in (centres, *books)]})).write.parquet(f"{path}/model")
    shared = spark.sparkContext.broadcast((centres, books))  # bounded by the sample
    slabs = max(1, -(-n // SLAB))

    def coded(frames):
        own, parts_of = shared.value
        for f in frames:
            v = np.stack(f["vector"].to_numpy()) if len(f) else np.zeros((0, own.shape[1]))
            at = nearest(v, own)
            codes = np.stack([nearest(p, b) for p, b in zip(np.array_split(v - own[at], len(parts_of), axis=1), parts_of, strict=True)], axis=1).astype(np.uint8)
            yield pd.DataFrame({"list": at.astype(np.int32), "slab": np.zeros(len(f), np.int32), "key": f["key"], "code": [c.tobytes() for c in codes], "vector": f["vector"]})

    entries = materialize(spark, rows.mapInPandas(coded, ENTRY))
    sizes = entries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SLAB).cast("int").alias("slabs"))  # one row a list
    dealt = entries.drop("slab").join(F.broadcast(sizes), "list").withColumn("slab", F.pmod(F.xxhash64("key"), F.col("slabs")).cast("int"))
    parts_of_table = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slabs)
    ordered = dealt.select(*[c.split()[0] for c in ENTRY.split(", ")]).repartitionByRange(parts_of_table, "list", "slab", "key").sortWithinPartitions("list", "slab", "key")
    ordered.write.partitionBy("list").parquet(f"{path}/entries")


def _model(spark: SparkSession, path: str) -> tuple[np.ndarray, list[np.ndarray]]:
    found = {r.name: np.frombuffer(r.data, "<f8").reshape(r.rows, -1 if r.rows else 0) for r in spark.read.parquet(f"{path}/model").collect()}
    return found["centres"], [found[n] for n in sorted(found) if n != "centres"]


def entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(f"{path}/entries")


def search(spark: SparkSession, path: str, queries: DataFrame, query: str, vector: str, k: int = 10, probes: int = 8, rescored: int = 10, threshold: float = -1.0) -> DataFrame:
    """(query, match, score, rank): the k entries with the highest cosine to each query, itself (the entry with its key) excluded, as far as its `probes` nearest lists have them.

    Only folders of probed lists are read, and of these first the codes: each group of a list's slab and of queries that
    probe it gives the `rescored` * k best by codes for each query, of which the best are scored exactly by their
    vectors. probes=None is the exact way: all entries are scored.
    """
    if probes is None:
        whole = entries(spark, path).select(F.col("key").alias("_k"), "vector")
        return top_similar(queries, whole.withColumnRenamed("vector", vector), query, "_k", vector, k, threshold)
    centres, books = _model(spark, path)
    if not len(centres):
        return spark.createDataFrame([], "query long, match long, score double, rank int")
    shared = spark.sparkContext.broadcast((centres, books))
    asked = queries.where(F.col(query).isNotNull() & F.col(vector).isNotNull()).select(F.col(query).cast("long").alias("query"), unit(vector).alias("qv"))

    def probed(frames):
        own, _ = shared.value
        for f in frames:
            v = np.stack(f["qv"].to_numpy()) if len(f) else np.zeros((0, own.shape[1]))
            far = (own**2).sum(1) - 2 * v @ own.T
            n = min(probes, len(own))
            lists = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(own) else np.tile(np.arange(n), (len(f), 1))
            yield pd.DataFrame({"list": lists.ravel().astype(np.int32), "query": np.repeat(f["query"].to_numpy(), n), "qv": np.repeat(f["qv"].to_numpy(), n)})

    wanted = materialize(spark, asked.mapInPandas(probed, "list int, query long, qv array<double>"))
    lists = [r.list for r in wanted.select("list").distinct().collect()]  # as many as there are lists
    own = entries(spark, path).where(F.col("list").isin(lists))
    slabs = entries(spark, path).where(F.col("list").isin(lists)).select("list", "slab").distinct()
    blocks = wanted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("blocks"))  # one row a list
    ask = wanted.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).join(slabs, "list")
    group = ["list", "slab", "block"]
    scan = own.select("list", "slab", "key", "code").join(F.broadcast(blocks.withColumnRenamed("list", "_list")), F.col("list") == F.col("_list")).drop("_list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    most = k * rescored

    def best(a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(e):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "list": np.zeros(0, np.int32), "rough": np.zeros(0)})
        own, parts_of = shared.value
        at = int(a["list"].iloc[0])
        codes = np.frombuffer(b"".join(e["code"]), np.uint8).reshape(len(e), -1)
        q = np.stack(a["qv"].to_numpy())
        near = q @ own[at]
        out = []
        tables = [p @ b.T for p, b in zip(np.array_split(q, len(parts_of), axis=1), parts_of, strict=True)]
        keys = e["key"].to_numpy()
        for i, name in enumerate(a["query"].to_numpy()):
            score = near[i] + sum(t[i][codes[:, p]] for p, t in enumerate(tables))
            top = np.argpartition(-score, most - 1)[:most] if len(score) > most else np.arange(len(score))
            out.append(pd.DataFrame({"query": name, "key": keys[top], "list": np.int32(at), "rough": score[top]}))
        return pd.concat(out)

    rough = ask.select(*group, "query", "qv").groupBy(*group).cogroup(scan.select(*group, "key", "code").groupBy(*group)).applyInPandas(best, "query long, key long, list int, rough double")
    order = Window.partitionBy("query").orderBy(F.desc("rough"), "key")
    candidates = rough.where(F.col("query") != F.col("key")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("query", "list", "key")
    exact = candidates.join(own.select("list", "key", "vector"), ["list", "key"]).join(asked, "query").select("query", F.col("key").alias("match"), dot("qv", "vector").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "match"))
    return exact.where(F.col("score") >= threshold).withColumn("rank", rank).where(F.col("rank") <= k).select("query", "match", "score", "rank")
