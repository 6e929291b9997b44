"""Removal of repeated lines: levelled sorted runs of line hashes, against which each new batch is merged. DataFrame functions only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import ROW, documents_of, materialize, remove_files, scratch_path, shuffles_freed

#: What is stripped from a line's ends, and the letters that are lower-cased.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Settings while runs are merged: a join trusts that the one file of each bucket is sorted, as append() writes it, and an anti-join isn't moved below the aggregate that makes one row of each hash of a batch.
MERGING = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin"}

KEY = ["one", "two"]


def lines_of(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, known, tag, pos, one, two): each line whose key has at least so many characters, its number in the text and 128 bits of its key.

    The key is the line without ASCII white space at its ends, A-Z in lower case.
    """
    split = documents_of(docs).select(*ROW, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = split.select(*ROW, "pos", F.translate(F.trim("line", F.lit(BLANKS)), UPPER, UPPER.lower()).alias("key")).where(F.length("key") >= least)
    return keyed.select(*ROW, "pos", F.xxhash64("key").alias("one"), F.xxhash64(F.lit("two"), "key").alias("two"))


class Runs:
    """Runs of (one, two, owner): the hashes of lines and the least id of a document that holds each, of all batches so far.

    A run is a table bucketed and sorted by its hashes, so that a batch is merged against it without a shuffle of the
    run. No hash is in two runs. A batch adds a run at level 0; `fanout` runs of a level are merged into one of the next,
    so there are at most (fanout - 1) * log(batches) of them. Batches must come in ascending order of ids.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as a shuffle of a batch has
        self.levels: list[list[tuple[str, str]]] = []

    @contextmanager
    def _merging(self) -> Iterator[None]:
        before = {k: self.spark.conf.get(k, None) for k in MERGING}
        for k, v in MERGING.items():
            self.spark.conf.set(k, v)
        try:
            with shuffles_freed(self.spark):
                yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _add(self, rows: DataFrame, level: int) -> None:
        name, path = f"textloom_run_{uuid.uuid4().hex}", scratch_path(self.spark, "run")
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_files(self.spark, path)

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def append(self, lines: DataFrame) -> None:
        """Adds a batch: its hashes, one row each, without those that a run has already (merge anti-joins, one after the other on one partitioning)."""
        fresh = lines.where("known").groupBy(*KEY).agg(F.min("doc_id").alias("owner"))
        with self._merging():
            for run in self.tables():
                fresh = fresh.join(run.hint("merge"), KEY, "left_anti")
            self._add(fresh, 0)
            level = 0
            while len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                # hashes are in one run each, so all rows stay; Spark doesn't keep the buckets of a union
                merged = self._union([self.spark.table(name) for name, _ in full]).repartition(self.buckets, *KEY)
                self._add(merged, level + 1)
                self._drop(full)
                level += 1

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def repeats(self, lines: DataFrame) -> DataFrame:
        """The lines, of batches that were appended, which a document with a smaller id holds; a row without an id counts as larger than any. A frequent line is a skewed partition of a join, which Spark splits."""
        return lines.join(self._union(self.tables()), KEY).where(~F.col("known") | (F.col("doc_id") > F.col("owner"))).drop("owner")

    def drop(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def batch_of(docs: DataFrame, batches: int) -> F.Column:
    """The batch of a row by its id: ranges of about as many rows, cut at approximate quantiles; rows without an id are in the last one."""
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*[F.lit(s) for s in shares]), 10_000).alias("c")).first().c if shares else None
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + (F.col("doc_id") > cut).cast("int")
    return F.when(F.col("known"), batch).otherwise(batches - 1)


def dropped(docs: DataFrame, least: int = 10, batches: int = 6, fanout: int = 4) -> DataFrame:
    """(doc_id, known, tag, gone): the numbers of the lines that go, of each document that loses any. A table in the shared folder."""
    spark = docs.sparkSession
    lines = materialize(spark, lines_of(docs, least).withColumn("batch", batch_of(docs, batches)), by=["batch"])
    runs = Runs(spark, fanout)
    for b in range(batches):
        runs.append(lines.where(F.col("batch") == b))
    # equal rows have equal numbers: a set has as many of them as the text has lines
    gone = materialize(spark, runs.repeats(lines).groupBy(*ROW).agg(F.collect_set("pos").alias("gone")), lines)
    runs.drop()
    return gone


def dedup(docs: DataFrame, least: int = 10, batches: int = 6, fanout: int = 4, with_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256[, kept_text]): each text without the lines that a document with a smaller doc_id has too.

    A line is compared by its key (lines_of()); lines with keys of fewer than `least` characters always stay. The table
    is worked on as `batches` ranges of ids, a fixed number, so each line is merged a bounded number of times: only
    hashes are sorted and shuffled for that, one row for each distinct line of a batch. Then each text is joined once
    with the numbers of its lines that go.

    A null text is an empty line, as an empty text is. A null doc_id counts as larger than any other and is returned as
    null (rows without one take nothing from each other); lines don't repeat within one doc_id; rows with equal id and
    text get equal results; an empty table gives an empty result; other columns are ignored.
    """
    gone = dropped(docs, least, batches, fanout)
    split = documents_of(docs).join(gone, list(ROW), "left").select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), F.split("text", "\n", -1).alias("lines"), "gone")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = split.withColumn("left", F.when(F.col("gone").isNull(), every).otherwise(F.array_except(every, F.col("gone"))))
    text = F.array_join(F.transform("left", lambda p: F.get("lines", p)), "\n")
    out = kept.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"), text.alias("kept_text"))
    out = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "kept_text")
    return out if with_text else out.drop("kept_text")
