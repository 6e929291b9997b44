"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.scratch import discard, materialize, remove_files, scratch_dir, scratch_path, shuffles_freed

__all__ = ["MOST_ID", "ROW", "STEP_BYTES", "counted_parts", "discard", "documents_of", "id_out", "materialize", "order_ids", "remove_files", "row_identity", "scratch_dir", "scratch_path", "shuffle_parts", "shuffles_freed", "table", "text_steps"]

#: Bytes of text that one vectorised step works on at a time; bounds a Python worker's memory.
STEP_BYTES = 2_000_000

#: Where ids are compared, a null one counts as this: larger than any id.
MOST_ID = np.iinfo(np.int64).max

#: What names a row: doc_id and 64 bits of its text, or, without a doc_id (known is false), 128 bits of the text. Rows that agree in it are equal in id and text.
ROW = ("doc_id", "known", "tag")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_identity(text: str = "text") -> list[F.Column]:
    """The columns of ROW: doc_id (of a row without one, 64 bits of its text), known (whether it has one) and tag."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("without id"), whole)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), F.xxhash64(whole).alias("tag")]


def documents_of(docs: DataFrame) -> DataFrame:
    """(doc_id, known, tag, text): other columns go, null texts become empty."""
    return docs.select(*row_identity(), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_out() -> F.Column:
    return F.when(F.col("known"), F.col("doc_id"))


def order_ids(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Ids to compare by: rows without one come last and are not smaller than each other."""
    return np.where(known, ids, MOST_ID)


def counted_parts(docs: DataFrame, bytes_a_part: int, least: int) -> int:
    """Parts of about so many bytes of text each, from the counted bytes of all texts; `least` at least."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    return max(least, -(-int(total) // bytes_a_part))


def text_steps(batch: pa.RecordBatch, column: str = "text", step: int = STEP_BYTES):
    """Yields (first row, last row + 1, bytes, offsets) of runs of rows of about `step` bytes of text (a longer text is a run of its own)."""
    if not batch.num_rows:
        return
    array = batch.column(column).cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64, count=array.offset + len(array) + 1)[array.offset :]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None and array.buffers()[2].size else np.zeros(0, np.uint8)
    row, n = 0, len(array)
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1)
        last = min(last, n)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last
