"""Models that turn texts into vectors, terms or labels: one interface, loaded once a worker, each text asked for once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.scratch import materialize

#: Models of this worker, by name and version.
_loaded: dict[tuple[str, str], Callable] = {}


@dataclass(frozen=True)
class Provider:
    """load() gives a model: a function of a list of texts that returns a list of values of the Spark type `returns`. A name and version must mean one model, as answers are kept under them."""

    name: str
    version: str
    load: Callable[[], Callable[[list[str]], list[Any]]]
    returns: str
    batch: int = 64

    def model(self) -> Callable[[list[str]], list[Any]]:
        key = (self.name, self.version)
        if key not in _loaded:
            _loaded[key] = self.load()
        return _loaded[key]


def infer(df: DataFrame, text: str, provider: Provider, out: str) -> DataFrame:
    """df with the model's value of each row's text. Arrow batches, `batch` texts at a time; null texts have null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider.model()
        for texts in batches:
            known = texts[texts.notna()]
            values: list[Any] = []
            for i in range(0, len(known), provider.batch):
                values += model(known.iloc[i : i + provider.batch].tolist())
            if len(values) != len(known):
                raise ValueError(f"{provider.name} gave {len(values)} values for {len(known)} texts")
            found = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            found[texts.notna()] = pd.Series(values, index=known.index, dtype=object)
            yield found

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, provider.returns)(F.col(text)))


def _cached(spark: SparkSession, path: str, returns: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(f"one long, two long, value {returns}").parquet(path)


def answers(df: DataFrame, text: str, provider: Provider, out: str, cache: str | None = None) -> DataFrame:
    """df with the model's value of each row's text, each distinct text asked for once; with `cache`, a folder, only texts whose 128-bit hash it lacks, whose answers are added to it.

    The cache has a folder for each provider and version. Rows get their values by a join on the hash: a frequent text
    is a skewed partition, which Spark splits. Null texts have null.
    """
    spark = df.sparkSession
    named = df.withColumns({"_one": F.xxhash64(text), "_two": F.xxhash64(F.lit("two"), F.col(text))})
    asked = named.where(F.col(text).isNotNull()).select(F.col("_one").alias("one"), F.col("_two").alias("two"), F.col(text).alias("_text")).dropDuplicates(["one", "two"])
    path = f"{cache}/{provider.name}-{provider.version}" if cache else None
    known = _cached(spark, path, provider.returns) if path else None
    if known is not None:
        asked = asked.join(known.select("one", "two"), ["one", "two"], "left_anti")
    new = materialize(spark, infer(asked, "_text", provider, "value").select("one", "two", "value"))
    if path:
        new.write.mode("append").parquet(path)
        known = _cached(spark, path, provider.returns).dropDuplicates(["one", "two"])
    else:
        known = new
    values = known.select(F.col("one").alias("_one"), F.col("two").alias("_two"), F.col("value").alias(out))
    return named.join(values, ["_one", "_two"], "left").drop("_one", "_two")


# ---- offline providers -------------------------------------------------------------------------------------------


def hash_embedder(size: int = 16) -> Provider:
    """Vectors of length 1 from digests of the text: the stand-in for a sentence encoder."""

    def load() -> Callable[[list[str]], list[list[float]]]:
        import hashlib

        import numpy as np

        def model(texts: list[str]) -> list[list[float]]:
            raw = np.array([[int(hashlib.md5(f"|{t}|{i}".encode()).hexdigest()[:8], 16) for i in range(size)] for t in texts], float).reshape(-1, size) / 2147483648.0 - 1.0
            length = np.linalg.norm(raw, axis=1, keepdims=True)
            return (raw / np.where(length > 0, length, 1)).tolist()

        return model

    return Provider("hash_embedder", str(size), load, "array<double>")


def word_generator(most: int = 5, least: int = 6) -> Provider:
    """The first distinct words of enough letters: the stand-in for a sequence model that writes terms."""

    def load() -> Callable[[list[str]], list[list[str]]]:
        import re

        word = re.compile(f"[a-z]{{{least},}}")
        return lambda texts: [list(dict.fromkeys(word.findall(t.lower())))[:most] for t in texts]

    return Provider("word_generator", f"{most}.{least}", load, "array<string>")


def pooled_embedder(size: int = 16) -> Provider:
    """The mean of the vectors of a text's words, at length 1: the stand-in for a pooled encoder of code."""

    def load() -> Callable[[list[str]], list[list[float]]]:
        import re

        import numpy as np

        inner = hash_embedder(size).load()
        known: dict[str, Any] = {}  # vectors of words met before: texts repeat most of theirs

        def model(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                words = re.findall(r"\w+", t)
                if len(known) > 200_000:
                    known.clear()
                new = [w for w in dict.fromkeys(words) if w not in known]
                known.update(zip(new, np.array(inner(new)).reshape(-1, size), strict=True))
                mean = np.mean([known[w] for w in words], axis=0) if words else np.zeros(size)
                length = np.linalg.norm(mean)
                out.append((mean / length if length else mean).tolist())
            return out

        return model

    return Provider("pooled_embedder", str(size), load, "array<double>")
