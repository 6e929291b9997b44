"""Remote services as table operators: any client can be passed in, each has an offline default."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T


class ClientError(Exception):
    """A request that must not be tried again."""


def with_retries(call: Callable[..., Any], attempts: int = 3, delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Any]:
    """call, tried again after delay, 2 * delay and so on unless it raises a ClientError; None when all attempts fail."""

    def run(*args: Any) -> Any:
        for n in range(attempts):
            try:
                return call(*args)
            except ClientError:
                raise
            except Exception:  # a server's or the network's fault
                if n + 1 < attempts:
                    sleep(delay * 2**n)
        return None

    return run


def request(df: DataFrame, columns: list[str], schema: str, client: Callable[..., dict | None], attempts: int = 3) -> DataFrame:
    """df's rows with the fields that client(values of columns) returns, nulls where it fails; one client for each partition."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator) -> Iterator:
        call = with_retries(client, attempts)
        for pdf in frames:
            found = [call(*row) or {} for row in pdf[columns].itertuples(index=False)]
            yield pdf.assign(**{n: [x.get(n) for x in found] for n in names})

    return df.mapInPandas(run, f"{out}, {schema}")


def summarize(df: DataFrame, text: str, sentences: int = 2, most: int = 8000) -> DataFrame:
    """df with summary: the offline default takes the longest sentences of the first `most` characters, in order."""
    parts = F.filter(F.transform(F.split(F.substring(text, 1, most), r"(?<=[.!?])\s+"), T.strip), lambda s: s != "")
    numbered = F.transform(parts, lambda s, i: F.struct((-F.length(s)).alias("l"), i.alias("i"), s.alias("s")))
    best = F.slice(F.array_sort(numbered), 1, sentences)
    ordered = F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    return df.withColumn("summary", F.array_join(F.transform(ordered, lambda x: x["s"]), " "))
