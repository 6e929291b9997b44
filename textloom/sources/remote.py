"""A data source for services over HTTP: spark.read.format("textloom_http") in partitions of pages, df.write.format("textloom_http") in parts that a commit makes visible."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from textloom.sources import services
from textloom.sources.http import Endpoint


class Calls:
    """Requests of one task to one address: no more than `rate` a second (0: no limit), tried again with growing pauses."""

    def __init__(self, options: dict[str, str]) -> None:
        self.endpoint = Endpoint(options["url"], timeout=float(options.get("timeout", 30)))
        self.pause = 1 / float(options["rate"]) if float(options.get("rate", 0)) else 0.0
        self.call = services.with_retries(self.endpoint, int(options.get("attempts", 3)), float(options.get("delay", 0.5)))
        self.next = 0.0

    def __call__(self, body: dict) -> dict:
        if self.pause:
            now = time.monotonic()
            time.sleep(max(0.0, self.next - now))
            self.next = max(now, self.next) + self.pause
        answer = self.call(body)
        if answer is None:
            raise ConnectionError(f"no answer from {self.endpoint.url}")
        return answer


@dataclass
class Pages(InputPartition):
    first: int
    step: int


class Reader(DataSourceReader):
    """Partition i of n asks for pages i, i + n and so on, until one is not full: {"read": {"page", "size"}} -> {"rows": [...]}."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.names = options, schema.names

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", 4))
        return [Pages(i, n) for i in range(n)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        call, size, page = Calls(self.options), int(self.options.get("size", 100)), partition.first
        while True:
            rows = call({"read": {"page": page, "size": size}}).get("rows", [])
            for r in rows:
                yield tuple(r.get(n) for n in self.names)
            if len(rows) < size:
                return
            page += partition.step


@dataclass
class Part(WriterCommitMessage):
    partition: int
    rows: int


class Writer(DataSourceWriter):
    """Each task stages its rows in batches: {"stage": {"job", "partition", "batch", "rows"}}. A batch has the same name whichever attempt sends it, so a service that keeps one for each name has no row twice; {"commit": {"job", "parts"}} makes the job's parts visible, {"abort": {"job"}} drops them."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.job = options, options.get("job") or uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        call, size = Calls(self.options), int(self.options.get("size", 100))
        partition, held, batch, total = TaskContext.get().partitionId(), [], 0, 0
        for row in rows:
            held.append(json.loads(json.dumps(row.asDict(recursive=True), default=str)))
            if len(held) == size:
                call({"stage": {"job": self.job, "partition": partition, "batch": batch, "rows": held}})
                total, batch, held = total + len(held), batch + 1, []
        if held:
            call({"stage": {"job": self.job, "partition": partition, "batch": batch, "rows": held}})
            total += len(held)
        return Part(partition, total)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        parts = [{"partition": m.partition, "rows": m.rows} for m in messages if m is not None]
        Calls(self.options)({"commit": {"job": self.job, "parts": parts}})

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        Calls(self.options)({"abort": {"job": self.job}})


class Http(DataSource):
    """Options: url; partitions (of a read); size (rows of a page or batch); rate (requests a second and task), attempts, delay, timeout; job (name of a write). The schema of a read is given by the reader."""

    @classmethod
    def name(cls) -> str:
        return "textloom_http"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Http)
