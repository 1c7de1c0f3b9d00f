"""A log replayed as a stream at a chosen speed: a streaming source whose offsets are times of the log."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Slice(InputPartition):
    """Rows of one file with times over ``low`` and up to ``high``, in microseconds."""

    path: str
    low: int
    high: int


class ReplayReader(DataSourceStreamReader):
    """The stream is at log time ``first + (now - begun) * speed``. When it began is kept in the file ``anchor``, so a restarted query goes on
    where the clock has got to instead of beginning again. A batch reads only row groups that its times reach into."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.column = schema, options["path"], options.get("column", "ts")
        self.speed, self.anchor = float(options["speed"]), options["anchor"]
        if self.speed <= 0:
            raise ValueError("speed must be over 0")
        self.spans = self._spans()
        self.first = min((low for _, low, _ in self.spans), default=0)
        self.last = max((high for _, _, high in self.spans), default=-1)
        self.begun = self._begun()

    def _spans(self) -> list[tuple[str, int, int]]:
        """Files with their least and greatest time: from their footers, or from the column where footers say nothing of it."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        import pyarrow.parquet as pq

        found = []
        data = ds.dataset(self.path, format="parquet")
        kind = pa.timestamp("us", data.schema.field(self.column).type.tz)
        for path in data.files:
            with data.filesystem.open_input_file(path) as f:
                file = pq.ParquetFile(f)
                meta = file.metadata
                at = meta.schema.names.index(self.column)
                ends = []
                for g in range(meta.num_row_groups):
                    stats = meta.row_group(g).column(at).statistics
                    if stats is None or not stats.has_min_max:
                        both = pc.min_max(file.read_row_group(g, [self.column]).column(0)).as_py()
                        stats_ends = [both["min"], both["max"]]
                    else:
                        stats_ends = [stats.min, stats.max]
                    ends += [pa.scalar(v, kind).value for v in stats_ends if v is not None]
                if ends:
                    found.append((path, min(ends), max(ends)))
        return found

    def _begun(self) -> float:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.anchor) if "://" in self.anchor else (fs.LocalFileSystem(), self.anchor)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(json.dumps({"begun": time.time()}).encode())
        with store.open_input_stream(path) as f:
            return json.loads(f.read())["begun"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": self.first - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"at": min(self.last, self.first + int((time.time() - self.begun) * self.speed * 1_000_000))}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        low, high = start["at"], end["at"]
        return [Slice(path, low, high) for path, a, z in self.spans if a <= high and z > low]

    def read(self, partition: Slice) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        data = ds.dataset(self.path, format="parquet")
        one = ds.dataset(partition.path, format="parquet", filesystem=data.filesystem)
        kind = one.schema.field(self.column).type
        edge = lambda v: pa.scalar(v, pa.timestamp("us", kind.tz)).cast(kind)
        due = (ds.field(self.column) > edge(partition.low)) & (ds.field(self.column) <= edge(partition.high))
        wanted = to_arrow_schema(self.schema)
        for batch in one.to_batches(columns=wanted.names, filter=due):
            if batch.num_rows:
                yield from pa.Table.from_batches([batch]).cast(wanted).to_batches()

    def commit(self, end: dict) -> None:
        pass


class Replay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def streamReader(self, schema: StructType) -> ReplayReader:  # noqa: N802
        return ReplayReader(schema, dict(self.options))


def replay_stream(spark: SparkSession, path: str, schema: str | StructType, speed: float, anchor: str, column: str = "ts") -> DataFrame:
    """The Parquet log under ``path`` as a stream, ``speed`` times as fast as its ``column`` tells time, with its own times. Rows without a time don't
    take part. ``anchor`` names a file that belongs to the run, as its checkpoint does; both paths must be ones that Arrow can
    open on driver and executors. A log laid out in order of time reads each file once."""
    spark.dataSource.register(Replay)
    return spark.readStream.format("replay").schema(schema).options(path=path, speed=str(speed), anchor=anchor, column=column).load()
