"""A table's changes as a stream whose offset is the sync mark: Spark keeps the mark in the query's checkpoint.

    spark.dataSource.register(Changes)
    spark.readStream.format("changes").option("column", "modified_at").load("/lake/files").writeStream.option("checkpointLocation", ...)

A trigger takes the rows whose ``column`` lies after the last mark, up to the greatest value there is; a query that is started again goes on
from where its checkpoint says. Marks come from the footers of the Parquet files; files without
newer rows aren't opened by tasks (write ``spark.sql.parquet.outputTimestampType`` TIMESTAMP_MICROS: INT96 has no statistics). Each file with news is one partition, its row groups filtered by their statistics.

Rows with a null in ``column`` have no place in the order and are never given; a row that arrives later than another of the same value, when
that value is the mark already, isn't given either: write new rows with newer values. The folder must be readable by executors under the same path or URI.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

EPOCH = datetime.datetime(1970, 1, 1)


def number(value) -> int:
    """A mark as JSON can hold it: microseconds of a timestamp, days of a date, else the whole number itself."""
    if isinstance(value, datetime.datetime):
        return (value.replace(tzinfo=None) - EPOCH) // datetime.timedelta(microseconds=1)
    if isinstance(value, datetime.date):
        return (value - EPOCH.date()).days
    return int(value)


def spark_field(f: pa.Field) -> pa.Field:
    """Spark has timestamps of microseconds only."""
    return f.with_type(pa.timestamp("us", f.type.tz)) if pa.types.is_timestamp(f.type) else f


@dataclass
class Part(InputPartition):
    path: str
    after: int | None
    upto: int


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.column, self.names = options["path"], options["column"], schema.names

    def newest(self) -> dict[str, int]:
        """The greatest value of each file that has any: from its footer, or from the column itself where the footer holds no statistics (as for INT96 timestamps)."""
        out = {}
        for piece in ds.dataset(self.path, format="parquet").get_fragments():
            at = piece.metadata.schema.to_arrow_schema().get_field_index(self.column)
            columns = [piece.metadata.row_group(g).column(at) for g in range(piece.metadata.num_row_groups)]
            if all(c.physical_type != "INT96" and c.statistics is not None and c.statistics.has_min_max for c in columns):
                values = [c.statistics.max for c in columns]
            else:
                values = [pc.max(piece.to_table(columns=[self.column]).column(0)).as_py()]
            if values := [number(v) for v in values if v is not None]:
                out[piece.path] = max(values)
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mark": None}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"mark": max(self.newest().values(), default=None)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["mark"] is None:
            return []
        return [Part(p, start["mark"], end["mark"]) for p, most in sorted(self.newest().items()) if start["mark"] is None or most > start["mark"]]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        piece = ds.dataset(partition.path, format="parquet")
        kind = piece.schema.field(self.column).type
        mark = lambda n: pa.scalar(n, pa.int64()).cast(pa.timestamp("us")).cast(kind, safe=False) if pa.types.is_timestamp(kind) else pa.scalar(n).cast(pa.int32()).cast(kind) if pa.types.is_date(kind) else pa.scalar(n).cast(kind)
        # finer timestamps than microseconds: the upper end takes the whole microsecond
        rows = ds.field(self.column) <= mark(partition.upto)
        if partition.after is not None:
            rows = rows & (ds.field(self.column) > mark(partition.after))
        for batch in piece.to_batches(columns=self.names, filter=rows):
            yield batch.cast(pa.schema([spark_field(f) for f in batch.schema]))

    def commit(self, end: dict) -> None:
        pass


class Changes(DataSource):
    """Options: path (a folder of Parquet files, or one) and column."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> StructType:
        return from_arrow_schema(ds.dataset(self.options["path"], format="parquet").schema)

    def streamReader(self, schema: StructType) -> ChangesReader:  # noqa: N802
        return ChangesReader(self.options, schema)
