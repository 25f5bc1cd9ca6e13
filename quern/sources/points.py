"""A data source that reads a store of points page by page: ranges of ids are partitions, filters are asked of the store."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

NAME = "quern_points"
PAGE = 128  # points of a page


class Range(InputPartition):
    """Ids from low up to, but without, high; the first range has null ids too."""

    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class Folder:
    """A store that is a folder of Parquet files, which pyarrow can read, here and in the tasks: columns, least and greatest id, and pages of points."""

    def __init__(self, path: str) -> None:
        self.data = ds.dataset(path, format="parquet", partitioning="hive")

    def schema(self) -> pa.Schema:
        return self.data.schema

    def ends(self, key: str) -> tuple[int, int] | None:
        """From the files' footers, so no point is read; None if none has an id."""
        found = []
        for f in self.data.get_fragments():
            for g in f.row_groups:
                s = (g.statistics or {}).get(key)
                found += [s["min"], s["max"]] if s else []
        return (min(found), max(found)) if found else None

    def pages(self, asked: pc.Expression | None, size: int) -> Iterator[pa.RecordBatch]:
        yield from self.data.scanner(filter=asked, batch_size=size).to_batches()


def expression(f: Filter) -> pc.Expression | None:
    """What a store is asked for a filter; None if it can't be asked."""
    if isinstance(f, (IsNull, IsNotNull)):
        null = ds.field(*f.attribute).is_null()
        return null if isinstance(f, IsNull) else ~null
    if isinstance(f, In):
        return ds.field(*f.attribute).isin(list(f.value)) if None not in f.value else None
    compare = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}.get(type(f))
    if isinstance(f, EqualNullSafe):
        return ds.field(*f.attribute).is_null() if f.value is None else ds.field(*f.attribute) == f.value
    return getattr(ds.field(*f.attribute), compare)(f.value) if compare and f.value is not None else None


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.key = options["path"], options.get("key", "id")
        self.page, self.parts = int(options.get("page", PAGE)), int(options.get("partitions", 8))
        self.asked: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what the store can be asked; the others go back to Spark."""
        for f in filters:
            if expression(f) is None:
                yield f
            else:
                self.asked.append(f)

    def partitions(self) -> list[InputPartition]:
        ends = Folder(self.path).ends(self.key)
        if ends is None:
            return [Range(None, None)]
        low, high = ends
        step = max(1, -(-(high - low + 1) // self.parts))
        cuts = list(range(low + step, high + 1, step))
        return [Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        key, asked = ds.field(self.key), [expression(f) for f in self.asked]
        if partition.low is not None:
            asked.append(key >= partition.low)
        if partition.high is not None:
            asked.append((key < partition.high) | key.is_null() if partition.low is None else key < partition.high)
        every = None
        for e in asked:
            every = e if every is None else every & e
        yield from Folder(self.path).pages(every, self.page)


class Points(DataSource):
    """spark.read.format("quern_points").load(folder): the points of a store, of which a task reads a range of ids, `page` at a time.

    Options: path; key, the column of ids (id); partitions, ranges of ids (8); page, points held at once (128). Filters on columns are asked of the store
    where spark.sql.python.filterPushdown.enabled is set. Ranges are of equal width between the least and the greatest id.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return from_arrow_schema(Folder(self.options["path"]).schema())

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, which then pushes filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Points)
