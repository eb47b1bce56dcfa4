"""A data source of Parquet footers: a partition a file, a row a column."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_type

SCHEMA = "path string, position int, name string, type string, rows long, nulls long, least string, largest string"


class FooterSource(DataSource):
    """Option ``paths``: a JSON list of files, in any store that Arrow opens."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FooterReader(json.loads(self.options["paths"]))


class FooterReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        given = partition.value
        uri = urlparse(given)
        store, path = (pafs.LocalFileSystem(), unquote(uri.path)) if uri.scheme in ("", "file") else pafs.FileSystem.from_uri(given)
        with store.open_input_file(path) as file:
            found = pq.ParquetFile(file)
            footer, fields = found.metadata, found.schema_arrow
            leaves = [footer.schema.column(i).path.split(".")[0] for i in range(footer.num_columns)]
            for position, field in enumerate(fields):
                own = [i for i, leaf in enumerate(leaves) if leaf == field.name]
                stats = [footer.row_group(g).column(own[0]).statistics for g in range(footer.num_row_groups)] if len(own) == 1 else []
                nulls = sum(s.null_count for s in stats) if stats and all(s is not None and s.has_null_count for s in stats) else None
                told = [s for s in stats if s is not None and s.has_min_max]
                least, largest = (min(s.min for s in told), max(s.max for s in told)) if told and len(told) == len(stats) else (None, None)
                yield given, position, field.name, from_arrow_type(field.type).simpleString(), footer.num_rows, nulls, None if least is None else str(least), None if largest is None else str(largest)
