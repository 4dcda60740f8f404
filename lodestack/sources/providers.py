"""Providers of candidates as data sources that Spark reads, in batches and as streams.

A provider gives its results in pages: ``pages`` lists their tokens, ``read`` gives the rows of one.  Every
page is a partition.  New pages come after the known ones, so a stream's offset is the number of pages
that were read, and a stream that is started again from its checkpoint goes on with the next page.
Filters for equality reach ``read``; Spark applies them again, so a provider may use them or not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from lodestack.scratch import ship

Pages = Callable[[dict[str, str]], Sequence[str]]
Read = Callable[[dict[str, str], str, dict[str, object]], Iterator[tuple]]


class Page(InputPartition):
    def __init__(self, token: str):
        super().__init__(token)
        self.token = token


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], pages: Pages, read: Read):
        self.options, self.pages, self.rows, self.wanted = options, pages, read, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo):
                self.wanted[".".join(f.attribute)] = f.value
            yield f  # Spark checks all of them

    def partitions(self) -> Sequence[InputPartition]:
        return [Page(p) for p in self.pages(self.options)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(self.options, partition.token, self.wanted)


class PageStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], pages: Pages, read: Read):
        self.options, self.pages, self.rows = options, pages, read

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(self.pages(self.options))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Page(p) for p in self.pages(self.options)[start["pages"] : end["pages"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(self.options, partition.token, {})


def register_provider(spark: SparkSession, name: str, schema: str, pages: Pages, read: Read) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read a provider.

    ``pages(options)`` gives page tokens, oldest first; ``read(options, token, wanted)`` gives rows as
    tuples in the order of ``schema``, where ``wanted`` has the values of columns that the query asks for."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    class Provider(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return PageReader(dict(self.options), pages, read)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return PageStream(dict(self.options), pages, read)

    spark.dataSource.register(Provider)
