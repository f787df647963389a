"""Web search as a pluggable source: ``spark.read.format("product_search")``.  Offline it reads what a provider was given."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SearchSource(DataSource):
    """Options: queries (JSON array of texts) and provider (module:function from a text to rows of title, url, price).

    One partition for each query, so that slow providers run side by side; without a provider there are no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "product_search"

    def schema(self) -> str:
        return "query string, rank int, title string, url string, price double"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(json.loads(self.options.get("queries", "[]")), self.options.get("provider", ""))


class SearchReader(DataSourceReader):
    def __init__(self, queries: list, provider: str):
        self.queries, self.provider = queries, provider

    def partitions(self) -> list:
        return [InputPartition(q) for q in self.queries] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None or not self.provider:
            return
        from importlib import import_module

        module, _, function = self.provider.partition(":")
        for k, (title, url, price) in enumerate(getattr(import_module(module), function)(partition.value), 1):
            yield partition.value, k, title, url, price


def register(spark) -> None:
    spark.dataSource.register(SearchSource)
