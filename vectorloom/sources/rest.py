"""A data source for analyses over HTTP: spark.read.format("dic_rest"), one partition an analysis.

Options: base_url (http://host:port), dic_ids (comma-separated), path (default API/dic/{id}/), timeout in seconds.
Rows: frame long, body string. A response other than 200 is an error."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Analysis(InputPartition):
    def __init__(self, dic_id: int):
        super().__init__(dic_id)
        self.dic_id = dic_id


class RestReader(DataSourceReader):
    def __init__(self, options):
        self.base = options.get("base_url", "").rstrip("/")
        self.path = options.get("path", "API/dic/{id}/")
        self.timeout = float(options.get("timeout", "60"))
        self.ids = [int(x) for x in options.get("dic_ids", "").split(",") if x.strip()]
        if not self.base:
            raise ValueError("base_url is needed")

    def partitions(self):
        return [Analysis(i) for i in self.ids]

    def read(self, partition):
        from urllib.request import urlopen

        url = f"{self.base}/{self.path.format(id=partition.dic_id)}"
        with urlopen(url, timeout=self.timeout) as response:
            if response.status != 200:
                raise ValueError(f"analysis {partition.dic_id}: HTTP {response.status}")
            yield (partition.dic_id, response.read().decode("utf-8"))


class RestSource(DataSource):
    @classmethod
    def name(cls):
        return "dic_rest"

    def schema(self):
        return "frame long, body string"

    def reader(self, schema):
        return RestReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RestSource)
