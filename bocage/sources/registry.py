"""Reference look-ups as a Spark data source: any in-house table served by keys, read in parallel slices.

Services that the network would answer (communes, geocoding, companies) are modelled as
registered reference tables; ``LookupSource`` shows how one is plugged in.
"""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bocage.functions.text import commune_key


class _Slice(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _FolderReader(DataSourceReader):
    def __init__(self, options, schema):
        self.folder, self.names = options["path"], [f.name for f in schema.fields]

    def partitions(self):
        return [_Slice(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".csv")]

    def read(self, partition):
        with open(partition.path, newline="", encoding="utf-8-sig") as f:
            for row in csv.DictReader(f):
                yield tuple(row.get(n) or None for n in self.names)


class LookupSource(DataSource):
    """``spark.read.format("bocage_lookup").schema(...).load(folder)``: a folder of CSV extracts, one slice a file."""

    @classmethod
    def name(cls):
        return "bocage_lookup"

    def schema(self):
        return "code string, name string"

    def reader(self, schema):
        return _FolderReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LookupSource)


def find_communes(communes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Communes whose name starts with or holds the query or that a postal code serves, largest first."""
    wanted, name = commune_key(F.lit(query)), commune_key(F.col("nom"))
    hit = F.when(name == wanted, 0).when(name.startswith(wanted), 1).when(name.contains(wanted), 2)
    if query.strip().isdigit():
        hit = F.when(F.array_contains("codes_postaux", query.strip()), 0)
    return communes.withColumn("rank", hit).where("rank IS NOT NULL").orderBy("rank", F.desc("population"), "code_insee").limit(limit)


def nearest_commune(communes: DataFrame, lon: float, lat: float) -> DataFrame:
    """Reverse look-up: the commune whose centre is closest."""
    from bocage.functions.geo import haversine_m

    metres = haversine_m(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))
    return communes.withColumn("distance_m", metres).orderBy("distance_m", "code_insee").limit(1)
