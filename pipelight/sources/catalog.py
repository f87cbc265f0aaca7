"""Names of indexes and lookup tables, and how to read them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..search.text import TextSettings


class Catalog:
    """Sources by name.  A source has a DataFrame, a natural order and text settings."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._sources: dict[str, Callable[[], DataFrame]] = {}
        self._order: dict[str, list[str]] = {}
        self._time: dict[str, str] = {}
        self.text: dict[str, TextSettings] = {}
        self.lookups = Lookups(spark)

    def register(self, name: str, source: DataFrame | Callable[[], DataFrame], order: Iterable[str] = (), time: str | None = None, text: TextSettings | None = None) -> Catalog:
        self._sources[name] = source if callable(source) and not isinstance(source, DataFrame) else (lambda: source)
        self._order[name] = list(order)
        if time:
            self._time[name] = time
        self.text[name] = text or TextSettings()
        return self

    def register_parquet(self, name: str, path: str, **more) -> Catalog:
        return self.register(name, lambda: self.spark.read.parquet(path), **more)

    def unregister(self, name: str) -> None:
        self._sources.pop(name, None)

    def exists(self, name: str) -> bool:
        return name in self._sources

    def names(self) -> list[str]:
        return sorted(self._sources)

    def frame(self, name: str) -> DataFrame:
        if name in self._sources:
            return self._sources[name]()
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise ValueError(f"unknown source {name!r}")

    def order(self, name: str) -> list[str]:
        return self._order.get(name, [])

    def time(self, name: str) -> str | None:
        return self._time.get(name)

    def describe(self, name: str) -> DataFrame:
        rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in self.frame(name).schema]
        return self.spark.createDataFrame(rows, "name string, type string, nullable boolean")

    def show(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.names()], "name string")


class Lookups:
    """Lookup tables by name; of rows that repeat a key the last one read wins."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}

    def register(self, name: str, table: DataFrame) -> None:
        self._tables[name] = table

    def load_csv(self, name: str, path: str, key: str) -> DataFrame:
        """Header line and a key column; lines with another number of values are skipped."""
        raw = self.spark.read.option("header", True).option("mode", "DROPMALFORMED").option("enforceSchema", False).csv(path)
        if key not in raw.columns:
            raise ValueError(f"{path} has no column {key!r}")
        last = Window.partitionBy(key).orderBy(F.desc("__at"))
        table = raw.withColumn("__at", F.monotonically_increasing_id()).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__at", "__n")
        self.register(name, table)
        return table

    def get(self, name: str) -> DataFrame | None:
        return self._tables.get(name)

    def unregister(self, name: str) -> None:
        self._tables.pop(name, None)

    def list(self) -> list[str]:
        return sorted(self._tables)

    def clear(self) -> None:
        self._tables.clear()


#: Tables of a data folder: natural order, time column and text fields.
FOLDER = {
    "region": (["r_regionkey"], None, {}), "nation": (["n_nationkey"], None, {}), "customer": (["c_custkey"], None, {}), "supplier": (["s_suppkey"], None, {}), "part": (["p_partkey"], None, {}),
    "orders": (["o_orderdate", "o_orderkey"], "o_orderdate", {}), "lineitem": (["l_orderkey", "l_linenumber"], "l_shipdate", {}), "events": (["ts", "event_id"], "ts", {}), "documents": (["doc_id"], None, {"text": "standard"}),
    "embeddings": (["vec_id"], None, {}), "pages": (["page_id"], None, {"html": "standard"}), "benchmark": (["item_id"], None, {"text": "standard"}), "labels": (["doc_id"], None, {}), "conversations": (["conv_id", "turn"], None, {"text": "standard"}),
}


def folder_catalog(spark: SparkSession, folder: str) -> Catalog:
    catalog = Catalog(spark)
    for name, (order, time, text) in FOLDER.items():
        catalog.register_parquet(name, f"{folder}/{name}.parquet", order=order, time=time, text=TextSettings(dict(text)))
    return catalog
