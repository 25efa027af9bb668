"""Price connectors by Spark's Data Source interface: spark.read.format("larder_prices"), and the same as a stream.

A table of a connector is a folder with one folder for each country and files of price rows in it, as CSV, JSON
or Parquet. A country is a partition of the scan, or several where its files are large; filters on country choose
partitions, filters on the other columns go into the files. A connector that has no data gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larder.sources.tables import PRICE, provider

NAME = "larder_prices"
#: Files of a country are read together up to so many bytes.
TOGETHER = 64 << 20
#: The setting that lets a Python source take filters.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_COMPARED = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


@dataclass
class Files(InputPartition):
    """Files of one country that one task reads."""

    country: str
    paths: tuple[str, ...]

    def __init__(self, country: str, paths: tuple[str, ...]):
        super().__init__((country, paths))
        self.country, self.paths = country, paths


@dataclass(frozen=True)
class Wanted:
    """column, comparison and values of a filter; sent to the tasks as it is."""

    column: str
    compare: str
    values: tuple

    def expression(self) -> pc.Expression:
        field = ds.field(self.column)
        if self.compare == "valid":
            return field.is_valid()
        return field.isin(list(self.values)) if self.compare == "in" else getattr(field, self.compare)(self.values[0])


def wanted(f: Filter) -> Wanted | None:
    """The filter as one that files can answer, or None. Text is only compared for equality."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = f.attribute[0]
    if isinstance(f, IsNotNull):
        return Wanted(column, "valid", ())
    if isinstance(f, In):
        return Wanted(column, "in", tuple(f.value))
    compare = _COMPARED.get(type(f))
    return Wanted(column, compare, (f.value,)) if compare and (compare == "__eq__" or not isinstance(f.value, str)) else None


class Listing:
    """What both readers share: the files of a table, and the rows of some of them."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.place, self.kind = options.get("path", ""), options.get("kind", "parquet")
        self.schema = schema
        self.filters: list[Wanted] = []

    def listed(self) -> list[tuple[str, str, int]]:
        """country, path and bytes of every file, in the order of their paths."""
        if not self.place:
            return []
        system, base = fs.FileSystem.from_uri(self.place) if "://" in self.place else (fs.LocalFileSystem(), self.place)
        found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        files = [i for i in found if i.is_file and not i.base_name.startswith(("_", "."))]
        country = lambda path: unquote(path.rsplit("/", 2)[1].removeprefix("country="))
        return sorted((country(i.path), i.path, i.size) for i in files)

    def chosen(self, country: str) -> bool:
        tests = {"__eq__": lambda v: country == v[0], "in": lambda v: country in v, "valid": lambda v: True}
        return all(tests[f.compare](f.values) for f in self.filters if f.column == "country")

    def grouped(self, files: list[tuple[str, str, int]]) -> list[Files]:
        out: list[tuple[str, list[str], int]] = []
        for country, path, size in files:
            if out and out[-1][0] == country and out[-1][2] + size <= TOGETHER:
                out[-1] = (country, [*out[-1][1], path], out[-1][2] + size)
            else:
                out.append((country, [path], size))
        return [Files(country, tuple(paths)) for country, paths, _ in out]

    def rows(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.place)[0] if "://" in self.place else fs.LocalFileSystem()
        whole = to_arrow_schema(self.schema)
        inner = pa.schema([f for f in whole if f.name != "country"])
        table = ds.dataset(list(partition.paths), schema=inner, format=self.kind, filesystem=system)
        test = None
        for f in self.filters:
            if f.column != "country":
                test = f.expression() if test is None else test & f.expression()
        for batch in table.to_batches(columns=inner.names, filter=test):
            country = pa.array([partition.country] * batch.num_rows, pa.string())
            yield pa.record_batch([country if f.name == "country" else batch.column(f.name) for f in whole], schema=whole)


class PriceReader(Listing, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what files can answer; Spark goes on to test the rest."""
        for f in filters:
            if (one := wanted(f)) is None or (one.column == "country" and one.compare not in ("__eq__", "in", "valid")):
                yield f
            else:
                self.filters.append(one)

    def partitions(self) -> list[Files]:
        return self.grouped([f for f in self.listed() if self.chosen(f[0])]) or [Files("", ())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition.paths else iter(())


class PriceStream(Listing, DataSourceStreamReader):
    """Files that have come since, by their number in the order in which they were first seen; each is read once.

    An offset lists nothing but how many files came before: files must not be deleted or renamed while a stream
    runs, and new ones sort last, as names with a number or a time do.
    """

    def initialOffset(self) -> dict:
        return {"files": 0}

    def _by_name(self) -> list[tuple[str, str, int]]:
        return sorted(self.listed(), key=lambda f: f[1].rsplit("/", 1)[1])

    def latestOffset(self) -> dict:
        return {"files": len(self._by_name())}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.grouped(sorted(self._by_name()[start["files"] : end["files"]]))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PriceSource(DataSource):
    """Options: path, and kind (parquet, csv or json); without a path an empty table."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PRICE

    def reader(self, schema: StructType) -> PriceReader:
        return PriceReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> PriceStream:
        return PriceStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets its scans take filters."""
    spark.dataSource.register(PriceSource)
    spark.conf.set(PUSHDOWN, "true")


@provider("connector")
def from_connector(spark: SparkSession, place: str):
    """place: a path, or a JSON object of options."""
    register(spark)
    options = json.loads(place) if place.startswith("{") else {"path": place}
    return spark.read.format(NAME).options(**options).load()


#: Connectors that have no data of their own: each reads the place it is given, and is empty without one.
for _name in ("external_api", "web_import", "csv_import", "scraper", "open_food_facts", "tesco", "carrefour", "walmart", "kroger"):
    provider(_name)(from_connector)
