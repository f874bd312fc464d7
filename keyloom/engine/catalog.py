"""Databases, tables, columns and indexes, kept as one small JSON file per database."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from keyloom import errors as X
from keyloom.functions import types as K
from keyloom.plans.validator import check_names
from keyloom.sources.files import Files


@dataclass
class TableInfo:
    """types: column -> type in declared order. base: Parquet of the rows before the log, if any. logged: a statement wrote to it. merges: column -> function that combines its values."""

    name: str
    folder: str
    primary: str
    types: dict[str, str]
    base: str | None = None
    base_txn: int = 0
    base_number: int = 0
    log_number: int = 0
    logged: bool = False
    indexes: dict[str, str] = field(default_factory=dict)
    merges: dict[str, str] = field(default_factory=dict)

    @property
    def log(self) -> str:
        return f"{self.folder}/log-{self.log_number}"

    def index_path(self, column: str) -> str:
        return f"{self.folder}/index-{list(self.types).index(column)}-{self.base_number}"

    def schema(self) -> T.StructType:
        """Columns with their number, key and index as metadata."""
        return T.StructType([T.StructField(c, K.spark_type(t), c != self.primary, {"id": i, "pk": c == self.primary, "indexed": c in self.indexes}) for i, (c, t) in enumerate(self.types.items()) if t not in K.PASSED])


class Catalog:
    FILE = "catalog.json"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files, self.root = spark, Files(spark), root.rstrip("/")
        self.files.make(self.root)
        self.databases: dict[str, dict[str, TableInfo]] = {}
        for name in self.files.names(self.root):
            self.load(name)

    def load(self, database: str) -> None:
        """Reads the catalogue of a database as it is now."""
        path = f"{self.root}/{database}/{self.FILE}"
        # A replacement that is under way: the new file is whole before the old one goes.
        path = next((p for p in (path, path + ".new") if self.files.exists(p)), None)
        if path:
            self.databases[database] = {t: TableInfo(**x) for t, x in json.loads(self.files.read(path)).items()}

    def save(self, database: str) -> None:
        self.files.write(f"{self.root}/{database}/{self.FILE}", json.dumps({t: asdict(x) for t, x in self.databases[database].items()}))

    def create_database(self, name: str) -> None:
        if name in self.databases:
            raise X.DatabaseAlreadyExists(name)
        self.files.make(f"{self.root}/{name}")
        self.databases[name] = {}
        self.save(name)

    def tables(self, database: str) -> dict[str, TableInfo]:
        if database not in self.databases:
            raise X.DatabaseNotFound(database)
        return self.databases[database]

    def table(self, database: str, name: str) -> TableInfo:
        tables = self.tables(database)
        if name not in tables:
            raise X.TableNotFound(name)
        return tables[name]

    def add(self, database: str, name: str, types: dict[str, str], primary: str, base: str | None = None) -> TableInfo:
        tables = self.tables(database)
        if name in tables:
            raise X.TableAlreadyExists(name)
        tables[name] = TableInfo(name, f"{self.root}/{database}/{name}", primary, types, base)
        self.save(database)
        return tables[name]

    def register_parquet(self, database: str, name: str, path: str, primary: str) -> TableInfo:
        """A table over existing Parquet, whose key must be unique and is not checked. Writes go to a log beside it."""
        types = {f.name: K.type_of(f.dataType) for f in self.spark.read.parquet(path).schema.fields}
        if primary not in types:
            raise X.ColumnNotFound(primary)
        check_names(list(types))
        return self.add(database, name, types, primary, path)
