"""A table as a map from keys to rows: single keys, scans in order of the key, and many changes as one write."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom import errors as X
from keyloom.engine import versions
from keyloom.engine.session import Session
from keyloom.functions.typed import SPARK_TYPES


class KeyValues:
    """Reads and writes one table of a session, under the session's transaction or one for each call."""

    def __init__(self, session: Session, table: str) -> None:
        self.session, self.name = session, table
        session.table(table)

    def scan_all(self) -> DataFrame:
        """All rows in order of the key."""
        return self._rows().orderBy(F.col(f"`{self._key}`"))

    def scan_from(self, key: object, inclusive: bool = True) -> DataFrame:
        """The rows from a key on, in order."""
        at = F.col(f"`{self._key}`")
        return self._rows().where(at >= F.lit(key) if inclusive else at > F.lit(key)).orderBy(at)

    def get(self, key: object) -> Row | None:
        return self._rows().where(F.col(f"`{self._key}`") == F.lit(key)).first()

    def set(self, key: object, **values: object) -> None:
        """Sets columns of a key and keeps its others; a key that was not there is added."""
        self.write_batch([(key, values)])

    def delete(self, key: object) -> None:
        self.write_batch([(key, None)])

    def write_batch(self, changes: Iterable[tuple[object, dict | None]]) -> int:
        """Applies changes (key, values, or None to delete the key) as one write, which is seen whole or not at all. Of a key's changes the order counts; gives the number of keys.

        A key that is deleted and set again within a batch loses what it had, which takes a second write of the same transaction.
        """
        table = self.session.table(self.name)
        deletes: dict[object, None] = {}
        sets: dict[object, dict] = {}
        for key, values in changes:
            if key is None:
                raise X.PrimaryColumnNotIncluded(table.primary)
            if values is None:
                deletes[key] = None
                sets.pop(key, None)
            else:
                for c in values:
                    if c not in table.types or c == table.primary:
                        raise X.UnknownColumn(c)
                sets.setdefault(key, {}).update({c: v for c, v in values.items() if v is not None})
        columns = [c for c in table.types if c == table.primary or any(c in v for v in sets.values())]
        fields = [T.StructField(c, T._parse_datatype_string(SPARK_TYPES[table.types[c]])) for c in columns]
        kept = lambda c, v: Decimal(v) if table.types[c] == "U64" and v is not None else v
        row = lambda key, values: tuple(kept(c, key if c == table.primary else values.get(c)) for c in columns)
        schema = T.StructType([*fields, T.StructField(versions.DELETED, T.BooleanType())])
        writes = [[(*row(k, {}), True) for k in deletes], [(*row(k, v), False) for k, v in sets.items()]]
        if not set(deletes) & set(sets):
            writes = [writes[0] + writes[1]]
        frames = [self.session.spark.createDataFrame(w, schema).coalesce(1) for w in writes if w]
        self.session.write_rows(self.name, frames)
        return len(deletes.keys() | sets.keys())

    @property
    def _key(self) -> str:
        return self.session.table(self.name).primary

    def _rows(self) -> DataFrame:
        return self.session.rows(self.name)
