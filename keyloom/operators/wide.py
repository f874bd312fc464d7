"""Entity-attribute-value rows into wide tables with typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.typed import canonical_key, facts, is_value_of, to_value

#: Attributes that are pivoted side by side; more of them are pivoted in bands of so many, in the same pass.
BAND = 256
#: Older than any transaction or record: stands for a missing id.
OLDEST = -(1 << 63)


def column_ids(records: DataFrame, schema: DataFrame) -> list[int]:
    """Numbers of the declared attributes that occur, of any table, in order. As many as the widest table has columns, since tables number theirs alike."""
    seen = records.select("keyspace_id", "column_id").distinct()
    rows = schema.select("keyspace_id", "column_id").join(seen, ["keyspace_id", "column_id"], "left_semi").select("column_id").distinct()
    return sorted(r[0] for r in rows.collect())


def attributes(records: DataFrame, schema: DataFrame, keyspace_id: int) -> list[tuple]:
    """The declared attributes of a table: (column_id, column_name, column_type, is_primary, whether it occurs), in order. As many as the wide table has columns."""
    seen = records.where(F.col("keyspace_id") == keyspace_id).select("column_id").distinct().withColumn("_seen", F.lit(True))
    rows = schema.where(F.col("keyspace_id") == keyspace_id).select("column_id", "column_name", "column_type", "is_primary").distinct()
    return sorted(map(tuple, rows.join(seen, "column_id", "left").select("column_id", "column_name", "column_type", "is_primary", F.coalesce("_seen", F.lit(False))).collect()))


def usable_records(records: DataFrame, schema: DataFrame) -> DataFrame:
    """keyspace_id, entity, column_id, txn_id, record_id, column_value of the rows that can fill a cell.

    Left out are rows with a null or undeclared column, a null value, a value not of the column's
    type, and a key that is null or not of the key column's type. Equal integer keys are one entity.
    """
    columns = schema.select(F.col("keyspace_id").alias("_k"), F.col("column_id").alias("_c"), facts(F.col("column_type")).alias("_t")).distinct()
    keys = schema.where("is_primary").groupBy(F.col("keyspace_id").alias("_pk")).agg(facts(F.min("column_type")).alias("_pt"))
    rows = records.select("keyspace_id", "primary_column_value", "column_id", "column_value", "txn_id", "record_id").where("column_value IS NOT NULL AND primary_column_value IS NOT NULL")
    rows = rows.join(columns, (rows["keyspace_id"] == columns["_k"]) & (rows["column_id"] == columns["_c"]))
    rows = rows.join(keys, rows["keyspace_id"] == keys["_pk"])
    rows = rows.where(is_value_of(F.col("column_value"), F.col("_t")) & is_value_of(F.col("primary_column_value"), F.col("_pt")))
    return rows.select("keyspace_id", canonical_key(F.col("primary_column_value"), F.col("_pt")).alias("entity"), "column_id", "txn_id", "record_id", "column_value")


def winners(rows: DataFrame, slots: list[int]) -> DataFrame:
    """One row per keyspace, entity and band of BAND attributes; column r<i> holds the winning record_id of the band's i-th attribute, for the given i.

    One conditional aggregation per attribute. Of several rows of a cell the one with the highest
    txn_id wins (a missing one counts as the oldest), then the highest record_id. The rows of a
    transaction are reduced first; so both aggregates keep numbers only, and hash rather than sort,
    and a frequent entity is reduced where it is read.
    """
    one = rows.groupBy("keyspace_id", "entity", "column_id", F.coalesce("txn_id", F.lit(OLDEST)).alias("txn_id")).agg(F.max("record_id").alias("record_id"))
    place = F.pmod("column_id", F.lit(BAND))
    aggs = [F.max_by(F.when(place == i, F.col("record_id")), F.when(place == i, F.col("txn_id"))).alias(f"r{i}") for i in slots]
    return one.groupBy("keyspace_id", "entity", F.floor(F.col("column_id") / BAND).cast("int").alias("band")).agg(*aggs, F.count(F.lit(1)).alias("_n"))


def pivoted(rows: DataFrame, column_ids: list[int]) -> DataFrame:
    """One row per entity of a table; column c<id> holds the winning row's text, and is named for its attribute. Winners are chosen as in ``winners``.

    Texts do not fit the buffers of a hash aggregate, so here Spark sorts.
    """
    best = F.struct(F.coalesce("txn_id", F.lit(OLDEST)), F.coalesce("record_id", F.lit(OLDEST)))
    aggs = [F.max_by(F.when(F.col("column_id") == c, F.col("column_value")), F.when(F.col("column_id") == c, best)).alias(f"c{c}") for c in column_ids]
    return rows.groupBy("entity").agg(*aggs, F.count(F.lit(1)).alias("_n"))


def filled_cells(records: DataFrame, schema: DataFrame) -> DataFrame:
    """keyspace_id, primary_column_value, column_id, record_id: the wide tables' filled cells with the record each comes from.

    All tables are pivoted in one pass, as their attribute numbers overlap, and the winners unpivoted.
    Any number of tables and attributes will do. No attributes or no rows give no cells; a row
    without a record_id fills none.
    """
    slots = sorted({c % BAND for c in column_ids(records, schema)})
    wide = winners(usable_records(records, schema), slots)
    none = F.array().cast("array<struct<column_id:int,record_id:bigint>>")
    cells = F.array(*[F.struct((F.col("band") * BAND + i).cast("int").alias("column_id"), F.col(f"r{i}").alias("record_id")) for i in slots]) if slots else none
    out = wide.select("keyspace_id", F.col("entity").alias("primary_column_value"), F.inline(F.filter(cells, lambda x: x["record_id"].isNotNull())))
    return out.select("keyspace_id", "primary_column_value", "column_id", "record_id")


def wide_table(records: DataFrame, schema: DataFrame, keyspace_id: int) -> DataFrame:
    """One row per entity of a table, its key first, then the declared attributes by name with their types.

    An attribute that never occurs is a null column; an entity without any filled cell is no row. A
    cell of the key column itself is not shown, as the key stands for it; it does make an entity.
    """
    declared = attributes(records, schema, keyspace_id)
    rows = usable_records(records.where(F.col("keyspace_id") == keyspace_id), schema)
    key = next((x for x in declared if x[3]), None)
    if key is None:
        raise ValueError(f"keyspace {keyspace_id} has no key column")
    found = {c for c, _, _, _, occurs in declared if occurs}
    wide = pivoted(rows, sorted(found - {key[0]}))
    cell = lambda c: F.col(f"c{c}") if c in found else F.lit(None).cast("string")
    return wide.select(to_value(F.col("entity"), key[2]).alias(key[1]), *[to_value(cell(c), t).alias(n) for c, n, t, primary, _ in declared if not primary])
