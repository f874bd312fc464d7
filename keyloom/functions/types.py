"""Column types of the dialect: Spark types, families, and what may be cast and compared."""

from __future__ import annotations

from pyspark.sql import types as T

from keyloom.functions.typed import RANGES, SPARK_TYPES

SIGNED, UNSIGNED, FLOATS = ("I8", "I16", "I32", "I64"), ("U8", "U16", "U32", "U64"), ("F32", "F64")
INTEGERS = SIGNED + UNSIGNED
NUMBERS = INTEGERS + FLOATS
#: Types that only registered tables have; they pass through and can be compared with themselves.
PASSED = ("TIMESTAMP", "ARRAY")
ALL = (*NUMBERS, "BOOLEAN", "VARCHAR", "DATE", "BLOB")
NULL = "NULL"


def castable(source: str, target: str) -> bool:
    """Whether a value of one type may be stored in a column of another; integers are not taken for floats."""
    return NULL in (source, target) or source == target or (source in INTEGERS and target in INTEGERS) or (source in FLOATS and target in FLOATS)


def comparable(left: str, right: str) -> bool:
    return NULL in (left, right) or left == right or (left in NUMBERS and right in NUMBERS)


def ordered(kind: str) -> bool:
    """Whether < and > are defined."""
    return kind in NUMBERS or kind in ("VARCHAR", "DATE", "TIMESTAMP", NULL)


def arithmetic(left: str, right: str) -> str:
    if left in FLOATS or right in FLOATS:
        return "F64"
    return "U64" if left in UNSIGNED and right in UNSIGNED else "I64"


def spark_type(kind: str) -> T.DataType:
    return T._parse_datatype_string(SPARK_TYPES[kind])


def type_of(field: T.DataType) -> str:
    """The column type of a Spark type of a registered table."""
    name = field.simpleString()
    known = {"tinyint": "I8", "smallint": "I16", "int": "I32", "bigint": "I64", "decimal(20,0)": "U64", "float": "F32", "double": "F64", "boolean": "BOOLEAN", "string": "VARCHAR", "date": "DATE", "binary": "BLOB"}
    return known.get(name, "TIMESTAMP" if name.startswith("timestamp") else "ARRAY")


def fits(value: int, kind: str) -> bool:
    low, high = RANGES[kind]
    return low <= value <= high
