"""Text as values of the column types: which texts are values, and what value they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Range of each integer type.
RANGES = {
    "I8": (-(1 << 7), (1 << 7) - 1), "I16": (-(1 << 15), (1 << 15) - 1), "I32": (-(1 << 31), (1 << 31) - 1), "I64": (-(1 << 63), (1 << 63) - 1),
    "U8": (0, (1 << 8) - 1), "U16": (0, (1 << 16) - 1), "U32": (0, (1 << 32) - 1), "U64": (0, (1 << 64) - 1),
}
#: Spark type that holds each column type.
SPARK_TYPES = {
    "I8": "tinyint", "I16": "smallint", "I32": "int", "I64": "bigint", "U8": "smallint", "U16": "int", "U32": "bigint", "U64": "decimal(20,0)",
    "F32": "float", "F64": "double", "BOOLEAN": "boolean", "VARCHAR": "string", "DATE": "date", "BLOB": "binary",
}
BLANKS = r"[ \t\r\n]*"
FLOAT = r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n"))


def _digits(text: Column) -> Column:
    return text.rlike(rf"^{BLANKS}[+-]?[0-9]+{BLANKS}\z")


def integer(text: Column) -> Column:
    """The text as decimal(38,0): an optional sign and digits with blanks around; null for any other text, or beyond 38 digits."""
    digits = F.regexp_replace(_bare(text), r"^([+-]?)0+(?=[0-9])", "$1")
    return F.when(_digits(text) & (F.length(digits) <= 39), digits.try_cast("decimal(38,0)"))


def is_value(text: Column, kind: str) -> Column:
    """Whether a text that is not null is a value of the type ``kind``; false for unknown types."""
    if kind == "VARCHAR":
        return F.lit(True)
    if kind in RANGES:
        low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in RANGES[kind])
        return F.coalesce(integer(text).between(low, high), F.lit(False))
    if kind in ("F32", "F64"):
        return text.rlike(rf"^{BLANKS}{FLOAT}{BLANKS}\z")
    if kind == "BOOLEAN":
        return text.rlike(rf"^{BLANKS}(?i:true|false){BLANKS}\z")
    if kind == "DATE":
        return text.rlike(rf"^{BLANKS}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{BLANKS}\z") & _bare(text).try_cast("date").isNotNull()
    return F.lit(False)


#: What a text is checked by, for each type.
_FAMILIES = {"text": ["VARCHAR"], "long": [k for k, (_, high) in RANGES.items() if high < 1 << 63], "unsigned": ["U64"], "float": ["F32", "F64"], "boolean": ["BOOLEAN"], "date": ["DATE"]}


def facts(kind: Column) -> Column:
    """What ``is_value_of`` needs to know of a type: computed once per column of a catalogue, not per text. A null family is an unknown type."""
    one = lambda pairs, to: F.coalesce(*[F.when(kind.isin(*ks), F.lit(v)) for ks, v in pairs]).cast(to)
    bounds = [one([([k], RANGES[k][i]) for k in _FAMILIES["long"]], "bigint") for i in (0, 1)]
    return F.struct(one([(ks, i) for i, ks in enumerate(_FAMILIES.values())], "int").alias("family"), bounds[0].alias("low"), bounds[1].alias("high"))


def is_value_of(text: Column, of: Column) -> Column:
    """``is_value`` for a type given by its ``facts``. Small, as Spark compiles it into one method, and long ones stay uncompiled."""
    bare = F.ltrim(F.btrim(text, F.lit(" \t\r\n+-")), F.lit("0"))
    most = str(RANGES["U64"][1])
    checks = {
        "text": F.lit(True), "long": _digits(text) & F.coalesce(text.try_cast("bigint").between(of["low"], of["high"]), F.lit(False)),
        "unsigned": _digits(text) & ((bare == "") | (~text.contains("-") & ((F.length(bare) < len(most)) | ((F.length(bare) == len(most)) & (bare <= most))))),
        **{f: is_value(text, _FAMILIES[f][-1]) for f in ("float", "boolean", "date")},
    }
    out = F.when(F.lit(False), F.lit(True))
    for i, f in enumerate(_FAMILIES):
        out = out.when(of["family"] == i, checks[f])
    return out.otherwise(False)


def to_value(text: Column, kind: str) -> Column:
    """The text cast to the Spark type of ``kind``; null where it is no value."""
    if kind == "VARCHAR":
        return text
    value = integer(text) if kind in RANGES else _bare(text)
    return F.when(is_value(text, kind), value.try_cast(SPARK_TYPES[kind]))


def canonical_key(text: Column, of: Column) -> Column:
    """A key, which is a value of the type with these ``facts``, as it is shown: integers as plain digits, so that equal numbers are equal; other types as they stand."""
    bare = F.ltrim(F.btrim(text, F.lit(" \t\r\n+-")), F.lit("0"))
    number = F.concat(F.when(text.contains("-") & (bare != ""), F.lit("-")).otherwise(F.lit("")), F.when(bare == "", F.lit("0")).otherwise(bare))
    return F.when(of["family"].isin(1, 2), number).otherwise(text)
