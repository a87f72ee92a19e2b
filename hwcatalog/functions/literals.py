"""Values as SQL text, and the statements that load them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sql_literal(value: Column, kind: T.DataType) -> Column:
    """A value as an SQL literal: null as NULL, truth as 1 or 0, numbers bare, lists and records as JSON text, text with its quotes doubled."""
    if isinstance(kind, T.BooleanType):
        out = F.when(value, "1").otherwise("0")
    elif isinstance(kind, T.NumericType):
        out = value.cast("string")
    else:
        text = F.to_json(value) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else value.cast("string")
        out = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(value.isNull(), "NULL").otherwise(out)


def _values(df: DataFrame, columns: list[str]) -> Column:
    parts = [sql_literal(F.col(c), df.schema[c].dataType) for c in columns]
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))


def insert(df: DataFrame, table: str, columns: list[str]) -> Column:
    """INSERT of a row's columns."""
    return F.concat(F.lit(f"INSERT INTO {table} ({', '.join(columns)}) VALUES "), _values(df, columns), F.lit(";"))


def upsert(df: DataFrame, table: str, columns: list[str], key: str) -> Column:
    """INSERT that becomes an UPDATE of all other columns where the key is there, so that what the statement doesn't name stays."""
    sets = ", ".join(f"{c} = excluded.{c}" for c in columns if c != key)
    return F.concat(F.lit(f"INSERT INTO {table} ({', '.join(columns)}) VALUES "), _values(df, columns), F.lit(f" ON CONFLICT({key}) DO UPDATE SET {sets};"))


def delete(df: DataFrame, table: str, key: str) -> Column:
    """DELETE of all rows with the row's key."""
    return F.concat(F.lit(f"DELETE FROM {table} WHERE {key} = "), sql_literal(F.col(key), df.schema[key].dataType), F.lit(";"))
