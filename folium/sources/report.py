"""Sinks: JSON lines with nulls kept, and a text report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions import text as T


def as_json(df: DataFrame, key: str) -> DataFrame:
    """key, json: each row as one JSON object in which nulls are kept."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def money_text(amount: Column, vat: Column, currency: str = "RUB") -> Column:
    """'12 480 500,00 RUB, включая НДС'; a dash without an amount."""
    note = F.when(vat, ", включая НДС").when(~vat, ", без НДС").otherwise("")
    return F.when(amount.isNull(), "-").otherwise(F.concat(T.format_amount(amount), F.lit(f" {currency}"), note))


def write_json(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
