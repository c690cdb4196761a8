"""JSON text columns of messages, histories and saved sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(raw: Column, schema: str) -> Column:
    """The object in ``raw``; null for malformed text and for JSON that is not an object."""
    return F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, schema))


def field(raw: Column, name: str, kind: str, default) -> Column:
    """One field of a JSON object, or the default where text, object or field is missing or malformed."""
    return F.coalesce(parsed(raw, f"`{name}` {kind}")[name], F.lit(default).cast(kind))


def saved_sessions(rows: DataFrame, raw: str, item: str) -> DataFrame:
    """A row for each snapshot of a JSON map from id to snapshot; malformed maps give none."""
    got = F.from_json(raw, f"map<string,{item}>")
    others = [c for c in rows.columns if c != raw]
    return rows.select(*others, F.explode(got).alias("id", "snapshot"))


def evaluation_items(rows: DataFrame, raw: str, item: str) -> DataFrame:
    """The items of evaluation corpora held as JSON objects with an ``items`` array."""
    others = [c for c in rows.columns if c != raw]
    return rows.select(*others, F.explode(parsed(F.col(raw), f"items array<{item}>")["items"]).alias("item")).select(*others, "item.*")


def messages(rows: DataFrame, raw: str, fields: str) -> DataFrame:
    """Rows whose ``raw`` text is a JSON object, as ``message`` with these fields; arrays, single values and broken or null texts are left out."""
    value = F.try_parse_json(raw)
    kept = rows.where(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")))
    return kept.withColumn("message", F.from_json(raw, fields)).drop(raw)
