"""Pending and final subtitles merged by id, and jobs judged by the session's state when they complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# What a message without language or mode means, and how long a pending subtitle is shown at first.
DEFAULTS = {"source_lang": "nl", "target_lang": "en", "mode": "balanced"}
PENDING_MS = 3500

#: A subtitle as it is kept: its number among those with the same id, times, texts and settings.
ITEM_SCHEMA = "item long, start_ms long, end_ms long, source_text string, translation string, source_lang string, target_lang string, mode string, pending boolean"
ITEM_NAMES = [x.split()[0] for x in ITEM_SCHEMA.split(", ")]


def _last(column: str, when: Column | None = None) -> Column:
    """The last value that is neither null nor empty."""
    said = F.nullif(F.col(column), F.lit("")).isNotNull()
    return F.max_by(column, F.when(said if when is None else said & when, F.col("seq")))


def merged(messages: DataFrame) -> DataFrame:
    """One row per subtitle from messages(client_id, seq, kind, id, at_ms, source_text, translation, source_lang, target_lang, mode, start_ms, end_ms).

    A ``pending`` message opens a subtitle; finals with its id fill what they have and leave the rest; a final
    without a pending one before it opens its own. A subtitle that is still pending when the next one of the
    session opens ends 120 ms before that, after 800 ms at least, unless a final tells its end. Rows without
    session or id are left out.
    """
    known = messages.where("client_id IS NOT NULL AND id IS NOT NULL")
    pending, final = F.col("kind") == "pending", F.col("kind") != "pending"
    numbered = known.withColumn("item", F.count_if(pending).over(W.partitionBy("client_id", "id").orderBy("seq")))
    items = numbered.groupBy("client_id", "id", "item").agg(
        F.min("seq").alias("opened"), F.min_by("at_ms", "seq").alias("at_ms"), F.min(F.when(final, F.col("seq"))).alias("first_final"),
        F.max_by("start_ms", F.when(final & F.col("start_ms").isNotNull(), F.col("seq"))).alias("told_start"), F.max_by("end_ms", F.when(final & F.col("end_ms").isNotNull(), F.col("seq"))).alias("told_end"),
        _last("source_text").alias("source_text"), _last("translation", final).alias("translation"), *[_last(c).alias(c) for c in DEFAULTS],
    )
    order = W.partitionBy("client_id").orderBy("opened")
    following, opens = F.lead("at_ms").over(order), F.lead("opened").over(order)
    shown = items.withColumns({"following": following, "shut": opens.isNotNull() & (F.col("first_final").isNull() | (F.col("first_final") > opens))})
    end = F.when(F.col("shut"), F.greatest(F.col("at_ms") + 800, F.col("following") - 120)).otherwise(F.col("at_ms") + PENDING_MS)
    waits = F.col("first_final").isNull()
    return shown.select(
        "client_id", "id", F.col("item").cast("long").alias("item"), F.coalesce("told_start", "at_ms").alias("start_ms"), F.coalesce("told_end", end).alias("end_ms"), F.coalesce("source_text", F.lit("")).alias("source_text"),
        F.when(waits, "").otherwise(F.coalesce("translation", F.lit("Translation unavailable"))).alias("translation"), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in DEFAULTS.items()], waits.alias("pending"),
    )


def latest_version(changes: DataFrame) -> DataFrame:
    """The last change of each item."""
    names = [c for c in changes.columns if c not in ("client_id", "id", "item", "version")]
    last = changes.groupBy("client_id", "id", "item").agg(F.max_by(F.struct(*names), "version").alias("row"))
    return last.select("client_id", "id", "item", "row.*")


def as_of(rows: DataFrame, states: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """``rows`` with the states' ``columns`` as they are at ``at``: those of the last state at or before it, null where there is none.

    Both sides are dealt and sorted once, and the last state is carried along; no pairs are made. States at one time
    must be told apart by ``at``; rows without key or time have no state.
    """
    names = [f"state_{c}" for c in columns]
    kind = {f.name: f.dataType for f in states.schema}
    own = rows.withColumns({n: F.lit(None).cast(kind[c]) for n, c in zip(names, columns, strict=True)}).withColumn("__side", F.lit(1))
    other = states.select(F.col(key), F.col(at), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.lit(0).alias("__side"))
    order = W.partitionBy(key).orderBy(F.col(at).asc_nulls_first(), "__side").rowsBetween(W.unboundedPreceding, 0)
    state = F.last(F.when((F.col("__side") == 0) & F.col(at).isNotNull(), F.struct(*names)), ignorenulls=True).over(order)
    met = own.unionByName(other, allowMissingColumns=True).withColumn("__state", state).where("__side = 1")
    given = F.col(key).isNotNull() & F.col(at).isNotNull()
    return met.select(*rows.columns, *[F.when(given, F.col("__state")[n]).alias(n) for n in names])
