"""Log records: contexts without transcripts, masked previews, redacted settings, lines and their tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions.text import collapsed

# Fields of a log context that hold transcripts, and what stands for hidden texts and secrets.
SENSITIVE = ("dutch", "translation", "transcript")
HIDDEN, REDACTED = "[hidden; set LOG_TRANSCRIPT_TEXT=1 to log text previews]", "<redacted>"


def without_transcripts(context: Column) -> Column:
    """A map<string,string> context without the fields that hold transcripts."""
    return F.map_filter(context, lambda k, v: ~k.isin(*SENSITIVE))


def redacted(settings: Column, secret: tuple[str, ...]) -> Column:
    """A map<string,string> of settings with the values of secret keys replaced, but for null and empty ones."""
    return F.transform_values(settings, lambda k, v: F.when(k.isin(*secret) & (F.coalesce(v, F.lit("")) != ""), F.lit(REDACTED)).otherwise(v))


def preview(text: Column, shown: Column, limit: int = 180) -> Column:
    """The beginning of a text with single spaces where texts may be shown, else a note."""
    plain = collapsed(F.coalesce(text, F.lit("")))
    cut = F.when(F.length(plain) > limit, F.concat(F.left(plain, F.lit(limit)), F.lit("…"))).otherwise(plain)
    return F.when(shown, cut).otherwise(F.lit(HIDDEN))


def line(event: Column, fields: list[tuple[str, Column]], limit: int = 600) -> Column:
    """event | name=value for each field: nested values as JSON, new lines as spaces, long values cut with an ellipsis, null as None."""

    def shown(value: Column) -> Column:
        flat = F.replace(F.replace(F.coalesce(value, F.lit("None")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
        return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)

    return F.concat_ws(" | ", event, *[F.concat(F.lit(f"{name}="), shown(value)) for name, value in fields])


def tail(lines: DataFrame, number: str, n: int | None = 200) -> DataFrame:
    """The last ``n`` lines by their number, in order; n within 1 to 5000, 200 where it is null or 0."""
    most = max(1, min(n or 200, 5000))
    return lines.orderBy(F.desc(number)).limit(most).orderBy(number)


def transitions(log: DataFrame, allowed: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """log with ``previous`` and ``valid``: whether allowed(previous, state), a table with a row for each pair, has the step. First states are valid."""
    from pyspark.sql import Window as W

    before = log.withColumn("previous", F.lag(state).over(W.partitionBy(key).orderBy(*order)))
    pairs = allowed.select(F.col("previous").alias("__from"), F.col("state").alias("__to"), F.lit(True).alias("__known")).distinct()
    met = before.join(pairs, (F.col("previous") == F.col("__from")) & (F.col(state) == F.col("__to")), "left")
    return met.select(*before.columns, (F.col("previous").isNull() | F.coalesce("__known", F.lit(False))).alias("valid"))
