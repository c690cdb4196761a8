"""Session histories, translation reuse and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from subtide.functions.text import collapsed


def recent(sessions: DataFrame, subtitles: DataFrame, limit: int = 50) -> DataFrame:
    """Latest sessions with their number of subtitles, counted before the join; limit within 1 to 200."""
    counts = subtitles.groupBy("client_id").agg(F.count("*").alias("n_subtitles"))
    latest = sessions.orderBy(F.desc("updated_at"), "client_id").limit(min(200, max(1, limit)))
    return latest.join(counts, "client_id", "left").withColumn("n_subtitles", F.coalesce("n_subtitles", F.lit(0)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key: new values win, but for ``keep_old`` columns and where the new one is null."""
    a, b = old.alias("a"), new.alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    pick = [F.coalesce(*([f"a.{c}", f"b.{c}"] if c in keep_old else [f"b.{c}", f"a.{c}"])).alias(c) for c in old.columns]
    return a.join(b, on, "full_outer").select(*pick)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rank = 1").drop("rank")


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def translate(requests: DataFrame, cache: DataFrame, scorer: Callable[[Column], Column]) -> DataFrame:
    """requests(request_id, cache_key, text, source, target) with translation and origin.

    Same-language and blank requests skip the cache; each missing key is scored once and fanned back out.
    """
    plain = collapsed(F.col("text"))
    asked = requests.withColumns({"plain": plain, "origin": F.when(plain == "", "blank").when(F.col("source") == F.col("target"), "identity")})
    own = asked.where("origin IS NOT NULL").withColumn("translation", F.when(F.col("origin") == "blank", "").otherwise(F.col("plain")))
    rest = asked.where("origin IS NULL").drop("origin")
    keys = rest.groupBy("cache_key").agg(F.min("plain").alias("plain"))
    known = keys.join(cache.select("cache_key", F.col("translation").alias("cached")), "cache_key", "left")
    scored = known.select("cache_key", F.coalesce("cached", scorer(F.col("plain"))).alias("translation"), F.when(F.col("cached").isNull(), "scored").otherwise("cache").alias("origin"))
    return own.select("request_id", "cache_key", "translation", "origin").unionByName(rest.join(scored, "cache_key").select("request_id", "cache_key", "translation", "origin"))


def summary(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """count, median, p95 (linear interpolation) and maximum of each series."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return samples.groupBy(*keys).agg(F.count(value).alias("n"), thousandths(p[0]).alias("median"), thousandths(p[1]).alias("p95"), thousandths(F.max(value)).alias("most"))


def order_statistics(samples: DataFrame, keys: list[str], value: str = "value", shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """count, the linearly interpolated values at ``shares`` of (n - 1), and the maximum of each series, without holding a series.

    Values are counted in ranges of about a thousandth of their size; the ranges in which a wanted place lies are
    looked at once more, as counts of their different values. Counts are summed before the shuffle, and what is
    then sorted is a range's different values, so a series with most of all rows is many tasks. Nulls and NaN are
    left out; a series without values has nulls and the count 0.
    """
    own = samples.select(F.struct(*keys).alias("__k"), F.col(value).cast("double").alias("__v")).withColumn("__v", F.when(~F.isnan("__v"), F.col("__v")))
    ranged = own.withColumn("__r", (F.signum("__v") * F.floor(F.log1p(F.abs("__v")) * 1024)).cast("long"))
    counts = ranged.groupBy("__k", "__r").agg(F.count("__v").alias("n"), F.max("__v").alias("most"))
    by = W.partitionBy("__k")
    sums = counts.select("*", F.sum("n").over(by).alias("total"), F.max("most").over(by).alias("top"), F.sum("n").over(by.orderBy("__r").rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    place = [(F.col("total") - 1) * F.lit(p) for p in shares]
    ranks = F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)])
    wanted = sums.where("n > 0").select("__k", "__r", (F.col("upto") - F.col("n")).alias("before"), F.explode(F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))).alias("rank"))
    asked = wanted.groupBy("__k", "__r").agg(F.min("before").alias("before"), F.collect_set("rank").alias("ranks"))
    values = ranged.join(asked.select("__k", "__r"), ["__k", "__r"]).groupBy("__k", "__r", "__v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy("__k", "__r").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    found = values.withColumn("upto", upto).join(asked, ["__k", "__r"]).select("__k", "__v", F.explode(F.filter("ranks", lambda r: (r >= F.col("before") + F.col("upto") - F.col("c")) & (r < F.col("before") + F.col("upto")))).alias("rank"))
    at = found.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "__v"))).alias("at"))  # two places a share
    series = sums.groupBy("__k").agg(F.max("total").alias("n"), F.max("top").alias("most"))

    def interpolated(p: float) -> Column:
        x = (F.col("n") - 1) * F.lit(p)
        low, high = F.try_element_at("at", F.floor(x).cast("long")), F.try_element_at("at", F.ceil(x).cast("long"))
        return low + (high - low) * (x - F.floor(x))

    out = series.join(at, "__k", "left")
    return out.select(*[F.col(f"__k.{k}").alias(k) for k in keys], "n", *[interpolated(p).alias(f"p{round(p * 100)}") for p in shares], "most")


def summary_of_any_size(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``summary`` without holding a series, see ``order_statistics``."""
    found = order_statistics(samples, keys, value)
    return found.select(*keys, "n", thousandths(F.col("p50")).alias("median"), thousandths(F.col("p95")).alias("p95"), thousandths(F.col("most")).alias("most"))


def thousandths(x: Column) -> Column:
    """Three places; what is left of binary fractions goes first, so that halves are halves."""
    return F.round(F.round(x, 9), 3)


def recent_samples(samples: DataFrame, keys: list[str], order: list[Column], most: int = 1000) -> DataFrame:
    return samples.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most).drop("rank")


def quality_level(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Level and reasons from segments(no_speech, avg_logprob, compression)."""
    got = segments.groupBy(*keys).agg(F.max("no_speech").alias("no_speech"), F.avg("avg_logprob").alias("logprob"), F.max("compression").alias("compression"))
    low = (F.col("no_speech") >= 0.75) | (F.col("logprob") <= -1.2) | (F.col("compression") >= 2.4)
    watch = (F.col("no_speech") >= 0.55) | (F.col("logprob") <= -0.85)
    return got.withColumn("level", F.when(low, "low").when(watch, "watch").otherwise("good"))


def epochs(messages: DataFrame, order: list[str], settings: tuple[str, ...] = ("source_lang", "target_lang", "prompt"), defaults: tuple[str, ...] = ("nl", "en", "")) -> DataFrame:
    """messages(client_id, type, settings) with epoch (after gaps, and configuration that changes a setting) and generation (after finals, gaps and flushes).

    A setting that a configuration does not tell is at its default, as are all before the first one.
    """
    by = W.partitionBy("client_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = F.struct(*[F.coalesce(s, F.lit(v)).alias(s) for s, v in zip(settings, defaults, strict=True)])
    told = F.when(F.col("type") == "config", own)
    before = F.coalesce(F.last(told, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)), F.struct(*[F.lit(v).alias(s) for s, v in zip(settings, defaults, strict=True)]))
    marked = messages.withColumn("__bump", (F.col("type") == "audio_gap") | F.coalesce(told != before, F.lit(False)))
    return marked.withColumns({"epoch": F.count_if("__bump").over(by), "generation": F.count_if(F.col("type").isin("final", "audio_gap", "flush")).over(by)}).drop("__bump")


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """Null, empty and missing values replaced, column by column."""
    plain = {c: F.nullif(F.col(c), F.lit("")) if isinstance(v, str) else F.col(c) for c, v in defaults.items()}
    return rows.withColumns({c: F.coalesce(plain[c], F.lit(v)) for c, v in defaults.items()})


def translation_quality(rows: DataFrame) -> DataFrame:
    """rows(failed, translation, quality) with level and reason."""
    found = F.coalesce("translation", F.lit("")) != ""
    level = F.when(F.col("failed"), "error").when(found, F.coalesce("quality", F.lit("good"))).otherwise("watch")
    return rows.withColumns({"level": level, "reason": F.when(~F.col("failed") & ~found, "translation_unavailable")})


def context_prompt(hint: str, sentence: str, keys: list[str], order: list[str], most: int = 420, sentences: int = 8) -> Column:
    """The whole hint and the last characters of the sentences before; null where both are empty."""
    before = F.array_join(F.collect_list(sentence).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(-sentences, -1)), " ")
    return F.nullif(F.trim(F.concat_ws(" ", F.lit(hint), F.nullif(F.right(before, F.lit(most)), F.lit("")))), F.lit(""))


def current(entries: DataFrame, version: int, epoch: int) -> DataFrame:
    """Entries written under this version and not before this epoch."""
    return entries.where((F.col("version") == version) & (F.col("epoch") >= epoch))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place in a total order, without a window over all: places within range partitions, moved by the sizes of those before."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    local = dealt.withColumn("local", F.row_number().over(W.partitionBy("part").orderBy(*order)))
    sizes = local.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return local.join(F.broadcast(before), "part").withColumn(name, (F.col("local") + F.col("before")).cast("long")).drop("part", "local", "before")
