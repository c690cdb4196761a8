"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

Documents of a source are shuffled by a hash and laid end to end; the stream is cut into blocks of
``BLOCK`` words. A schedule gives every slot of the mix to a source: the golden-ratio points i * a mod n,
a / n being the golden ratio to the nearest a without a common divisor, run through the n slots of the
mix and are mapped through the sources' cumulative slots. The points are the numbers 0 to n - 1 in
another order, so a source gets exactly its slots, and in any beginning of the schedule a number that is
off by a few slots. The r-th slot of a source takes its r-th block, a second pass beginning when the
blocks run out; its last slot is cut where the target is reached. What a document gives to the mix is the
sum of its spans in the slots.

Positions are two-level prefix sums (per source and hash bucket, then within a bucket) and slots are
ranked the same way (per source and run of ``SLOTS_PER_CHUNK`` slots), so no source is ordered in one
task. Sources are a dimension: a row each, with windows over them all.

Defined results: a null text has size 0 and is in no slot; sources sort by code point with null last; an
empty table gives an empty result; rows that repeat an id are mixed as rows of their own; extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from subtide.llm.common import WORD_PATTERN, checkpointed

BLOCK, SLOTS_PER_CHUNK, ROWS_PER_BUCKET = 128, 1 << 16, 10_000
GOLDEN = 0.6180339887498949


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and name, the hash that shuffles; equal rows have equal names."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), row_name().alias("name"))


def row_name() -> Column:
    """A hash of id, source and text, each with its length and apart from null: rows that differ in one have different names."""
    parts = [F.col("doc_id").cast("string"), F.col("source"), F.col("text")]
    return F.md5(F.concat(*[F.when(p.isNull(), "-").otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)) for p in parts]))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: key, source_size and target, filled by weight up to ``cap`` times the size."""
    named = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = named.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int")))
    full = W.orderBy((F.col("source_size") * F.lit(cap) / F.col("weight")), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(F.col("source_size") * F.lit(cap)).over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing))
    level = weighted.withColumn("level", (F.sum("source_size").over(W.partitionBy()) * F.lit(share) - before) / left)
    level = level.withColumn("level", F.max("level").over(W.partitionBy()))  # rises while sources fill up, then falls
    target = F.least(F.col("source_size") * F.lit(cap), F.col("level") * F.col("weight"))
    return level.select(_key().alias("key"), "source", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("words"))


def _key():
    return F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))


def golden_step(slots: int) -> int:
    """The nearest number to the golden ratio's share of the slots that has no common divisor with them."""
    near = round(slots * GOLDEN)
    return next((a for k in range(slots + 1) for a in (near - k, near + k) if 0 < a <= slots and math.gcd(a, slots) == 1), 1)


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """The slots in order: slot, key, rank (of the slot in its source). sources(key, slots) sum to ``slots``, under 2**41."""
    step = golden_step(slots)
    # slot * step mod slots without a product over 63 bits
    point = (F.shiftright("id", 20) * F.lit((step << 20) % slots) + F.col("id").bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(step % slots)) % slots
    upto = F.sum("slots").over(W.orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    shares = sources.where("slots > 0").select("key", (upto - F.col("slots")).alias("low"), upto.alias("high"))
    # A source covers whole cells of the points but for its edges; points meet their sources by cell.
    cell = max(1, slots >> 12)
    cells = shares.select("*", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))).alias("cell"))
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    drawn = points.withColumn("cell", F.floor(F.col("point") / cell)).join(cells, "cell").where("low <= point AND point < high").select("slot", "key", F.floor(F.col("slot") / SLOTS_PER_CHUNK).alias("chunk"))
    counts = drawn.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("key", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return drawn.join(before, ["key", "chunk"]).select("slot", "key", (F.col("before") + F.row_number().over(W.partitionBy("key", "chunk").orderBy("slot")) - 1).alias("rank"))


class Mix:
    """A mix of docs: ``sources`` (targets and slots), ``laid`` (each row's place in its source's stream) and ``spans``."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK):
        sized = checkpointed(with_sizes(docs))
        n = sized.count()
        size, words = F.col("source_size"), F.col("words")
        sources = source_targets(sized, weights, share, cap).withColumns({"blocks": F.ceil(size / block), "passes": F.when(size > 0, F.floor(words / size)).otherwise(0)})
        sources = sources.withColumn("rest", words - F.col("passes") * size)
        self.sources = sources = checkpointed(sources.withColumn("slots", F.coalesce(F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block), F.lit(0))))
        slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

        ranked = schedule(sources, max(slots, 1)).join(sources.select("key", "source_size", "blocks", "passes", "rest"), "key")
        turn = F.floor(F.col("rank") / F.col("blocks"))
        first = F.expr("rank % blocks") * block
        stop = F.when(turn < F.col("passes"), size).otherwise(F.col("rest"))
        #: slot, key, rank, pass, block and the words first to last (exclusive) of the source's stream
        self.slots = ranked.select("slot", "key", "rank", turn.alias("pass"), F.expr("rank % blocks").alias("block"), first.alias("from"), F.least(first + block, stop).alias("to"))

        digits = max(2, math.ceil(math.log(max(n, 1) / ROWS_PER_BUCKET, 16))) if n else 2
        laid = sized.select("doc_id", "source", "size", _key().alias("key"), "name").withColumn("bucket", F.substring("name", 1, digits))
        sums = laid.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
        offsets = sums.select("key", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
        within = W.partitionBy("key", "bucket").orderBy("name").rowsBetween(W.unboundedPreceding, -1)
        laid = laid.join(offsets, ["key", "bucket"]).withColumn("first", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        self.laid = laid.withColumn("end", F.col("first") + F.col("size"))

        parts = self.laid.where("size > 0").select("doc_id", "name", "key", "first", "end", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
        start, stop = F.greatest("first", "from"), F.least("end", "to")
        #: The mix in slot order: slot, key, rank, pass, doc_id, name, first and end (of the row in its stream), start (word of the text) and words
        self.spans = parts.join(self.slots, ["key", "block"]).where(start < stop).select("slot", "key", "rank", "pass", "doc_id", "name", "first", "end", (start - F.col("first")).alias("start"), (stop - start).alias("words"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words of each document in the slots of the mix; first_slot and slots, where they lie."""
    mix = Mix(docs, weights, share, cap)
    taken = mix.spans.groupBy("key", "first", "end").agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("slots"))
    out = mix.laid.join(taken, ["key", "first", "end"], "left").join(mix.sources.select("key", "source_size", "target"), "key")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", F.coalesce("slots", F.lit(0)).alias("slots"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them, in slot order: a row for each pass in which any of its words is taken.

    Documents stay whole, so a source's rows hold more words than its target by less than one document: that in
    which its last pass is cut. Rows with equal id, source and text are told apart by number only: they share the
    smallest of their other columns.
    """
    taken = Mix(docs).spans.groupBy(F.col("name").alias("row"), "first", "pass").agg(F.min("slot").alias("slot"), F.min("start").alias("start")).select("row", "slot", "start", "first")
    keys = [c for c in ("doc_id", "source", "text") if c in docs.columns]
    others = F.struct(*[docs[c] for c in docs.columns if c not in keys], F.lit(0).alias("_"))
    rows = docs.groupBy(row_name().alias("row")).agg(F.struct(*[F.first(c).alias(c) for c in keys]).alias("keys"), F.min(others).alias("others"))
    found = rows.join(taken, "row").orderBy("slot", "first", "start")
    return found.select(*[F.col(f"keys.{c}" if c in keys else f"others.{c}").alias(c) for c in docs.columns])


def op3_mixing(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "slots")


#: The schedule by the same whole-number points; the step is the nearest number to the golden ratio's share that has no common divisor.
ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                      md5(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(text) || ':' || text, '-')) AS name FROM documents),
named AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM named),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
targets AS (SELECT source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, CAST(source_size AS BIGINT) AS source_size, least(source_size * 2.0::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
planned AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, (source_size + 127) // 128 AS blocks FROM targets WHERE source_size > 0),
shared AS (SELECT *, (words // source_size) * blocks + (words % source_size + 127) // 128 AS slots FROM planned),
cumulated AS (SELECT *, CAST(sum(slots) OVER (ORDER BY key) AS BIGINT) AS high, CAST(sum(slots) OVER () AS BIGINT) AS n FROM shared),
steps AS (SELECT n, first(a ORDER BY abs(a - near), a) AS step FROM (SELECT n, near, unnest(range(greatest(near - 200, 1), near + 201)) AS a FROM (SELECT DISTINCT n, CAST(round(n * 0.6180339887498949::DOUBLE) AS BIGINT) AS near FROM cumulated)) WHERE gcd(a, n) = 1 GROUP BY n),
points AS (SELECT slot, slot * step % n AS point FROM (SELECT n, step, unnest(range(n)) AS slot FROM steps)),
slots AS (SELECT source, slot, source_size, words, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS rank, blocks FROM points JOIN cumulated ON point >= high - slots AND point < high),
places AS (SELECT source, slot, rank % blocks AS block, least((rank % blocks) * 128 + 128, CASE WHEN rank // blocks < words // source_size THEN source_size ELSE words % source_size END) AS stop FROM slots),
laid AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, row_number() OVER (ORDER BY name) AS number FROM sized),
parts AS (SELECT *, unnest(range(CAST(first // 128 AS BIGINT), CAST((first + size - 1) // 128 + 1 AS BIGINT))) AS block FROM laid WHERE size > 0),
met AS (SELECT number, slot, least(first + size, stop) - greatest(first, parts.block * 128) AS words FROM parts JOIN places ON parts.source IS NOT DISTINCT FROM places.source AND parts.block = places.block),
taken AS (SELECT number, sum(words) AS taken, min(slot) AS first_slot, count(*) AS slots FROM met WHERE words > 0 GROUP BY number)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_slot, coalesce(slots, 0) AS slots
FROM laid JOIN targets ON laid.source IS NOT DISTINCT FROM targets.source LEFT JOIN taken USING (number)
"""
