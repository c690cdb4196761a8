"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency ln(n / df) lies in a band; document
frequencies are exact counts over all documents. A fingerprint has one hash for each of several
random subsets of the lexicon, of several densities: the hash of the document's sorted distinct
terms in that subset. Sparse subsets survive edits of long documents, dense ones tell short
documents apart. Likeness is the share of equal hashes among the subsets that either document uses.

The band bounds the lexicon: with df >= share * n there are at most (mean distinct terms) / share
terms, whatever n is. It is kept as a Bloom table (three probes, a power of two of bits with 46 a term
at least, so that a foreign term passes with a chance below 3e-4), a constant of the plan whose size
follows the lexicon's, so that no term is shuffled after the counts.

Defined results: a null text is empty; a document without lexicon terms is hashed by all its terms;
with no terms, all subsets are empty. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from subtide.llm.common import tabled

BAND = (math.log(1 / 0.1), math.log(1 / 0.001))  # least and greatest inverse document frequency
LEAST_DF = 2
#: Bits of the table for each term of the lexicon, and log2 of its least size.
BITS_PER_TERM, LEAST_BITS = 46, 16
#: A subset keeps a term whose hash has this many zero bits from this bit on.
SUBSETS = [(0, 1), (1, 1), (2, 1), (3, 3), (6, 3), (9, 3), (12, 5), (17, 5), (22, 5), (27, 7), (34, 7), (41, 7)]
EMPTY = "-" * 16


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased terms."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+")
    return F.array_distinct(F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w)))


def _probes(term: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(term, s).bitwiseAND(F.lit((1 << bits) - 1)) for s in (0, (64 - bits) // 2, 64 - bits)]


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Term hashes in the band, with their document frequencies."""
    n = docs.count()
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    least, most = max(LEAST_DF, math.ceil(n * math.exp(-band[1]))), max(LEAST_DF, math.floor(n * math.exp(-band[0])))
    return counted.where(F.col("df").between(least, most))


def bloom(words: DataFrame) -> tuple[Column, int]:
    """The lexicon as a constant array of 64-bit words, and log2 of its bits."""
    words = tabled(words.select("term"))
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, words.count()) * BITS_PER_TERM)))
    spark, size = words.sparkSession, 1 << (bits - 6)
    at = words.select(F.explode(F.array(*_probes(F.col("term"), bits))).alias("bit"))
    marked = at.select(F.shiftrightunsigned("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    table = marked.unionByName(spark.range(size).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("mask"))).groupBy("at").agg(F.bit_or("mask").alias("mask"))
    whole = table.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "mask"))), lambda x: x["mask"].cast("string")), " ")).first()[0]
    return F.split(F.lit(whole), " ").cast("array<bigint>"), bits  # a constant, folded once; 8 bytes for each term or two


def in_lexicon(found: Column, table: tuple[Column, int]) -> Column:
    words, bits = table

    def known(term: Column) -> Column:
        hits = [F.call_function("shiftrightunsigned", words[F.shiftrightunsigned(p, 6).cast("int")], p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in _probes(term, bits)]
        return hits[0] & hits[1] & hits[2]

    return F.filter(found, known)


def with_fingerprint(df: DataFrame, text: str, name: str, table: tuple[Column, int]) -> DataFrame:
    """``df`` with the fingerprint of a text column: the subsets' hashes, joined by dots."""
    found, kept, parts = f"{name}_terms", f"{name}_kept", []
    df = df.withColumn(found, terms(F.col(text))).withColumn(kept, in_lexicon(F.col(found), table))
    df = df.withColumn(kept, F.sort_array(F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.col(found))))
    for at, zeros in SUBSETS:
        df = df.withColumn(f"{name}_{at}", _subset(F.col(kept), at, zeros))
        parts.append(F.when(F.size(f"{name}_{at}") == 0, EMPTY).otherwise(F.lpad(F.lower(F.hex(F.xxhash64(f"{name}_{at}"))), 16, "0")))
    return df.withColumn(name, F.concat_ws(".", *parts)).drop(found, kept, *[f"{name}_{at}" for at, _ in SUBSETS])


def _subset(found: Column, at: int, zeros: int) -> Column:
    return F.filter(found, lambda t: F.shiftrightunsigned(t, at).bitwiseAND(F.lit((1 << zeros) - 1)) == 0)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among subsets that are not empty in both; 1 where all are."""
    pairs = F.filter(F.arrays_zip(F.split(a, "\\.").alias("a"), F.split(b, "\\.").alias("b")), lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY))
    equal = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(equal / F.size(pairs))


def _range_of(ids: DataFrame, n: int) -> Column:
    """The number of the range that a doc_id falls in, of about sqrt(n) with about equal shares of the rows.

    The bounds are quantiles of a sample of ids, some 64 for each range; they only decide which rows are
    sorted together. They are a constant array, searched by halving.
    """
    ranges = max(1, math.isqrt(n))
    drawn = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (64 * ranges)))) == 0)
    shares = F.split(F.lit(" ".join(str(i / ranges) for i in range(ranges))), " ").cast("array<double>")
    bounds = drawn.agg(F.percentile_approx("doc_id", shares, 64 * ranges)).first()[0] or [0]
    bounds = sorted(set(bounds))
    table = F.split(F.lit(" ".join(map(str, bounds))), " ").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step) <= F.col("doc_id"), at + step).otherwise(at))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` with next_<column>: those of the document with the next smaller doc_id, the largest after the smallest.

    Ids are dealt to about sqrt(n) ranges; the last row of a range is sent along to the one after it.
    Rows that repeat an id follow each other by text; rows without an id follow each other.
    """
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    place = F.when(F.col("doc_id").isNotNull(), _range_of(ids, ids.count()))
    ends = ids.groupBy(place.alias("range")).agg(F.max("doc_id").alias("doc_id"))
    order = W.orderBy("range")
    follows = F.coalesce(F.lead("range").over(order), F.min("range").over(W.partitionBy()))
    ends = ends.select("doc_id", follows.alias("to"))  # a row for each range: sqrt(n) at most
    sent = docs.join(F.broadcast(ends), "doc_id", "left").withColumn("to", F.when(F.col("to").isNull(), F.array(place)).otherwise(F.array(place, F.col("to"))))
    sent = sent.select(*[c for c in sent.columns if c != "to"], F.posexplode("to").alias("copy", "range"))
    step = W.partitionBy("range").orderBy(F.col("copy").desc(), "doc_id", "text")
    return sent.withColumns({f"next_{c}": F.lag(c).over(step) for c in carried}).where("copy = 0").drop("copy", "range")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, whose second half is the beginning of the next document's text."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = bloom(lexicon(docs))
    own = with_next(with_fingerprint(docs, "text", "fingerprint", table), ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = own.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    edited = with_fingerprint(edited, "edited", "edited_fingerprint", table)
    return edited.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")
    )


def op6_imatch(spark, sf_dir) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
