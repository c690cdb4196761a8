"""SuperMinHash near-duplicates: correlated ranks, bands, exact verification, union-find.

Every shingle draws a permutation of the signature's places, one step of a Fisher-Yates shuffle at a time; in
step j it offers the value j + r (r uniform in 0 to 1) at the place drawn. A place keeps its smallest value. As
a shingle gives each rank once, the places are negatively correlated, so the estimate varies less than with
independent hashes. Values of step j are at least j, so a document is done as soon as no place is above the
step: long documents after one or two steps, one shingle after all of them.

Signatures are cut into ``BANDS`` bands of ``ROWS`` places; sets that share a band are a list. Sets at the
threshold 0.8 share no band with probability (1 - 0.8**4)**40 < 1e-9 each, sets at 0.85 with 2e-13; nothing else
is left to chance:

1. The set of a list that meets most others, over all lists, is its pivot. Every member is compared with it on
   the full sets, and what links is joined by union-find over Spark tables.
2. Lists that still hold more than one component are compared inside, member by member, but never within a
   component. A large list is dealt to tiles: only sets outside its largest component meet all others.

Equal sets are one node, whatever their number. A list's members meet in runs of ``RUN_SETS`` beside a copy of
the pivot, so a group of near copies is many tasks, and no pair within it is listed but that with the pivot.

Defined results: lower case is A-Z only; a text with fewer words than a shingle has its whole word sequence as
the one shingle; null and empty texts have no shingles, link with nothing and are their own component; a row is
known by its doc_id and text, so rows that repeat a doc_id or have none are linked only by their sets; an empty
table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm import ngram_join
from subtide.llm.common import SpanHasher, fan_out, flat, lean, mix, pieces, tabled
from subtide.llm.ngram_join import components, links_in_bundle, set_ids, shingle_sets

BANDS, ROWS, RUN_SETS = 40, 4, 256
#: Bounds of a tile: sets, and shingles (8 bytes each) of all its sets and of those outside the main component.
TILE_SETS, REST_SETS, TILE_SHINGLES, REST_SHINGLES = 2048, 1024, 2_000_000, 1_000_000
_C = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)
_LOW = np.uint64((1 << 32) - 1)


def signatures(sets: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """A row of ``m`` values (at most 256) for each set: 32 bits of the rank's number, then 32 of its fraction; all ones for an empty set."""
    n = len(bounds) - 1
    out = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    live, order = np.arange(len(sets)), None
    for j in range(m):
        drawn = mix(sets[live] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64)))
        k = j + ((drawn & _LOW) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = k
        else:
            rows = np.arange(len(live))
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        np.minimum.at(out, owner[live] * m + place, (drawn >> np.uint64(32)) | np.uint64(j << 32))
        open_ = (out.reshape(n, m) >= np.uint64(j + 1 << 32)).any(1)[owner[live]]
        if not open_.any():
            break
        live, k = live[open_], k[open_]
        if order is None:  # only now are permutations needed; documents with many shingles are done
            order = np.tile(np.arange(m, dtype=np.uint8), (len(live), 1))
            order[np.arange(len(live)), k] = 0
        else:
            order = order[open_]
    return out.reshape(n, m)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """For each signature the hashes of its bands of ``rows`` places, told apart by their number."""
    n, m = values.shape
    bands = values.reshape(n, m // rows, rows)
    return mix((mix(bands) * _C[:rows]).sum(2, dtype=np.uint64) + _C[32] * np.arange(1, m // rows + 1, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, words: int, bands: int, rows: int, hasher: SpanHasher) -> DataFrame:
    """doc_id, n_shingles, set_id and bands (null without shingles)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = flat(batch.column(1))
            for i, j, part, own in pieces(data, offsets):
                sets, bounds = shingle_sets(part, own, words, hasher)
                n = np.diff(bounds)
                keys = band_keys(signatures(sets, bounds, bands * rows), rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys.ravel()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(set_ids(sets, bounds), mask=n == 0), lists], names=["doc_id", "n_shingles", "set_id", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(batches), f"doc_id {kind}, n_shingles long, set_id long, bands array<long>")


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a) or len(b) * num > len(a) * den:
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common * (num + den) >= num * (len(a) + len(b))


def pivot_links(asked: DataFrame, words: int, num: int, den: int, hasher: SpanHasher) -> DataFrame:
    """a, b of asked(pivot, run, role, set_id, text): members (role 1) that link with the pivot (role 0) of their run."""

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in it:
            role, node, pivot = (batch.column(c).to_numpy() for c in ("role", "set_id", "pivot"))
            data, offsets = flat(batch.column("text"))
            hit = []
            for i, j, part, ends in pieces(data, offsets):
                sets, bounds = shingle_sets(part, ends, words, hasher)
                for k in range(i, j):
                    mine = sets[bounds[k - i] : bounds[k - i + 1]]
                    if role[k] == 0:
                        own = mine.copy()
                    elif _linked(own, mine, num, den):
                        hit.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(node[hit], pa.int64()), pa.array(pivot[hit], pa.int64())], names=["a", "b"])

    sorted_runs = asked.repartition(fan_out(asked.sparkSession), "pivot", "run").sortWithinPartitions("pivot", "run", "role")
    return sorted_runs.select("pivot", "role", "set_id", "text").mapInArrow(lean(verify), "a long, b long")


def tile_links(tiles: DataFrame, words: int, num: int, den: int, hasher: SpanHasher) -> DataFrame:
    """a, b of tiles(tile, set_id, part, text): sets of a tile that link, directly or by way of others, and are not of one part."""

    def edges(nodes: list[int], parts: list[int], sets: list[np.ndarray]) -> np.ndarray:
        node, first = np.unique(np.array(nodes, np.int64), return_index=True)
        if len(node) < 2:
            return np.zeros((0, 2), np.int64)
        root = node[links_in_bundle([sets[i] for i in first], num, den, np.array(parts)[first])]
        return np.stack([node, root], 1)[node != root]

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, nodes, parts, sets = None, [], [], []
        for batch in it:
            at, node, part = (batch.column(c).to_numpy() for c in ("tile", "set_id", "part"))
            data, offsets = flat(batch.column("text"))
            found = []
            for i, j, piece, ends in pieces(data, offsets):
                values, bounds = shingle_sets(piece, ends, words, hasher)
                for k in range(i, j):
                    if at[k] != tile:
                        found.append(edges(nodes, parts, sets))
                        tile, nodes, parts, sets = at[k], [], [], []
                    nodes.append(int(node[k]))
                    parts.append(int(part[k]))
                    sets.append(values[bounds[k - i] : bounds[k - i + 1]].copy())
            if found:
                pairs = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])
        pairs = edges(nodes, parts, sets)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    sorted_tiles = tiles.repartition(fan_out(tiles.sparkSession), "tile").sortWithinPartitions("tile", "set_id")
    return sorted_tiles.select("tile", "set_id", "part", "text").mapInArrow(lean(join), "a long, b long")


def open_tiles(members: DataFrame, labels: DataFrame) -> DataFrame:
    """tile, set_id, part: the lists(list, set_id, size) whose sets lie in several components, cut so that all pairs across components meet; lists with the same sets once."""
    labelled = tabled(members.join(labels.select(F.col("node").alias("set_id"), "root"), "set_id", "left").select("list", "set_id", "size", F.coalesce("root", "set_id").alias("part")))
    kinds = labelled.groupBy("list").agg(F.count("*").alias("n"), (F.min("part") < F.max("part")).alias("split"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"))
    chosen = kinds.where("split AND n > 2").groupBy("n", "x", "y").agg(F.min("list").alias("list")).select("list")
    own = tabled(labelled.join(chosen, "list"))
    sized = own.groupBy("list", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    main = sized.groupBy("list").agg(F.max(F.struct("n", "size", "part")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("total"))
    rows = F.greatest(F.ceil((F.col("n") - F.col("main.n")) / REST_SETS), F.ceil((F.col("total") - F.col("main.size")) / REST_SHINGLES))
    columns = F.greatest(F.ceil(F.col("n") / TILE_SETS), F.ceil(F.col("total") / TILE_SHINGLES))
    tiled = own.join(main, "list").select("list", "set_id", "part", (F.col("part") != F.col("main.part")).alias("rest"), rows.alias("rows"), columns.alias("columns"))
    place = F.xxhash64("set_id")
    all_rows = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.pmod(place, F.col("columns")).alias("j")))
    all_columns = F.transform(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1), lambda j: F.struct(F.pmod(place, F.col("rows")).alias("i"), j.alias("j")))
    dealt = tiled.select("list", "set_id", "part", F.explode(F.when(F.col("rest"), F.array_union(all_rows, all_columns)).otherwise(all_rows)).alias("tile"))
    return dealt.select(F.xxhash64("list", "tile").alias("tile"), "set_id", "part")


def meetings(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists(list, set_id, size) of sets that share a band, and the pairs(set_id, pivot) of each member with the pivot of its list.

    The pivot is the set that meets others most often, over all its lists: of a group of near copies that is the
    text they were made from, with which they link though they may not link with each other.
    """
    held = sets.select("set_id", F.col("n_shingles").alias("size"), F.explode("bands").alias("list"))
    shared = tabled(held.groupBy("list").agg(F.count("*").alias("n")).where("n > 1"))
    members = tabled(held.join(shared, "list"))
    meets = members.groupBy("set_id").agg(F.sum("n").alias("meets"))
    pivots = members.join(meets, "set_id").groupBy("list").agg(F.max_by("set_id", F.struct("meets", "set_id")).alias("pivot"))
    edges = members.join(tabled(pivots), "list").where("set_id <> pivot").select("set_id", "pivot").distinct()
    return members.select("list", "set_id", "size"), tabled(edges)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id, kept: documents link when den * |A & B| >= num * |A | B|."""
    hasher = SpanHasher()
    keyed = docs.select(ngram_join._row_key().alias("doc_id"), "text")
    own = tabled(signed(keyed, words, bands, rows, hasher))
    sets = tabled(own.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    named = sets.select("set_id", "doc_id")

    def texts(wanted: DataFrame) -> DataFrame:
        """``wanted``, with the text of one document of each set_id."""
        return keyed.join(wanted.join(named, "set_id"), "doc_id").drop("doc_id")

    members, edges = meetings(sets)
    runs = edges.groupBy("pivot").agg(F.ceil(F.count("*") / RUN_SETS).alias("runs"))
    asked = edges.join(runs, "pivot").select("pivot", F.pmod(F.xxhash64("set_id"), F.col("runs")).alias("run"), F.lit(1).alias("role"), "set_id")
    asked = tabled(asked)
    pivots = asked.select("pivot", "run", F.lit(0).alias("role"), F.col("pivot").alias("set_id")).distinct()
    links = tabled(pivot_links(texts(asked.unionByName(pivots)), words, num, den, hasher))
    labels = components(links)

    tiles = tabled(open_tiles(members, labels))
    if tiles.limit(1).count():
        more = tabled(tile_links(texts(tiles), words, num, den, hasher))
        labels = components(links.unionByName(more))

    placed = named.join(labels.select(F.col("node").alias("set_id"), "root"), "set_id", "left").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    placed = tabled(placed)
    by_set = placed.join(placed.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select("set_id", "component")
    out = own.select("doc_id", "n_shingles", "set_id").join(by_set, "set_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    kept = F.when(F.col("doc_id.missing"), F.col("doc_id") == F.col("component")).otherwise(F.col("doc_id.id").eqNullSafe(F.col("component.id")))
    return out.select(F.col("doc_id.id").alias("doc_id"), "n_shingles", "set_id", F.col("component.id").alias("component_id"), kept.alias("kept"))


def op12_superminhash(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=4, num=80, den=100).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = f"SELECT *, doc_id = component_id AS kept FROM ({ngram_join.ORACLE.replace('100 * c >= 85', '100 * c >= 80')})"
