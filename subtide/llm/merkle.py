"""Merkle manifest of a table: a hash for every row, group and the whole, with a proof for each row.

Rows of a group are put in order and cut into aligned chunks of ``CHUNK`` leaves, a power of the fanout; each
chunk is folded to its root where it lies. The upper levels are a butterfly: in each round the chunks of an
aligned run of ``fanout`` blocks swap the roots of their blocks, chunk by chunk at equal places, and every one
of them hashes the same ancestor. After log(chunks) rounds each chunk holds the group's root and all siblings
on its way, so no pass leads down again. The last block of a group may be short: its chunks then also answer
for the places it lacks. A second tree of the same kind stands over the groups' roots.

Places in a group are counted over range partitions (a count for each partition and group, then places
within), so no group is ordered in one task, and no step gathers more than a chunk or a run.

Defined results: a null is ``-``; null ids come first in their group; rows equal in every hashed column are
leaves of their own, with equal hashes, next to each other; a null group comes first and differs from an
empty name; an empty table has no rows and no root; columns that are not hashed are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from subtide.llm.common import fan_out, lean, tabled

FANOUT, CHUNK, FIELDS = 2, 1 << 12, ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def _named(column: Column | str) -> Column:
    """The column as a string that is never null and sorts null first."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.isNull(), "0").otherwise(F.concat(F.lit("1"), column.cast("string")))


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 over the fields, each ``-`` if null, else its byte count, ``:`` and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_hash(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def tree(nodes: list[str], fanout: int, levels: int | None) -> tuple[str, list[tuple[list[str], list[str]]]]:
    """The root of the nodes and, level by level, what stands left and right of each node in its run.

    ``levels``: so many levels whatever the number of nodes; None: until one is left.
    """
    sides = []
    while len(nodes) > 1 if levels is None else len(sides) < levels:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        sides.append(([x for r in runs for x in ("".join(r[:k]) for k in range(len(r)))], [x for r in runs for x in ("".join(r[k + 1 :]) for k in range(len(r)))]))
        nodes = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
    return nodes[0], sides


def _levels(chunk: int, fanout: int) -> int:
    return next(k for k in range(chunk + 1) if fanout**k >= chunk)


def placed(leaves: DataFrame, order: list[str], chunk: int) -> DataFrame:
    """``leaves`` (group, leaf, order columns) with chunk, place (in the chunk) and chunks (of the group), written to the shared folder."""
    names = leaves.columns

    def numbered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in it:
            group = batch.column("group").to_numpy(zero_copy_only=False)
            heads = np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1) if len(group) else np.zeros(0, np.int64)
            first = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group)))) if len(group) else heads
            if len(group):
                if group[0] == last:
                    first[: heads[1] if len(heads) > 1 else len(group)] += seen
                last, seen = group[-1], int(first[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64())], names=[*batch.schema.names, "first"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)
    n = fan_out(leaves.sparkSession)
    ranged = leaves.repartitionByRange(n, "group", *order, "leaf").sortWithinPartitions("group", *order, "leaf")
    ranged = tabled(ranged.mapInArrow(lean(numbered), f"{kinds}, first long").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("group", "part").agg(F.count("*").alias("n"))
    own = W.partitionBy("group")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select("group", "part", before.alias("before"), F.ceil(F.sum("n").over(own) / chunk).alias("chunks"))
    at = F.col("before") + F.col("first")
    return tabled(ranged.join(sums, ["group", "part"]).select(*names, F.floor(at / chunk).alias("chunk"), (at % chunk).cast("int").alias("place"), "chunks"))


def butterfly(chunks: DataFrame, fanout: int) -> DataFrame:
    """chunks(group, chunk, chunks, root): with the group's root in place of the chunk's, and proof, the siblings on the way there."""
    state = tabled(chunks.select("group", "chunk", "chunks", "root", F.expr(f"cast(array() as {PROOF})").alias("proof")))
    most, width = state.agg(F.coalesce(F.max("chunks"), F.lit(0))).first()[0], 1
    while width < most:
        start = F.floor(F.col("chunk") / width) * width
        have = F.least(F.lit(width), F.col("chunks") - start)  # chunks of this block; they answer for all its places
        # every chunk answers for its own place and, in a short block, for the places after it that nobody holds
        places = F.sequence(F.col("chunk") - start, F.lit(width - 1).cast("long"), have)
        sent = state.where(F.col("chunks") > width).select("*", F.explode(places).alias("at"), F.floor(F.col("chunk") / (width * fanout)).alias("run"))
        met = sent.groupBy("group", "run", "at").agg(F.array_sort(F.collect_list(F.struct("chunk", "root", "proof", "chunks"))).alias("swapped"))
        roots = F.transform("swapped", lambda x: x["root"])
        met = met.select("group", "at", roots.alias("roots"), F.posexplode("swapped").alias("k", "own"))
        met = met.where(F.col("own.chunk") % width == F.col("at"))
        side = F.struct(F.array_join(F.slice("roots", 1, F.col("k")), "").alias("left"), F.array_join(F.slice("roots", F.col("k") + 2, fanout), "").alias("right"))
        raised = met.select("group", "own.chunk", "own.chunks", F.sha2(F.array_join("roots", ""), 256).alias("root"), F.concat("own.proof", F.array(side)).alias("proof"))
        state = tabled(raised.unionByName(state.where(F.col("chunks") <= width)))
        width *= fanout
    return state


def forest(leaves: DataFrame, order: list[str], fanout: int = FANOUT, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """leaves(group, leaf, order columns): the placed leaves, and of each chunk the group's root with the proof above the chunk."""
    if chunk != fanout ** (levels := _levels(chunk, fanout)):
        raise ValueError("a chunk is a power of the fanout")

    def root(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("place")
        many = ordered["chunks"][0].as_py() > 1
        top = tree(ordered["leaf"].to_pylist(), fanout, levels if many else None)[0]
        return pa.table({"group": ordered["group"][:1], "chunk": ordered["chunk"][:1], "chunks": ordered["chunks"][:1], "root": [top]})

    own = placed(leaves, order, chunk)
    roots = own.groupBy("group", "chunk").applyInArrow(lean(root), "group string, chunk long, chunks long, root string")
    return own, butterfly(roots, fanout)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: tuple[str, ...] = ("doc_id",), changed: Column | None = None, fanout: int = FANOUT, chunk: int = CHUNK) -> DataFrame:
    """Per row: the order columns, leaf, subroot (of its group), root and proof (per level what stands left and right); with ``changed``, the hash of a changed row, also that."""
    names = [f"o{i}" for i in range(len(order))]
    leaf = leaf_hash(*[F.col(f) for f in fields])
    leaves = docs.select(_named(group).alias("group"), leaf.alias("leaf"), *[F.col(o).alias(n) for o, n in zip(order, names, strict=True)], (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    own, upper = forest(leaves, names, fanout, chunk)
    tops = tabled(upper.where("chunk = 0").select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("root").alias("leaf")))
    tops, above = forest(tops, ["name"], fanout, chunk)
    tops = proved(tops, above, ["name", "leaf"], fanout, chunk)
    upper = tabled(upper.join(tops.select(F.col("name").alias("group"), F.col("leaf").alias("subroot"), F.col("root").alias("whole"), F.col("proof").alias("above")), "group").select("group", "chunk", "subroot", F.col("whole").alias("root"), F.concat("proof", "above").alias("proof")))
    found = proved(own, upper, [*names, "leaf", "changed"], fanout, chunk, ["subroot"])
    return found.select(*[F.col(n).alias(o) for o, n in zip(order, names, strict=True)], "leaf", "changed", "subroot", "root", "proof")


def proved(own: DataFrame, upper: DataFrame, columns: list[str], fanout: int, chunk: int, more: list[str] | None = None) -> DataFrame:
    """The leaves with their chunk's ``more`` columns, root and whole proof."""
    more, levels = [*(more or []), "root"], _levels(chunk, fanout)
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    shape = ", ".join([*[f"{c} {kinds[c]}" for c in columns], *[f"{m} string" for m in more], f"proof {PROOF}"])
    pair = pa.struct([("left", pa.string()), ("right", pa.string())])

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        if not left.num_rows or not right.num_rows:
            return pa.table({c: left[c][:0] for c in columns} | {m: pa.array([], pa.string()) for m in more} | {"proof": pa.array([], pa.list_(pair))})
        n, above = left.num_rows, right["proof"][0].as_py()
        _, sides = tree(left["leaf"].to_pylist(), fanout, levels if left["chunks"][0].as_py() > 1 else None)
        lefts, rights = [], []
        for i in range(n):
            at = i
            for a, b in sides:
                lefts.append(a[at])
                rights.append(b[at])
                at //= fanout
            lefts += [p["left"] for p in above]
            rights += [p["right"] for p in above]
        steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(pair))
        proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (len(sides) + len(above)), pa.int32()), steps)
        return pa.table({c: left[c] for c in columns} | {m: pa.array([right[m][0].as_py()] * n, pa.string()) for m in more} | {"proof": proof})

    return own.groupBy("group", "chunk").cogroup(upper.groupBy("group", "chunk")).applyInArrow(lean(prove), shape)


def op11_merkle(spark, sf_dir) -> DataFrame:
    """The manifest of documents, checked against a tampered copy: where 7 divides crc32 of the id, n_chars is one more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(hit, leaf_hash(*[F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]))
    found = manifest(docs, changed=changed)
    back = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    rows = found.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The trees level by level; crc32 bit by bit over the digits of the id.
ORACLE = r"""
WITH RECURSIVE fields AS (SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
                          coalesce(octet_length(encode(text)) || ':' || text, '-') AS z FROM documents),
leaves AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, sha256(a || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || CAST(n_chars AS VARCHAR), '-') || z) AS leaf,
                  sha256(a || coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || z) AS changed,
                  list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1)))),
                              lambda crc, b: CASE WHEN (crc & 1) <> b THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END) AS crc FROM fields),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
nodes AS (SELECT 0 AS level, grp, pos, leaf AS h, n FROM ranked UNION ALL SELECT level + 1, grp, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY level, grp, pos // 2, n),
subroots AS (SELECT grp, level AS height, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, pos, h, n FROM subroots UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
root AS (SELECT h AS root, level AS height FROM tops WHERE n = 1),
heights AS (SELECT unnest(range(64)) AS level),
own AS (SELECT r.grp, r.pos, l.level AS step, (r.pos >> l.level) % 2 AS side, coalesce(o.h, '') AS h FROM ranked r JOIN subroots s ON r.grp = s.grp JOIN heights l ON l.level < s.height LEFT JOIN nodes o ON o.grp = r.grp AND o.level = l.level AND o.pos = xor(r.pos >> l.level, 1)),
above AS (SELECT s.grp, s.height + l.level AS step, (s.pos >> l.level) % 2 AS side, coalesce(o.h, '') AS h FROM subroots s JOIN root ON true JOIN heights l ON l.level < root.height LEFT JOIN tops o ON o.level = l.level AND o.pos = xor(s.pos >> l.level, 1)),
steps AS (SELECT * FROM own UNION ALL SELECT r.grp, r.pos, step, side, h FROM ranked r JOIN above a ON r.grp = a.grp),
proofs AS (SELECT grp, pos, sha256(string_agg(h, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY grp, pos),
fold AS (SELECT grp, pos, 0 AS step, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN changed ELSE leaf END AS h FROM ranked
         UNION ALL SELECT f.grp, f.pos, f.step + 1, sha256(CASE WHEN side = 1 THEN s.h || f.h ELSE f.h || s.h END) FROM fold f JOIN steps s ON s.grp = f.grp AND s.pos = f.pos AND s.step = f.step)
SELECT doc_id, leaf, s.h AS subroot, root.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM ranked r JOIN subroots s ON r.grp = s.grp JOIN root ON true LEFT JOIN proofs p ON p.grp = r.grp AND p.pos = r.pos JOIN fold f ON f.grp = r.grp AND f.pos = r.pos AND f.step = s.height + root.height
"""
