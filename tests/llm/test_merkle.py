"""The Merkle manifest against a plain tree, with small chunks so that the butterfly has rounds."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from subtide.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fanout):
    """The root and for each leaf the list of its (left, right) siblings."""
    ways, spots, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, at in enumerate(spots):
            run = at - at % fanout
            ways[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fanout])))
            spots[i] = at // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((-1 if r[0] is None else r[0], leaf_of((r[0], r[3], r[2], r[4], r[1]))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x for _, x in sorted(groups[g])], fanout) for g in names}
    root, above = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, above, strict=True):
        out += [(k, leaf, trees[g][0], root, way + top) for (k, leaf), way in zip(sorted(groups[g]), trees[g][1], strict=True)]
    return sorted(out)


def rows_of(n):
    langs = ["en"] * 6 + ["de", None, "", "é"]
    rows = [(i * 7 % 101, f"text {i} é" * (i % 5), langs[i * i % len(langs)], None if i % 4 == 0 else "s", None if i % 6 == 0 else i) for i in range(n)]
    return [*rows, (5, None, "en", None, None), (5, None, "en", None, None), (None, "x" * 50_000, "en", "s", 1), (None, "", None, "", 0), (1, "lone", "zz", "s", 4)]


@pytest.mark.parametrize(("n", "fanout", "chunk"), [(90, 2, 4), (90, 2, 1), (61, 3, 9), (3, 2, 64), (47, 4, 1)])
def test_manifest(spark, n, fanout, chunk):
    rows = rows_of(n)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS)
    found = merkle.manifest(docs, fanout=fanout, chunk=chunk).withColumn("back", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in found)
    assert got == brute(rows, fanout) and all(r.back == r.root for r in found)


def test_tampering_is_found(spark, tmp_path):
    rows = rows_of(90)
    spark.createDataFrame([(*r, "clash") for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    hit = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    for r in merkle.op11_merkle(spark, str(tmp_path)).collect():
        counted = [x[4] for x in rows if x[0] == r.doc_id]
        assert r.verified == (r.doc_id not in hit or counted[0] is None) == (r.folded_root == r.root)


def test_a_row_alone_and_none(spark):
    alone = merkle.manifest(spark.createDataFrame([(1, "a", None, "s", 1, "")], DOCS)).collect()
    assert len(alone) == 1 and alone[0].leaf == alone[0].subroot == alone[0].root and alone[0].proof == []
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        merkle.forest(spark.createDataFrame([], "group string, leaf string"), [], 3, 10)
