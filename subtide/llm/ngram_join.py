"""N-gram Jaccard join: a count-vector R-tree inside bundles of documents that share a signature.

A document is the set of its distinct word shingles. Inside a bundle, shingles are hashed into groups
and the group counts are a point; an R-tree over the points bounds the overlap of two nodes, and of
two documents, by the summed coordinate minima; surviving pairs are verified on the sets.

An R-tree over millions of such points does not prune (they all lie about n / groups), so lists come
first. Two sets that link differ in at most d elements, d following from the smaller size. The hash
space is cut into ranges, and what a set has in a range that is not empty is a token, so two sets that
link differ in at most d ranges; if either has more than d tokens, the first d + 1 tokens of both in any
common order have one in common. The order begins with the tokens of most elements, which unrelated sets
share least. Every set sends the hashes of its first d + 1 tokens; a set with d tokens or fewer also sends
its n - ceil(similarity * n) + 1 smallest elements, of which two such sets that link share one. So every
key is made of content. Sets with a common key are a list; the R-tree prunes its pairs by the bound, and
what stays connected is tied together. Connected ties are a bundle. A link shares a list and is never
pruned, so none crosses bundles and the result is exact.

Equal sets are one node, whatever their number. Bundles over ``BUNDLE_SETS`` sets are not gathered:
their ties are verified as joins, and only if that leaves more than one component, blocks of the
bundle are joined with each other, tile by tile. Lists over ``LIST_SETS`` sets are cut likewise.

Defined results: lower case is A-Z only; a text with fewer words than a shingle has its whole word
sequence as the one shingle; null and empty texts have no shingles, link with nothing and are their own
component; a row is known by its doc_id and text, so rows that repeat a doc_id or have none are linked only by
their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import SpanHasher, checkpointed, fan_out, flat, lean, lowered, mix, pieces, tabled, word_spans

ENTRIES_PER_BUCKET, LIST_SETS, BUNDLE_SETS, TILE_SETS, REST_SETS, BYTES_PER_TASK, SPREAD = 1_000_000, 4096, 256, 256, 64, 16 << 20, 16
GROUPS, LEAF = 64, 16
_C = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their offsets."""
    low = lowered(data)
    starts, ends, first = word_spans(low, offsets)
    hashes = hasher.spans(hasher.sums(low), starts, ends)
    n = len(offsets) - 1
    counts = np.diff(first)
    owner = np.repeat(np.arange(n), counts)
    out, who = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= words:
        m = len(hashes) - words + 1
        out = np.zeros(m, np.uint64)
        for j in range(words):
            out += hashes[j : j + m] * _C[j]
        inside = owner[:m] == owner[words - 1 :]
        out, who = mix(out[inside]), owner[:m][inside]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        whole = [mix((hashes[first[i] : first[i + 1]] * _C[: counts[i]]).sum(dtype=np.uint64, keepdims=True) + _C[32 + counts[i]])[0] for i in short]
        out, who = np.concatenate([out, np.array(whole, np.uint64)]), np.concatenate([who, short])
        order = np.argsort(who, kind="stable")
        out, who = out[order], who[order]
    bounds = np.searchsorted(who, np.arange(n + 1))
    for i in range(n):
        out[bounds[i] : bounds[i + 1]].sort()
    distinct = np.ones(len(out), bool)
    distinct[1:] = (out[1:] != out[:-1]) | (who[1:] != who[:-1])
    return out[distinct], np.concatenate([[0], np.cumsum(distinct)])[bounds]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Wrapping sums of values between consecutive bounds."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def set_ids(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return mix(_sums(mix(sets ^ _C[60]), bounds) + np.diff(bounds).astype(np.uint64)).view(np.int64)


def groups_for(n: int) -> int:
    """Groups for a set of n shingles: a power of two that grows with n, so that unrelated sets differ in most groups."""
    return max(GROUPS, 1 << max(0, int(n) // 8).bit_length())


def group_counts(shingles: np.ndarray, groups: int) -> np.ndarray:
    """Shingles in each group; folds to fewer groups by summing, see ``folded``."""
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed(counts: np.ndarray) -> bytes:
    """A point in the narrowest of 8, 16 or 32 bits, named by the first byte."""
    kind = next(k for k in (1, 2, 4) if counts.max(initial=0) < 1 << 8 * k)
    return bytes([kind]) + counts.astype(f"<u{kind}").tobytes()


def unpacked(point: memoryview) -> np.ndarray:
    return np.frombuffer(point, f"<u{memoryview(point)[0]}", offset=1)


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points with the fewest groups that any of them has."""
    least = min(map(len, points))
    return np.stack([p.reshape(-1, least).sum(0, dtype=np.int64) for p in points])


class Bands:
    """Size bands: linking sets lie in one band or two neighbouring ones, and the lower one sets their ranges."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def _grow(self, n: int) -> None:
        while self.low[-1] <= n:
            least = (self.low[-1] - 1) * self.den // self.num + 1  # over the largest set that links with one of the band before
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * 1.2), least))

    def of(self, n: np.ndarray) -> np.ndarray:
        self._grow(int(n.max(initial=1)) + 1)
        return np.searchsorted(self.low, n, "right") - 1

    def differ(self, band: int) -> int:
        """The most elements in which sets differ that link, the smaller being of the band; 0 where only equal sets link."""
        return (self.low[band + 1] - 1) * (self.den - self.num) // self.num

    def ranges(self, band: int) -> int:
        """So many that nearly every set of the band has more than ``differ`` tokens; 1 where that cannot be."""
        d, n = self.differ(band), self.low[band]
        if d + 1 > 0.9 * n and n > 12 or d >= n:
            return 1
        m = d + 2
        while m < 16 * n:
            full = 1 - np.exp(n * np.log1p(-1 / m))
            if m * full - 3 * np.sqrt(m * full * (1 - full)) >= d + 1:
                break
            m += m // 16 + 1
        return m


def _first(keys: np.ndarray, who: np.ndarray, most: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """Places of the ``most[who]`` first entries of each owner, in the order of ``before``, then the keys."""
    order = np.lexsort((keys, *before[::-1], who))
    owner = who[order]
    rank = np.arange(len(order)) - np.searchsorted(owner, owner)
    return order[rank < most[owner]]


def signatures(sets: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes and the row of each."""
    sizes = np.diff(bounds)
    keys, rows = [], []
    if not len(sets):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = bands.of(sizes)
    mixed = mix(sets ^ _C[61])
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    every = range(int(own.max()) + 1)
    differ, ranges = np.array([bands.differ(b) for b in every]), np.array([bands.ranges(b) for b in every], np.uint64)
    for step in (0, 1):
        band = own - step
        d = np.where((sizes > 0) & (band >= 0), differ[np.maximum(band, 0)], 0)
        at = np.flatnonzero((d > 0)[owner])
        if not len(at):
            continue
        who = owner[at]
        label = mix((np.maximum(band, 0).astype(np.uint64) + np.uint64(1)) << np.uint64(40))
        part = ((sets[at] >> np.uint64(32)) * ranges[band[who]]) >> np.uint64(32)
        head = np.ones(len(at), bool)
        head[1:] = (part[1:] != part[:-1]) | (who[1:] != who[:-1])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(at))
        token = mix(mix(upto[at[last - 1] + 1] - upto[at[first]] + (last - first).astype(np.uint64)) + label[who[first]] + part[first])
        who = who[first]
        chosen = _first(token, who, d + 1, first - last)
        keys.append(token[chosen])
        rows.append(who[chosen])
        few = (d > 0) & (np.bincount(who, minlength=len(sizes)) <= d)
        at = at[few[owner[at]]]
        if len(at):
            most = sizes - (sizes * bands.num + bands.den - 1) // bands.den + 1
            element = mix(sets[at] ^ _C[62])
            chosen = _first(element, owner[at], most)
            keys.append(mix(element[chosen] + label[owner[at[chosen]]]))
            rows.append(owner[at[chosen]])
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def set_rows(docs: DataFrame, words: int, hasher: SpanHasher) -> DataFrame:
    """doc_id, n_shingles, set_id (null without shingles) and counts, the point of the R-tree."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = flat(batch.column(1))
            for i, j, part, own in pieces(data, offsets):
                sets, bounds = shingle_sets(part, own, words, hasher)
                n = np.diff(bounds)
                points = [packed(group_counts(sets[a:b], groups_for(b - a))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(set_ids(sets, bounds), mask=n == 0), pa.array(points, pa.binary())], names=["doc_id", "n_shingles", "set_id", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(batches), f"doc_id {kind}, n_shingles long, set_id long, counts binary")


def _lists(docs: DataFrame, words: int, num: int, den: int, buckets: int, hasher: SpanHasher) -> DataFrame:
    """task, list, node: the lists of sets with a common signature. Lists with the same smallest set go to ``SPREAD`` tasks."""

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in it:
            data, offsets = flat(batch.column(0))
            found = []
            for _, _, part, own in pieces(data, offsets):
                sets, bounds = shingle_sets(part, own, words, hasher)
                keys, rows = signatures(sets, bounds, bands)
                found.append(np.stack([keys.view(np.int64), set_ids(sets, bounds)[rows]], 1))
            if not found:
                continue
            found = np.concatenate(found)
            bucket = (found[:, 0].view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            found, bucket = found[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else []
            groups = [g for g in np.split(found, cuts) if len(g)]
            heads = bucket[np.concatenate([[0], cuts]).astype(int)] if len(bucket) else []
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(heads, np.int64)), pa.array([g.tobytes() for g in groups], pa.binary())], names=["bucket", "entries"])

    def meet(table: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in table["entries"]])
        found = found[np.argsort(found[:, 0], kind="stable")]
        same = found[1:, 0] == found[:-1, 0]
        found = found[np.append(same, False) | np.append(False, same)]
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        fresh = np.append(True, (found[1:] != found[:-1]).any(1)) if len(found) else np.zeros(0, bool)
        found = found[fresh]
        bounds = np.append(np.flatnonzero(np.append(True, found[1:, 0] != found[:-1, 0])), len(found)) if len(found) else np.zeros(1, np.int64)
        size, node = np.diff(bounds), np.ascontiguousarray(found[:, 1])
        name = mix(_sums(mix(node.view(np.uint64)), bounds) + size.astype(np.uint64))
        task = (mix(node.view(np.uint64)[bounds[:-1]]) + name % np.uint64(SPREAD)) % np.uint64(buckets)
        first = np.zeros(len(size), bool)
        first[np.unique(name, return_index=True)[1]] = True
        kept = np.repeat(first & (size > 1) & (size <= LIST_SETS), size)
        tasks, names, nodes = [np.repeat(task, size)[kept]], [np.repeat(name, size)[kept]], [node[kept]]
        for k in np.flatnonzero(first & (size > LIST_SETS)):
            blocks = np.array_split(node[bounds[k] : bounds[k + 1]], -(-2 * size[k] // LIST_SETS))
            for i in range(len(blocks)):
                for j in range(i):
                    part = mix(name[k : k + 1] + np.uint64(i << 32 | j))
                    nodes.append(np.concatenate([blocks[i], blocks[j]]))
                    names.append(np.repeat(part, len(nodes[-1])))
                    tasks.append(names[-1] % np.uint64(buckets))
        columns = (np.concatenate(x) for x in (tasks, names, nodes))
        return pa.table({c: pa.array(x.view(np.int64)) for c, x in zip(("task", "list", "node"), columns, strict=True)})

    sent = docs.select("text").mapInArrow(lean(send), "bucket long, entries binary")
    return sent.groupBy("bucket").applyInArrow(lean(meet), "task long, list long, node long")


def _ties(lists: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: sets that the bound leaves connected within a list, tied to one of them. A set's point is sent once to each task."""

    def prune(left: pa.Table, right: pa.Table) -> pa.Table:
        node, sizes = right["node"].to_numpy(), right["n"].to_numpy()
        order = np.argsort(node)
        node, sizes = node[order], sizes[order]
        points = [unpacked(x.as_buffer()) for x in right["counts"].take(pa.array(order))]
        name, own = left["list"].to_numpy(), np.searchsorted(node, left["node"].to_numpy())
        order = np.lexsort((own, name))
        name, own = name[order], own[order]
        fresh = np.append(True, (name[1:] != name[:-1]) | (own[1:] != own[:-1]))
        name, own = name[fresh], own[fresh]
        cuts = np.append(np.flatnonzero(np.append(True, name[1:] != name[:-1])), len(name))
        forest, ties = Forest(len(node)), []
        for k in np.argsort(cuts[:-1] - cuts[1:], kind="stable").tolist():  # long lists first: their parts are then known
            members = own[cuts[k] : cuts[k + 1]]
            if len(members) == 2:
                i, j = members.tolist()
                if forest.find(i) != forest.find(j) and int(np.minimum(*folded([points[i], points[j]])).sum()) * (num + den) >= num * int(sizes[i] + sizes[j]):
                    ties.append(forest.join(i, j))
            elif len(set(map(forest.find, members.tolist()))) > 1:
                tree = RTree(folded([points[i] for i in members]), sizes[members], num, den)
                ties += connect(forest, members, tree)
        ties = node[np.array(ties, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(np.ascontiguousarray(ties[:, 0])), "b": pa.array(np.ascontiguousarray(ties[:, 1]))})

    wanted = lists.select(F.col("task").alias("to"), F.col("node").alias("set_id")).distinct()
    sent = wanted.join(reps.select("set_id", "n", "counts"), "set_id").select("to", F.col("set_id").alias("node"), "n", "counts")
    return lists.groupBy("task").cogroup(sent.groupBy("to")).applyInArrow(lean(prune), "a long, b long").distinct()


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.find(a), self.find(b)
        self.root[max(x, y)] = min(x, y)
        return a, b


def connect(forest: Forest, members: np.ndarray, tree: RTree, links=None) -> list[tuple[int, int]]:
    """Join the members whose points the tree leaves possible (and ``links(i, j)`` confirms), never asking within a component.

    A component grows by one member at a time against those outside, so a group of near copies takes
    one pass and not a look at each pair. Gives the pairs that joined two components.
    """
    joined, rest = [], np.arange(len(members))
    labels = np.array([forest.find(i) for i in members.tolist()])

    def ask(x: int, others: np.ndarray) -> Iterator[int]:
        for y in tree.near(x, others).tolist():
            if links is None or links(x, y):
                yield y

    while len(rest) > 1:
        mine = labels[rest] == labels[rest[0]]
        frontier, rest = rest[mine], rest[~mine]
        while len(frontier) and len(rest):
            found = set()
            if len(rest) < len(frontier):
                for y in rest.tolist():
                    if labels[y] not in found and (x := next(ask(y, frontier), None)) is not None:
                        found.add(labels[y])
                        joined.append(forest.join(int(members[x]), int(members[y])))
                frontier = frontier[:0]
            else:
                x, frontier = int(frontier[0]), frontier[1:]
                for y in ask(x, rest):
                    if labels[y] not in found:
                        found.add(labels[y])
                        joined.append(forest.join(int(members[x]), int(members[y])))
            moved = np.isin(labels[rest], list(found)) if found else np.zeros(len(rest), bool)
            frontier, rest = np.concatenate([frontier, rest[moved]]), rest[~moved]
    return joined


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over the edges(a, b)."""
    edges = tabled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = tabled(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        jump = step.join(step.select(F.col("node").alias("to"), F.col("to").alias("on")), "to").select("node", F.col("on").alias("root"), "was")
        jump = tabled(jump)
        changed = jump.where("root <> was").limit(1).count()
        labels = jump.select("node", "root")
        if not changed:
            return labels


class RTree:
    """Points packed into leaves by recursive halving along the widest axis; a node keeps the maxima of its points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.points, self.sizes, self.num, self.den = points, sizes, num, den
        leaves: list[np.ndarray] = []
        self._split(np.arange(len(points)), leaves)
        self.leaf = np.empty(len(points), np.int64)
        for k, rows in enumerate(leaves):
            self.leaf[rows] = k
        self.most = np.stack([points[x].max(0) for x in leaves])
        self.least_size = np.array([sizes[x].min() for x in leaves])

    def _split(self, rows: np.ndarray, leaves: list[np.ndarray]) -> None:
        if len(rows) <= LEAF:
            leaves.append(rows)
            return
        own = self.points[rows]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        rows = rows[np.argsort(own[:, axis], kind="stable")]
        self._split(rows[: len(rows) // 2], leaves)
        self._split(rows[len(rows) // 2 :], leaves)

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        """The others whose bound allows a link with x: overlap <= summed minima, needed overlap >= num * (a + b) / (num + den)."""
        num, den = self.num, self.den
        fits = np.minimum(self.points[x], self.most).sum(1) * (num + den) >= num * (self.sizes[x] + self.least_size)
        others = others[fits[self.leaf[others]]]
        others = others[(self.sizes[others] * num <= self.sizes[x] * den) & (self.sizes[x] * num <= self.sizes[others] * den)]
        bound = np.minimum(self.points[x], self.points[others]).sum(1)
        return others[bound * (num + den) >= num * (self.sizes[x] + self.sizes[others])]


def links_in_bundle(sets: list[np.ndarray], num: int, den: int, known: np.ndarray | None = None) -> np.ndarray:
    """The component of each set (a row number); known: labels of sets already known to be linked."""
    forest = Forest(len(sets))
    if known is not None:
        seen: dict[int, int] = {}
        for i, label in enumerate(known.tolist()):
            forest.join(i, seen.setdefault(label, i))
    sizes = np.array([len(s) for s in sets])
    groups = groups_for(sizes.min())

    def links(x: int, y: int) -> bool:
        p, q = (sets[x], sets[y]) if sizes[x] < sizes[y] else (sets[y], sets[x])
        at = np.minimum(np.searchsorted(q, p), len(q) - 1)
        return int((q[at] == p).sum()) * (num + den) >= num * (len(p) + len(q))

    tree = RTree(np.stack([group_counts(s, groups) for s in sets]), sizes, num, den)
    connect(forest, np.arange(len(sets)), tree, links)
    return np.array([forest.find(i) for i in range(len(sets))])


def _row_key() -> Column:
    """Id and text of a row; null ids sort last. Rows with the same key are copies."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.unhex(F.left(F.sha2("text", 256), F.lit(32))).alias("text_hash"))


def jaccard_components(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id: documents link when den * |A & B| >= num * |A | B|."""
    found = _row_components(docs.select(_row_key().alias("doc_id"), "text"), words, num, den)
    return found.select("doc_id.id", "n_shingles", "set_id", F.col("component_id.id").alias("component_id")).withColumnRenamed("id", "doc_id")


def _row_components(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``jaccard_components`` of docs(doc_id, text), where doc_id is a row key and never null."""
    spark, hasher = docs.sparkSession, SpanHasher()
    rows = checkpointed(set_rows(docs, words, hasher))
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(fan_out(spark), int(total * 2.4 * (den - num) / num) // ENTRIES_PER_BUCKET + 1)
    reps = checkpointed(rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("counts").alias("counts")))
    rows = rows.drop("counts")
    ties = checkpointed(_ties(checkpointed(_lists(docs, words, num, den, buckets, hasher)), reps, num, den))
    reps = reps.drop("counts")

    bundles = components(ties)
    sized = bundles.join(reps.withColumnRenamed("set_id", "node"), "node")
    counts = sized.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    placed = checkpointed(sized.join(counts, "root").select("node", "root", "doc_id", "sets", "shingles", (F.col("sets") > BUNDLE_SETS).alias("large")))
    needed, large = placed.agg(F.coalesce(F.sum(F.col("shingles") / F.col("sets")), F.lit(0.0)), F.coalesce(F.max("large"), F.lit(False))).first()

    tasks = max(fan_out(spark), int(needed * 8) // BYTES_PER_TASK + 1)
    found = _sets(docs, placed, words, hasher)
    found = checkpointed(found) if large else found
    small = found.where("NOT large") if large else found
    roots = _joined(small.select(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task"), F.col("root").alias("bundle"), "node", F.col("node").alias("known"), "shingles"), num, den)
    if large:
        roots = roots.unionByName(_large(found.where("large"), ties, num, den))
    roots = checkpointed(roots)

    named = reps.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "doc_id", F.coalesce("component", "set_id").alias("component"))
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(ids, "component").select("set_id", "component_id")
    return rows.join(by_set, "set_id", "left").select("doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def _sets(docs: DataFrame, placed: DataFrame, words: int, hasher: SpanHasher) -> DataFrame:
    """The shingles of one document for each placed set."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = flat(batch.column("text"))
            for i, j, part, own in pieces(data, offsets):
                sets, bounds = shingle_sets(part, own, words, hasher)
                columns = [batch.column(c).slice(i, j - i) for c in ("node", "root", "large")]
                same = pa.array(set_ids(sets, bounds) == np.asarray(columns[0]))  # a repeated doc_id may have another text
                out = pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))], names=["node", "root", "large", "shingles"])
                yield out.filter(same)

    own = docs.join(placed.select("doc_id", "node", "root", "large"), "doc_id").select("node", "root", "large", "text")
    return own.mapInArrow(lean(batches), "node long, root long, large boolean, shingles array<long>")


def _joined(groups: DataFrame, num: int, den: int) -> DataFrame:
    """node, component of the sets in each (task, bundle)."""

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bundle, node, known = (table[c].to_numpy() for c in ("bundle", "node", "known"))
        lists = table["shingles"].chunk(0) if table.num_rows else None
        values, bounds = (np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)) if lists is not None else (None, None)
        nodes, roots = [], []
        order = np.lexsort((node, bundle))
        for own in np.split(order, np.flatnonzero(np.diff(bundle[order])) + 1) if len(order) else []:
            own = own[np.append(True, np.diff(node[own]) != 0)]
            label = links_in_bundle([values[bounds[i] : bounds[i + 1]] for i in own], num, den, known[own])
            nodes.append(node[own])
            roots.append(node[own][label])
        return pa.table({"node": pa.array(np.concatenate(nodes) if nodes else [], pa.int64()), "component": pa.array(np.concatenate(roots) if roots else [], pa.int64())})

    return groups.groupBy("task").applyInArrow(lean(join), "node long, component long")


def _large(found: DataFrame, ties: DataFrame, num: int, den: int) -> DataFrame:
    """node, component for bundles too large for a task."""
    left, right = found.select(F.col("node").alias("a"), F.col("shingles").alias("x")), found.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y")) * (num + den) >= num * (F.size("x") + F.size("y"))
    linked = checkpointed(ties.join(right, "b").join(left, "a").where(common).select("a", "b"))
    own = found.select("node", "root").join(components(linked).withColumnRenamed("root", "known"), "node", "left").select("node", "root", F.coalesce("known", "node").alias("known"))
    own = checkpointed(own)
    # In a bundle that is not one component yet, only pairs with a set outside its largest component are open:
    # blocks of such sets meet blocks of all sets.
    sized = own.groupBy("root", "known").agg(F.count("*").alias("n"))
    main = sized.groupBy("root").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("most < n")
    tiled = own.join(main, "root").select("node", "root", "known", (F.col("known") != F.col("main")).alias("rest"), F.ceil((F.col("n") - F.col("most")) / REST_SETS).alias("rows"), F.ceil(F.col("n") / TILE_SETS).alias("columns"))
    place = F.xxhash64("node")
    all_rows = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.pmod(place, F.col("columns")).alias("j")))
    all_columns = F.transform(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1), lambda j: F.struct(F.pmod(place, F.col("rows")).alias("i"), j.alias("j")))
    dealt = tiled.select("node", "root", "known", F.explode(F.when(F.col("rest"), F.array_union(all_rows, all_columns)).otherwise(all_rows)).alias("tile"))
    dealt = dealt.join(found.select("node", "shingles"), "node").select(F.xxhash64("root", "tile").alias("task"), F.col("root").alias("bundle"), "node", "known", "shingles")
    met = _joined(dealt, num, den).select(F.col("node").alias("a"), F.col("component").alias("b"))
    edges = met.unionByName(own.select(F.col("node").alias("a"), F.col("known").alias("b"))).distinct()
    return components(edges).select("node", F.col("root").alias("component"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (null last), then text hash; copies of an id and text are one row."""
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    keyed = docs.select(_row_key().alias("key"), "text", F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], F.lit(0).alias("none")).alias("others"))
    found = _row_components(keyed.select(F.col("key").alias("doc_id"), "text"), words, num, den)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    rows = keyed.join(kept, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"), F.min("others").alias("others"))
    return rows.select(*[F.col("key.id" if c == "doc_id" else "text" if c == "text" else f"others.c{names.index(c)}").alias(c) for c in docs.columns])


def op9_ngram_join(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, words=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN list_transform([1], lambda x: array_to_string(w, ' ')) ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END AS s
  FROM words WHERE len(w) > 0),
flat AS (SELECT DISTINCT doc_id, hash(unnest(s)) AS g FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM flat GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN edges e ON r.b = e.x) SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = d.doc_id
"""
