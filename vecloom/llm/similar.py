"""Near-duplicates by SimHash at a similarity, for prints that may differ in many bits.

Texts are sets of word shingles, similar if the Jaccard similarity of their sets is ``similarity`` or more. Long
prints are indexed segment by segment: a segment's leading bits name a bucket of its table, and within a bucket the
Hamming ball around the segment's other bits is enumerated and looked up. Pairs that are found so have their complete
distance verified, and what is within reach has its similarity computed from the shingles themselves. Segments, their
width and the ball's radius follow from the number of prints, so that a pair at the similarity is found with
probability ``recall`` or more at every size, closer pairs more surely, and neither buckets nor copies of a row grow
with the table. A recall of 1 compares all with all, which is exact and for small tables.

No link is lost among the pairs that are found, and no group makes all its pairs. Each bucket gives a minimum spanning
forest of its pairs by distance. A forest joins all that any pairs join, so every pair that it leaves is within a
component of the pairs that it gives (a cluster). Clusters that were left pairs and hold texts still apart are searched
exactly: the shingle sets of a cluster come together, in blocks against blocks, what can't be similar by its size or its
rarest shingles is passed over, the rest is counted, and only links that join something leave the task.
Buckets of more than a block are compared block against block, each such pair of blocks in a
group of its own, so that no task holds a bucket of unknown size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.durable import broadcast_if_small, materialize
from vecloom.llm.common import map_batches, typed, utf8
from vecloom.llm.components import connected_components
from vecloom.llm.simhash import MAX_BROADCAST_ROWS, shingle_hashes
from vecloom.shipping import ship

#: Bits of the complete distance, at least so many words of 64.
CHECK_WORDS = 4
#: Prints that a bucket has on average at most, and rows of a block: buckets beyond a block are split.
BUCKET, BLOCK = 1 << 16, 4096
#: Bits behind the leading ones, and radii of the ball in them, that a plan may choose.
REST, RADII = range(4, 13), (1, 2, 3)
#: What a plan weighs, in the time of one comparison: a row's copy in another segment's table, a lookup.
COPY, LOOKUP = 2000.0, 1.0
#: Segments of a plan at least: up to some 300,000 prints all tables have as many, so that work grows with the rows.
SEGMENTS = 8
#: Shingles of a block in the search of a cluster.
BLOCK_SHINGLES = 1 << 19
#: Pairs whose distances are in memory at a time.
PAIRS = 1 << 18
#: Rows after which the complete buckets among them are compared.
ROWS = 1 << 14


@dataclass(frozen=True)
class Plan:
    """An index: tables by segments of ``lead`` + ``rest`` bits, the ball of ``radius`` around the rest; pairs of up to ``most`` differing bits."""

    lead: int
    rest: int
    radius: int
    segments: int
    most: int

    @property
    def width(self) -> int:
        """Bits of a print for each segment."""
        return 16 if self.lead + self.rest <= 16 else 32

    @property
    def words(self) -> int:
        return max(CHECK_WORDS, math.ceil(self.segments * self.width / 64))


def flip_rate(similarity: float) -> float:
    """The share of bits that differ between texts of that Jaccard similarity and equal size: the angle of their sets."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def reach(similarity: float, bits: int) -> int:
    """The distance that pairs of the similarity exceed in about one of thirty thousand cases: four standard deviations."""
    p = flip_rate(similarity)
    return math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def ball_size(rest: int, radius: int) -> int:
    return sum(math.comb(rest, r) for r in range(radius + 1))


def plan(n: int, similarity: float, recall: float) -> Plan:
    """The index for n prints of least work: copies of rows against lookups and comparisons, buckets of at most BUCKET prints."""
    if recall >= 1:
        return Plan(0, 0, 0, 1, 64 * CHECK_WORDS)
    p = flip_rate(similarity)
    found = {}
    for lead in range(21):
        for rest in REST:
            for radius in RADII:
                hit = (1 - p) ** lead * sum(math.comb(rest, r) * p**r * (1 - p) ** (rest - r) for r in range(radius + 1))
                segments = max(SEGMENTS, math.ceil(math.log(1 - recall) / math.log(1 - hit)))
                ball = ball_size(rest, radius)
                cost = segments * (COPY + ball * (LOOKUP + n / 2.0 ** (lead + rest)))
                if n / 2.0**lead <= BUCKET or lead == 20:
                    found[cost, lead, rest, radius] = segments
    best = min(found)
    return Plan(*best[1:], found[best], reach(similarity, 64 * CHECK_WORDS))


def _widen(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` words of 64 bits from each hash: SplitMix64 from it on."""
    x = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    parts = list(shingle_hashes(data, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def long_print(hashes: np.ndarray, words: int) -> bytes:
    """A bit is 1 if set in over half of the hashes, each widened to ``words`` words. None: all bits are 0."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        rows = _widen(hashes[at : at + (1 << 14)], words)
        counts += np.unpackbits(rows.view(np.uint8).ravel(), bitorder="little").reshape(len(rows), -1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b, d) of a minimum spanning forest of n nodes; of equal edges the earlier."""
    label, out = np.arange(n), []
    order = np.argsort(d, kind="stable")
    while len(order):
        x, y = label[a[order]], label[b[order]]
        live = x != y
        order, x, y = order[live], x[live], y[live]
        if not len(order):
            break
        # edges stand in ascending order: the first of a node is its least
        first = np.full(n, len(order))
        place = np.arange(len(order))
        np.minimum.at(first, x, place)
        np.minimum.at(first, y, place)
        chosen = np.unique(first[first < len(order)])
        out.append(order[chosen])
        # hook the greater label to the smaller until all chosen edges are inside a tree
        x, y = x[chosen], y[chosen]
        up = np.arange(n)
        while True:
            rx, ry = up[x], up[y]
            apart = rx != ry
            if not apart.any():
                break
            np.minimum.at(up, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
            while (jumped := up[up] != up).any():
                up[jumped] = up[up[jumped]]
        label = up[label]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _balls(rest: int, radius: int) -> list[int]:
    """Masks of the Hamming ball of the radius in ``rest`` bits."""
    return [sum(1 << i for i in some) for r in range(radius + 1) for some in combinations(range(rest), r)]


def near_pairs(bucket: np.ndarray, low: np.ndarray, prints: np.ndarray, index: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance), i < j, of rows of equal bucket and near low bits that are within reach, each pair once, some at a time."""
    rest = index.rest
    _, place = np.unique(bucket, return_inverse=True)
    slot = (place.astype(np.int64) << rest) | low
    order = np.argsort(slot, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=(int(place.max()) + 1) << rest))]).astype(np.int32)
    for mask in _balls(rest, index.radius):
        low_end, high_end = start[slot ^ mask], start[(slot ^ mask) + 1]
        size = high_end - low_end
        rows = np.flatnonzero(size)
        ends = np.cumsum(size[rows])
        at = 0
        while at < len(rows):  # slices of about PAIRS pairs; a row has at most two blocks of partners
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            some, width = rows[at:to], size[rows[at:to]]
            i = np.repeat(some, width)
            j = order[np.repeat(low_end[some] - (np.cumsum(width) - width), width) + np.arange(width.sum())]
            once = i < j
            i, j = i[once], j[once]
            first = np.bitwise_count(prints[i, 0] ^ prints[j, 0]).astype(np.int64)
            keep = first <= index.most
            i, j = i[keep], j[keep]
            d = first[keep] + np.bitwise_count(prints[i, 1:] ^ prints[j, 1:]).sum(axis=1, dtype=np.int64)
            keep = d <= index.most
            yield i[keep], j[keep], d[keep]
            at = to


def spanning_pairs(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (i, j) of a minimum spanning forest of all pairs of n rows, and rows with pairs that are not in it."""
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    left = np.zeros(n, bool)

    def pruned(both: list[np.ndarray]) -> tuple:
        out = np.ones(len(both[0]), bool)
        out[forest(n, *both)] = False
        left[both[0][out]] = True
        return tuple(x[~out] for x in both)

    for some in pairs:
        found = [np.concatenate([x, y]) for x, y in zip(found, some)]
        if len(found[0]) > 2 * n:
            found = pruned(found)
    found = pruned(list(found))
    return found[0], found[1], left


def tops(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that a forest's edges (i, j) join it to."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[i], up[j])
        if (low == up[i]).all() and (low == up[j]).all():
            return up
        np.minimum.at(up, i, low)
        np.minimum.at(up, j, low)
        up = up[up]


def overlapping(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, j, whether similar) for each set i and the earlier sets j that share one of the rarest elements of both and may be similar by size.

    Sets of the similarity share so many elements that those beyond ``size * (1 - similarity)`` of the rarest can't be all.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    whole, ids, shown = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    parts = [ids[e - n : e] for e, n in zip(ends, sizes)]
    held: dict[int, list[int]] = {}
    mark = np.zeros(len(whole), bool)
    for i, part in enumerate(parts):
        n = len(part)
        rare = part[np.lexsort((part, shown[part]))][: n - math.ceil(similarity * n - 1e-9) + 1]
        rare = rare[shown[rare] > 1].tolist()
        met = np.unique(np.fromiter((j for r in rare for j in held.get(r, ())), np.int64))
        met = met[np.minimum(sizes[met], n) >= similarity * np.maximum(sizes[met], n) - 1e-9]
        for r in rare:
            held.setdefault(r, []).append(i)
        for at in range(0, len(met), 1024):
            some = met[at : at + 1024]
            mark[part] = True
            flat = np.concatenate([parts[j] for j in some])
            common = np.add.reduceat(mark[flat].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            mark[part] = False
            yield i, some, common >= similarity * (n + sizes[some] - common)


def joining(node: np.ndarray, label: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of nodes, similar, that join all labels which similar sets join: fewer than there are labels."""
    _, at = np.unique(label, return_inverse=True)
    up = list(range(int(at.max()) + 1))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    there = np.flatnonzero([len(x) for x in sets])  # texts without words are one node
    for i, met, similar in overlapping([sets[k] for k in there], similarity) if len(there) > 1 else ():
        for j in met[similar].tolist():
            x, y = top(at[there[i]]), top(at[there[j]])
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((int(node[there[i]]), int(node[there[j]])))
    return out


def index_rows(prints: DataFrame, n: int, index: Plan) -> DataFrame:
    """(bucket, node, low, check0, ...): every print once in each segment's table, once for each pair of blocks where its bucket is large."""
    spark = prints.sparkSession
    lead, rest, width, segments = index.lead, index.rest, index.width, index.segments
    checks = [f"check{i}" for i in range(CHECK_WORDS)]
    ship(spark)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                raw = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                parts = raw.view(f"<u{width // 8}")[:, :segments].astype(np.int64) & ((1 << lead + rest) - 1)
                bucket, low = (np.arange(segments) << lead) | (parts >> rest), parts & ((1 << rest) - 1)
                node = batch.column("node").to_numpy(zero_copy_only=False)
                check = raw.view(np.int64)[:, :CHECK_WORDS]
                columns = [bucket.ravel(), np.repeat(node, segments), low.ravel().astype(np.int32), *np.repeat(check, segments, axis=0).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["bucket", "node", "low", *checks])

    rows = prints.select("node", "print").mapInArrow(dealt, "bucket long, node long, low int, " + ", ".join(f"{c} long" for c in checks))
    # buckets of over a block: their rows are dealt to blocks, and every pair of blocks is a bucket of its own, below 0
    large = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK), "large-buckets")
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    grouped = rows.join(broadcast_if_small(large, MAX_BROADCAST_ROWS), "bucket", "left").withColumn("blocks", blocks)
    grouped = grouped.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).bitwiseOR(F.lit(-(1 << 63)))
    return grouped.select(F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(pair).alias("bucket"), "node", "low", *checks)


def compared(rows: DataFrame, parts: int, index: Plan) -> DataFrame:
    """(a, b): pairs of nodes, a < b, of spanning forests; with b null, a node of each tree whose rows have more pairs."""
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket")

    def pairs(held: list[np.ndarray]) -> pa.RecordBatch:
        bucket, node, low, *checks = held
        i, j, left = spanning_pairs(len(node), near_pairs(bucket, low.astype(np.int64), np.stack(checks, axis=1).view(np.uint64), index))
        more = np.unique(node[tops(len(node), i, j)[left]])
        a = np.concatenate([np.minimum(node[i], node[j]), more])
        b = pa.concat_arrays([pa.array(np.maximum(node[i], node[j])), pa.nulls(len(more), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(a), b], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            # all but the last bucket, which may go on in the next batch
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) >= ROWS else 0
            if cut:
                yield pairs([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield pairs(held)

    return rows.mapInArrow(run, "a long, b long")


def linked(classes: DataFrame, n: int, index: Plan, rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(node, root): components of the links among n nodes (node, print, doc_id, text_key); nodes without links have no row."""
    table = index_rows(classes, n, index)
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * index.segments / 4_000_000))
    found = materialize(compared(table, parts, index), "candidates")
    pairs = materialize(found.filter("b IS NOT NULL").distinct(), "pairs")
    sets = shingle_sets(rows, classes, pairs, shingle)
    members = connected_components(verified(pairs, sets, similarity))
    more = found.filter("b IS NULL").select(F.col("a").alias("node")).distinct().withColumn("more", F.lit(True))
    return _joined(members, cluster_links(pairs, members, more, sets, similarity))


def cluster_links(pairs: DataFrame, members: DataFrame, more: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join members of a cluster that are still apart, of clusters with a node of ``more``.

    Clusters are components of ``pairs``. Blocks are of about BLOCK_SHINGLES shingles; a cluster of many is every pair of its blocks.
    """
    clusters = connected_components(pairs.select("a", "b")).withColumnRenamed("root", "cluster")
    known = clusters.join(members.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = known.join(more, "node", "left").join(sets.select("node", F.size("hashes").alias("size")), "node")
    known = materialize(known, "clustered")
    opened = known.groupBy("cluster").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.bool_or("more").alias("more"), F.sum("size").alias("shingles"))
    opened = materialize(opened.filter("more AND x <> y").select("cluster", F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks")), "open-clusters")
    rows = known.select("node", "cluster", "label").join(broadcast_if_small(opened, MAX_BROADCAST_ROWS), "cluster").join(sets, "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "label", "hashes")
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, labels, held = None, [], [], []

        def links() -> pa.RecordBatch:
            found = joining(np.array(nodes), np.array(labels), held, similarity)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "low", "high")))
            for at, (now, node, label) in enumerate(zip(keys, batch.column("node").to_pylist(), batch.column("label").to_pylist())):
                if now != key:
                    if len(nodes) > 1:
                        yield links()
                    key, nodes, labels, held = now, [], [], []
                nodes.append(node)
                labels.append(label)
                held.append(batch.column("hashes")[at].values.to_numpy(zero_copy_only=False).view(np.uint64))
        if len(nodes) > 1:
            yield links()

    dealt = rows.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    return materialize(dealt.mapInArrow(run, "a long, b long"), "cluster-links")


def _joined(members: DataFrame, links: DataFrame) -> DataFrame:
    """Components with more links."""
    if links.isEmpty():
        return members
    return connected_components(members.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(links))


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """doc_id, text_key, component_id, group_key: documents that links of the similarity join have one group_key.

    component_id is the smallest doc_id of the group (null only if it has no other). Texts of equal words are one
    class, from which one node goes into the index; null texts and texts without words are such a class. Repeated
    rows give repeated results; an empty table gives an empty one. Columns besides id and text are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    words = plan(rows.count(), similarity, recall).words

    def made(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(x, shingle) for x in utf8(batch, "text")]
        nodes = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "big", signed=True) for x in sets]
        return {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "node": nodes, "print": [long_print(x, words) for x in sets]}

    prints = materialize(map_batches(rows, made, f"{typed(rows, 'doc_id')}, text_key long, node long, print binary"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key"))
    classes = prints.groupBy("node").agg(F.any_value("print").alias("print"), first.alias("first"))
    classes = materialize(classes.select("node", "print", "first.doc_id", "first.text_key"), "classes")
    n = classes.count()
    index = plan(n, similarity, recall)
    members = linked(classes, n, index, rows, similarity, shingle)
    grouped = materialize(classes.join(members, "node", "left").select("node", F.coalesce("root", "node").alias("group_key"), "doc_id"), "similar-classes")
    heads = grouped.groupBy("group_key").agg(F.min("doc_id").alias("component_id"))
    grouped = materialize(grouped.select("node", "group_key").join(heads, "group_key"), "similar-groups")
    return prints.select("doc_id", "text_key", "node").join(grouped, "node").select("doc_id", "text_key", "component_id", "group_key")


def shingle_sets(rows: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the nodes in pairs, made from one text of each class."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialize(classes.join(wanted, "node").select("node", "doc_id", "text_key"), "wanted")
    same = F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.text_key") == F.col("w.text_key"))
    found = rows.alias("r").join(broadcast_if_small(texts, MAX_BROADCAST_ROWS).alias("w"), same).select("w.node", "r.text")

    def made(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column("node"), "hashes": [shingle_set(x, shingle).view(np.int64) for x in utf8(batch, "text")]}

    return materialize(map_batches(found, made, "node long, hashes array<long>").dropDuplicates(["node"]), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialize(both.filter(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"), "similar-links")
