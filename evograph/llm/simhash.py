"""Near-duplicate detection by SimHash and vantage-point trees.

Fingerprints of 64 bits link at 3 or fewer differing bits.  Of two linked fingerprints, one half of 32
bits differs in at most one bit, so each half is searched by itself with radius 1 and links are
verified on the whole fingerprint.  For each half, a vantage-point tree over a bounded sample of
fingerprints routes every fingerprint: at a node with vantage v and radius m it goes inside if its
distance d from v is at most m, else outside.  By the triangle inequality, halves at distance 1 or less part
only if one has d = m and the other d = m + 1; those with d = m + 1 therefore also
query the inner branch.  So shards that overlap a boundary see both sides, and no link is lost.
Inside a shard, links become a spanning forest, never all pairs, and forests are joined by
alternating large-star and small-star steps.

Texts of a given shingle similarity differ in far more than 3 bits.  To group those, the pipeline takes SimHash fingerprints of 512 bits over
shingle sets and as many vantage-point trees as there are slices of them; sets that meet in a shard and differ in few bits are checked for a
Jaccard similarity of 0.8.  No sketch tells such sets exactly, so a prefix filter finds the pairs that the trees leave, checked likewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fingerprints from which the trees are built; all others are only routed by them.
SAMPLE = 16_384
#: Fingerprints wanted in a shard before boundary queries are added.
SHARD = 1_024
RADIUS = 3
SEED = 42

#: Wide fingerprints: words of 64 bits, trees and the bits that each reads, and rows of a shard.
WORDS, TREES, SLICE = 8, 10, 16
WIDE_SHARD = 4_096
SIMILARITY = 0.8
#: Bits granted beyond the mean at ``SIMILARITY``, one standard deviation.
SLACK = 8
#: Bits in which the first words of linked fingerprints may differ, over three standard deviations above the mean.
FIRST_WORD = 20
#: Texts by which shingles are ordered for the prefix filter.
ORDER_SAMPLE = 4_000
#: Shingles that the order may set last; more would change the work and no result.
RANKED = 200_000

_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(WORDS)], np.uint64)[None, :]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed SimHash of the text's word shingles, repeats included; 0 for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    of = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [of(b" ".join(words), SEED)]
    elif shingle == 3:
        hashes = [of(b"%b %b %b" % three, SEED) for three in zip(words, words[1:], words[2:], strict=False)]
    else:
        hashes = [of(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
    count, total = np.zeros(64, np.int64), len(hashes)
    for at in range(0, total, 65_536):
        part = np.array(hashes[at : at + 65_536], "<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (count * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""

    def make():
        return lambda x: {"doc_id": x["i"], "fp": [fingerprint(t, shingle) for t in x["t"]]}

    return common.arrow_pass(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, "doc_id long, fp long")


class Tree:
    """A vantage-point tree over 32-bit values with leaves numbered from 0."""

    def __init__(self, values: np.ndarray, depth: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, radius, inner, outer; a leaf is ~number
        self.leaves = 0
        self.root = self._grow(np.unique(values.astype(np.uint32)), depth)

    def _grow(self, values: np.ndarray, depth: int) -> int:
        if depth and len(values) > 1:
            best = None
            for v in values[:: max(1, len(values) // 8)][:8]:
                d = np.bitwise_count(values ^ v).astype(np.int64)
                for m in {int(np.median(d)), int(np.median(d)) - 1}:
                    inside = int((d <= m).sum())
                    worth = min(inside, len(values) - inside) / len(values) - (d == m + 1).mean() / 2
                    if 0 < inside < len(values) and (best is None or worth > best[0]):
                        best = worth, int(v), m, d
            if best:
                at = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                _, v, m, d = best
                self.nodes[at] = (v, m, self._grow(values[d <= m], depth - 1), self._grow(values[d > m], depth - 1))
                return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs: each value's own leaf, and every leaf across a boundary that it must query."""
        rows, leaves, todo = [], [], [(self.root, np.arange(len(values)))]
        while todo:
            at, who = todo.pop()
            if not len(who):
                continue
            if at < 0:
                rows.append(who)
                leaves.append(np.full(len(who), ~at))
                continue
            v, m, inner, outer = self.nodes[at]
            d = np.bitwise_count(values[who] ^ np.uint32(v)).astype(np.int64)
            todo += [(inner, who[d <= m + 1]), (outer, who[d > m])]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def forest(fp: np.ndarray, radius: int = RADIUS, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a, b) of a spanning forest of the graph that links values at ``radius`` or fewer differing bits."""
    n = len(fp)
    linked = np.zeros(n, bool)
    for at in range(0, n, block):
        near = np.bitwise_count(fp[at : at + block, None] ^ fp[None, :]) <= radius
        linked[at : at + block] = near.sum(1) > 1
    left, edges_a, edges_b = np.flatnonzero(linked), [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            hit = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            if hit.any():
                new = left[hit]
                edges_a.append(np.full(len(new), x))
                edges_b.append(new)
                stack.extend(new.tolist())
                left = left[~hit]
    return (np.concatenate(edges_a), np.concatenate(edges_b)) if edges_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) with u < v: links of distinct fingerprints (fp) that keep the connected components of all links."""
    n = nodes.count()
    sample = np.array([r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / SHARD))))
    depth = min(depth, int(np.log2(max(len(sample), 2))) - 1)
    trees = [Tree((sample >> np.uint64(32 * k)).astype(np.uint32), depth) for k in (0, 1)]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for k, tree in enumerate(trees):
                rows, leaves = tree.route((fp.view(np.uint64) >> np.uint64(32 * k)).astype(np.uint32))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(leaves * 2 + k, pa.int32()), "fp": pa.array(fp[rows])})

    def in_shard(table: pa.Table) -> pa.Table:
        fp = np.unique(table.column("fp").to_numpy())
        a, b = forest(fp.view(np.uint64), radius)
        return pa.table({"u": pa.array(np.minimum(fp[a], fp[b]), pa.int64()), "v": pa.array(np.maximum(fp[a], fp[b]), pa.int64())})

    shards = nodes.mapInArrow(routed, "shard int, fp long")
    return shards.groupBy("shard").applyInArrow(in_shard, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Large-star and small-star steps alternate until nothing changes.  Minima are aggregates, so no neighbourhood is gathered.
    """
    edges = common.materialize(edges.where("u <> v").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        moved = both.join(least, "u")
        if large:
            return moved.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).where("u <> v").distinct()
        pairs = moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct(F.col("u").alias("u"), F.col("_m").alias("v")))).alias("_e"))
        return pairs.select("_e.*").where("u <> v").distinct()

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = None
    while True:
        edges = common.materialize(star(star(edges, True), False), "stars")
        now = digest(edges)
        if now == seen or not now[0]:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the component of every row under links of near fingerprints.

    ``component_id`` is the smallest ``doc_id`` that can be reached, itself included; rows with a null id belong
    to their component but name none (it is null where all its ids are).  Rows without words have fingerprint 0, repeated rows
    stay, and an empty table gives no rows.  ``doc_id`` must be an integer; other columns are not looked at.
    """
    prints = common.materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    classes = nodes.join(found, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    # Written, so that plain exchanges meet in the joins and the partition of a hot component or fingerprint can be split.
    classes = common.materialize(classes, "classes")
    smallest = common.materialize(classes.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest")
    named = common.materialize(classes.join(smallest, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of 512 bits of a shingle set; zeros for an empty one."""
    count = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 4_096):
        # One hash a shingle, turned into eight by odd multipliers and shifts.
        x = hashes[at : at + 4_096, None] * _ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # so many ones fit in a byte
            count += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits((count * 2 > len(hashes)).astype(np.uint8), bitorder="little").tobytes()


def node_of(fp: bytes) -> int:
    """A signed 64-bit name of a wide fingerprint."""
    return int(np.uint64(xxhash.xxh64_intdigest(fp, SEED)).astype(np.int64))


def most_differing(similarity: float) -> int:
    """Bits of a wide fingerprint in which two texts of equal length and this Jaccard similarity differ on average.

    Shingle sets of Jaccard similarity J have cosine 2 J / (1 + J), and a bit differs with odds of their angle over pi.
    """
    return int(np.ceil(64 * WORDS * np.arccos(2 * similarity / (1 + similarity)) / np.pi)) + SLACK


def wide_forest(fp: np.ndarray, radius: int, whole: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a, b) of a spanning forest of the graph that links rows of ``fp`` at ``radius`` or fewer differing bits.

    Memory is linear in the rows.  In the search a row that is linked leaves the rows to compare with, so a large group costs
    one comparison a member with what is not in it; below ``whole`` rows, those without any link are set aside first.
    """
    n = len(fp)

    def hits(x: int, among: np.ndarray) -> np.ndarray:
        near = among[np.bitwise_count(fp[among, 0] ^ fp[x, 0]) <= FIRST_WORD]
        return near[np.bitwise_count(fp[near] ^ fp[x]).sum(1, dtype=np.int64) <= radius]

    if n <= whole:
        linked, first = np.zeros(n, bool), np.ascontiguousarray(fp[:, 0])
        for at in range(0, n, 16):
            i, j = np.nonzero(np.bitwise_count(first[at : at + 16, None] ^ first[None, at:]) <= FIRST_WORD)
            i, j = i[i < j] + at, j[i < j] + at
            near = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64) <= radius
            linked[i[near]] = linked[j[near]] = True
        left = np.flatnonzero(linked)
    else:
        left = np.arange(n)
    edges_a, edges_b = [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            new = hits(x, left)
            if len(new):
                edges_a.append(np.full(len(new), x))
                edges_b.append(new)
                stack.extend(new.tolist())
                left = np.setdiff1d(left, new, assume_unique=True)
    return (np.concatenate(edges_a), np.concatenate(edges_b)) if edges_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def wide_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links, by node, of the rows of ``nodes`` (fp binary, all distinct) that keep the components of all links found.

    ``TREES`` vantage-point trees stand over as many slices of ``SLICE`` bits.  Two texts that agree to one bit
    in any slice meet in a shard, and shards compare whole fingerprints, so texts that meet by nearness elsewhere link too.
    """
    n, radius = nodes.count(), most_differing(similarity)
    sample = [r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    depth = min(max(0, int(np.ceil(np.log2(max(n, 1) / WIDE_SHARD)))), int(np.log2(max(len(sample), 2))) - 1)
    trees = [Tree(x, depth) for x in _slices(sample)]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                for k, (tree, x) in enumerate(zip(trees, _slices(part.column("fp").to_pylist()), strict=True)):
                    rows, leaves = tree.route(x)
                    yield pa.RecordBatch.from_arrays([pa.array(leaves * TREES + k, pa.int32()), part.column("fp").take(pa.array(rows))], ["shard", "fp"])

    def in_shard(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_pylist()
        a, b = (np.array([node_of(fps[k]) for k in side], np.int64) for side in wide_forest(np.frombuffer(b"".join(fps), "<u8").reshape(-1, WORDS), radius))
        return pa.table({"u": pa.array(np.minimum(a, b), pa.int64()), "v": pa.array(np.maximum(a, b), pa.int64())})

    return nodes.select("fp").mapInArrow(routed, "shard int, fp binary").groupBy("shard").applyInArrow(in_shard, "u long, v long").distinct()


def _slices(fps: list[bytes]) -> list[np.ndarray]:
    """The first ``SLICE`` of every 32 bits of each fingerprint, one array a tree."""
    words = np.frombuffer(b"".join(fps), "<u4").reshape(-1, 2 * WORDS)
    return [np.ascontiguousarray(words[:, k] & np.uint32((1 << SLICE) - 1)) for k in range(TREES)]


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, and one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    of, spaced = xxhash.xxh64_intdigest, b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    hashes = {of(spaced[a : b - 1], SEED) for a, b in zip([0, *ends], ends[min(shingle, len(ends)) - 1 :], strict=False)} if words else ()
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)))


def set_name(of: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(of.tobytes(), SEED)).astype(np.int64))


def _frequent(nodes: DataFrame, shingle: int) -> np.ndarray:
    """At most ``RANKED`` shingles of several texts of a bounded sample, the more frequent the later.  They only order a set's shingles.

    The sampled texts are read whole, where they lie; the driver receives hashes and no text.
    """
    chosen = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(ORDER_SAMPLE)

    def make():
        return lambda x: {"token": np.concatenate([shingle_set(t, shingle) for t in x["text"]]).view(np.int64)}

    texts = nodes.join(F.broadcast(chosen), "node", "left_semi").select("text")
    times = common.arrow_pass(texts, make, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    often = times.orderBy(F.desc("_c"), "token").limit(RANKED).select("token").collect()
    return np.array([r[0] for r in reversed(often)], np.int64).view(np.uint64)


def sketched_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): pairs of ``nodes`` (node, fp; one row a shingle set) whose wide fingerprints :func:`wide_links` connects, and each node with the least of equal fingerprint."""

    def make():
        return lambda x: {"node": x["node"], "print": list(map(node_of, x["fp"])), "fp": x["fp"]}

    named = common.materialize(common.arrow_pass(nodes.select("node", "fp"), make, "node long, print long, fp binary"), "fingerprints")
    prints = common.materialize(named.groupBy("print").agg(F.min("node").alias("lead"), F.first("fp").alias("fp")), "prints")
    near = common.materialize(wide_links(prints, similarity), "near_prints")
    ends = [prints.select(F.col("print").alias(c), F.col("lead").alias(f"lead_{c}")) for c in "uv"]
    apart = near.join(ends[0], "u").join(ends[1], "v").select(F.col("lead_u").alias("u"), F.col("lead_v").alias("v"))
    equal = named.select("node", "print").join(prints.select("print", "lead"), "print").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    pairs = common.materialize(apart.unionByName(equal), "sketched")
    common.release(named, prints, near)
    return pairs


def similar_links(nodes: DataFrame, similarity: float, shingle: int, rank: np.ndarray) -> DataFrame:
    """(u, v): pairs of ``nodes`` (node, fp, text; one row a shingle set) of exact Jaccard ``similarity`` or more that keep the components of all such pairs.

    Trees over fingerprints link sets first.  The rest is found exactly: in any common order of shingles, two similar sets share one among
    the first n - ceil(similarity n) + 1 of each; rare ones come first.
    """
    spark = nodes.sparkSession
    order = np.argsort(rank)
    ranked = spark.sparkContext.broadcast((rank[order], order))

    def prefixes():
        known, place = ranked.value

        def step(x):
            out: dict[str, list] = {"token": [], "node": [], "n": [], "p": []}
            for node, text in zip(x["node"], x["text"], strict=True):
                hashes = shingle_set(text, shingle)
                n = len(hashes)
                if n:
                    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                    late = np.where(known[at] == hashes, place[at], -1) if len(known) else np.full(n, -1)
                    first = hashes[np.lexsort((hashes, late))][: n - int(np.ceil(similarity * n - 1e-9)) + 1]
                    out["token"].append(first.view(np.int64))
                    out["node"].append(np.full(len(first), node))
                    out["n"].append(np.full(len(first), n))
                    out["p"].append(np.arange(len(first)))
            return {k: np.concatenate(v) if v else [] for k, v in out.items()}

        return step

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose sets are as similar as wanted."""

        def step(x):
            out: dict[str, list] = {"u": [], "v": []}
            for u, v, a, b in zip(x["u"], x["v"], x["a"], x["b"], strict=True):
                a, b = shingle_set(a, shingle), shingle_set(b, shingle)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                    out["u"].append(u)
                    out["v"].append(v)
            return out

        texts = pairs.join(nodes.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(nodes.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        return common.materialize(common.arrow_pass(texts, lambda: step, "u long, v long", 64), "verified")

    def sized(nx, ny):
        return F.least(nx, ny) >= similarity * F.greatest(nx, ny) - 1e-9

    def enough(common_tokens, nx, ny):
        """Whether sets of ``nx`` and ``ny`` shingles that share so many of their first ones can be similar.

        The set whose first shingles end earlier has all other shared ones among its last ceil(similarity n) - 1.
        """
        rest = F.ceil(similarity * F.greatest(nx, ny) - 1e-9) - 1
        return sized(nx, ny) & (common_tokens + rest >= similarity / (1 + similarity) * (nx + ny) - 1e-9)

    sketched = sketched_links(nodes, similarity)
    schema = "token long, node long, n int, p int"
    every = common.materialize(common.arrow_pass(nodes.select("node", "text"), prefixes, schema), "prefixes")
    shared = common.materialize(every.groupBy("token").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("node", "n")).alias("_m")).where("_c > 1").select("token", F.col("_m.node").alias("rep"), F.col("_m.n").alias("rep_n")), "shared")
    held = common.materialize(every.join(shared, "token"), "shared_prefixes")
    common.release(every, shared)
    # With the trees' links every set is compared with the one that leads most of its shingles: a large group becomes one component by one comparison a member.
    votes = held.where("node <> rep").groupBy("node", "n", "rep", "rep_n").agg(F.count(F.lit(1)).alias("_c")).where(enough(F.col("_c"), F.col("n"), F.col("rep_n")))
    votes = common.materialize(votes.groupBy("node").agg(F.max(F.struct("_c", "rep")).alias("_m")).select(F.col("node").alias("u"), F.col("_m.rep").alias("v")), "votes")
    tried = votes.unionByName(sketched).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    tried = common.materialize(tried, "tried")
    common.release(votes, sketched)
    first = verified(tried)
    common.release(tried)
    found = components(first)
    # Then all pairs that share shingles, are not in one component yet and can be similar by size, place and number of shared shingles.
    placed = held.select("token", "node", "n", "p").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = common.materialize(placed, "placed")
    common.release(held)
    several = placed.groupBy("token").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("token")
    mixed = common.materialize(placed.join(several, "token"), "mixed")
    common.release(placed)
    a, b = (mixed.select("token", *(F.col(c).alias(c + side) for c in ("node", "n", "p", "component"))) for side in "xy")
    # Every shared shingle of a pair lies in two components, so all are counted here.
    alike = (F.col("nodex") < F.col("nodey")) & (F.col("componentx") != F.col("componenty")) & sized(F.col("nx"), F.col("ny"))
    pairs = a.join(b, "token").where(alike).groupBy("nodex", "nodey", "nx", "ny").agg(F.count(F.lit(1)).alias("_c"), F.min("px").alias("px"), F.min("py").alias("py"))
    most = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    near = enough(F.col("_c"), F.col("nx"), F.col("ny")) & (most >= similarity / (1 + similarity) * (F.col("nx") + F.col("ny")) - 1e-9)
    pairs = common.materialize(pairs.where(near).select(F.col("nodex").alias("u"), F.col("nodey").alias("v")), "pairs")
    common.release(mixed)
    rest = verified(pairs)
    common.release(pairs)
    return first.unionByName(rest).distinct()


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): groups of texts linked by a Jaccard similarity of ``similarity`` or more of their word shingles.

    Fingerprints and trees link first, a prefix filter finds every other such pair, and every link is computed on the sets.  ``component_id`` is the group's smallest ``doc_id``
    (null ids name no group).  Texts without words are equal to each other, repeated rows stay, other columns are
    not looked at and an empty table gives no rows.  Equal sets are one node; shingles and sets are told apart by 64-bit hashes.
    """

    def make():
        def step(x):
            sets = [shingle_set(t, shingle) for t in x["t"]]
            return {"doc_id": x["i"], "node": list(map(set_name, sets)), "fp": list(map(wide_fingerprint, sets)), "text": x["t"]}

        return step

    named = common.arrow_pass(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, "doc_id long, node long, fp binary, text string")
    named = common.materialize(named, "shingle_sets")
    nodes = common.materialize(named.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("text").alias("text")), "set_nodes")
    # One copy of the texts is held at a time, and what is not read again goes at once.
    ids = common.materialize(named.select("doc_id", "node"), "set_ids")
    common.release(named)
    found = components(similar_links(nodes.select("node", "fp", "text"), similarity, shingle, _frequent(nodes, shingle)))
    classes = nodes.select("node", "first_id").join(found, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    classes = common.materialize(classes, "classes")
    common.release(nodes)
    smallest = common.materialize(classes.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest")
    back = common.materialize(classes.join(smallest, "component").select("node", "component_id"), "named")
    return ids.join(back, "node").select("doc_id", "component_id")


def one_per_group(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = 5) -> DataFrame:
    """Keep of each group of similar documents the one with the smallest id; columns of ``docs``.  Rows with a null id stay: no id marks them as second."""
    found = similar_documents(docs, similarity, shingle).where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprint and component of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
