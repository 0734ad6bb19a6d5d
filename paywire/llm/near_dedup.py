"""Near-duplicate classes by SetSketch registers, bands and exact checks.

Each document's set of word shingles gets a SetSketch: register i holds
floor(1 - log_b x_i), cut to [0, q + 1], where x_i is the least point that any
element's Poisson process puts there, so sketches of unions merge by maximum.
Documents with equal sets become one node.  Nodes that agree in all registers of
a band are possible partners; a band of 6 at similarity 0.85 is missed by all 42
bands once in 10^8 pairs.  A node first takes the name of the smallest node that shares
one of its first `FIRST` bands; names, not nodes, are then joined by all bands.  Most of
a large group of near copies agree in one of any few bands, so it comes down to a handful
of names, and the edges between names don't grow with it.

The possible partners form loose clusters, and each cluster is solved exactly: a
pivot is compared with every node that it isn't joined to yet, first by the joint
likelihood estimate from both sketches (6 standard deviations of slack), then on
the full sets.  So no pair is left out, and only a spanning forest of confirmed links
is emitted.  A cluster over `block` nodes or `block_shingles` shingles is split into
blocks of nodes of like set size, which bounds a task's memory; sets link only if
their sizes are within 100 : percent, so only blocks within `REACH` levels of each
other can hold a link.  A first pass solves each block together with `PIVOTS` nodes
of each level near it, which joins most of a large group of copies into one class at
a cost in proportion to its size; a second pass compares the blocks of the nodes
outside their cluster's main class with all blocks in reach, and so leaves no pair
out.  A cluster of many classes of like sizes costs the square of its blocks there.

Defined results: NULL texts and texts without words have no shingles and stand
alone; a text of fewer words than a shingle is one shingle; the class id is the
smallest id in the id's own order (NULL ids last); of rows with the same id, one
stays; an empty table gives an empty result; other columns pass through, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from paywire.llm.blocks import blocks_of, places, rows_but, with_messages
from paywire.llm.common import LOWER_TABLE, arrow_batches, free_memory, saved, scratch
from paywire.llm.graph import connected_components

M = 252  # registers
MISS = 1e-8  # share of the pairs at the threshold that all bands may miss
FIRST = 7  # bands that give a node its first name
TEXTS = 1_000  # in an Arrow batch
LEVELS, REACH = 4, 5  # levels of set size from percent to 100, and how far apart two levels with a link may be (one to spare)
PIVOTS, NEAR = 4, 2  # nodes of each level of a large cluster that each block up to so many levels away is compared with
BASE, RATE, TOP = 1.001, 20.0, 65_534  # b, a and q of the sketch
_GOLDEN, _MIX1, _MIX2, _FOLD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))  # odd constants of the published splitmix64 and a multiplier


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _MIX1
    z = (z ^ (z >> np.uint64(27))) * _MIX2
    return z ^ (z >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _WordHash()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    found = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        found = _mix(found * _FOLD + each[k : len(words) - width + 1 + k])
    return np.unique(found)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set as rows of uint16; an empty set has zeros.

    Element e's points are x_j = x_(j-1) + Exp(rate a * m), each in a register
    drawn at random; points past the document's largest minimum change nothing.
    """
    n = len(sets)
    least = np.full(n * M, np.inf)
    h = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    x, j = np.zeros(len(h)), 0
    while len(h):
        k = min(256, max(1, 65_536 // len(h)))
        z = _mix(h[:, None] + np.arange(j + 1, j + k + 1, dtype=np.uint64) * _GOLDEN)
        step = -np.log(((z >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / (RATE * M)
        points = np.cumsum(np.concatenate([x[:, None], step], 1), 1)[:, 1:]
        register = ((z & np.uint64(0xFFFFFF)) * np.uint64(M) >> np.uint64(24)).astype(np.int64)
        limit = least.reshape(n, M).max(1)
        near = points < limit[doc][:, None]
        np.minimum.at(least, (doc[:, None] * M + register)[near], points[near])
        x, j = points[:, -1], j + k
        live = x < least.reshape(n, M).max(1)[doc]
        h, doc, x = h[live], doc[live], x[live]
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(np.where(np.isinf(least), 0, value), 0, TOP + 1).astype(np.uint16).reshape(n, M)


def band_width(percent: int) -> int:
    """Registers in a band: the most that miss few enough of the pairs at the threshold."""
    return max((w for w in range(1, 17) if (1 - (percent / 100) ** w) ** (M // w) <= MISS), default=1)


def bands(registers: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit key a band."""
    n = M // width
    r = registers[:, : n * width].reshape(len(registers), n, width).astype(np.uint64)
    key = np.broadcast_to(np.arange(n, dtype=np.uint64), r.shape[:2]).copy()
    for k in range(width):
        key = _mix(key * _FOLD + r[:, :, k])
    return key


def joint_estimate(a: np.ndarray, size_a: int, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sketch a with the rows of b, from how many registers are over, under and equal."""
    over, under = (a > b).sum(1), (a < b).sum(1)
    same = M - over - under
    u = size_a / (size_a + size_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        log = lambda q: np.log(np.maximum(q, 1e-12))
        return over * log(more) + under * log(less) + same * log(1 - more - less)

    lo, hi = np.zeros(len(b)), np.minimum(u / v, v / u)
    for _ in range(22):
        third = (hi - lo) / 3
        left = fit(lo + third) < fit(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    return (lo + hi) / 2


def links(sets: list[np.ndarray], registers: np.ndarray, percent: int, classes: list[int]) -> list[tuple[int, int]]:
    """A spanning forest, over these classes, of the pairs with 100 * intersection >= percent * union."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    n_shingles, inverse = 0, np.zeros(0, np.int64)
    if n:
        distinct, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        n_shingles = len(distinct)
    root = np.unique(np.array(classes, np.int64), return_inverse=True)[1]
    slack = 6 * (percent / 100 * (1 - percent / 100) / M) ** 0.5
    mark = np.zeros(n_shingles, bool)
    found = []
    for i in range(n):
        rest = np.arange(i + 1, n)
        rest = rest[(root[rest] != root[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
        if not len(rest):
            continue
        rest = rest[joint_estimate(registers[i], size[i], registers[rest], size[rest]) >= percent / 100 - slack]
        if not len(rest):
            continue
        mark[inverse[at[i] : at[i + 1]]] = True
        for j in rest.tolist():
            if root[j] != root[i]:
                shared = int(mark[inverse[at[j] : at[j + 1]]].sum())
                if 100 * shared >= percent * (size[i] + size[j] - shared):
                    root[root == root[j]] = root[i]
                    found.append((i, j))
        mark[inverse[at[i] : at[i + 1]]] = False
    return found


def _batched(texts: Iterator[str | None], size: int, limit: int = 200_000) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for text in texts:
        held.append(shingles(text, size))
        n += len(held[-1])
        if n >= limit or len(held) >= 2000:
            yield held
            held, n = [], 0
    if held:
        yield held


_PLACE_BITS = 20  # a block has fewer rows than that many bits can number


def tagged(docs: DataFrame) -> DataFrame:
    """docs in blocks, each row as one struct `row`; a row's tag is its block's number, then its place in `_PLACE_BITS` bits."""
    return blocks_of(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))


def _place_of(tag: str) -> list[Column]:
    return [F.shiftright(tag, _PLACE_BITS).alias("block"), F.col(tag).bitwiseAND((1 << _PLACE_BITS) - 1).cast("int").alias("pos")]


def _tag_of(block: str, pos: Column) -> Column:
    return F.shiftleft(block, _PLACE_BITS) + pos


def _texts(rows: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """node, text of the rows whose tags are these nodes; only their places move."""
    wanted = places(nodes.select(*_place_of("node")))
    both = with_messages(rows.select("place", "block", F.col(f"row.`{text_col}`").alias("text")), wanted)
    each = both.select("block", F.explode(F.transform("places", lambda pos: F.struct(pos.alias("pos"), F.get("text", pos).alias("text")))).alias("x"))
    return each.select(_tag_of("block", F.col("x.pos")).alias("node"), "x.text")


def _solve(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """a, b: links of each group of rows (label, i, j, node, class, text), which stand together."""
    free_memory()
    group, nodes, classes, texts, out = None, [], [], [], []

    def flush() -> None:
        sets = [s for part in _batched(iter(texts), size) for s in part]
        out.extend((nodes[a], nodes[b]) for a, b in links(sets, sketch(sets), percent, classes))

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for *key, node, class_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != group:
                flush()
                group, nodes, classes, texts = key, [], [], []
            nodes.append(node)
            classes.append(class_)
            texts.append(text)
        if len(out) > 10_000:
            yield made()
            out.clear()
    flush()
    yield made()
    _HASHES.clear()
    free_memory()


def _first_blocks(members: DataFrame, n_blocks: Column) -> DataFrame:
    """label, i, node, n: the blocks of each level of a large cluster, and the pivots that each is sent."""
    block = lambda level, at: level * F.lit(1 << 32) + at
    at = lambda node, k: F.pmod(F.xxhash64(node), k)
    pivots = F.array(*(F.min(F.when(at("node", F.lit(PIVOTS)) == p, F.struct("node", "n"))) for p in range(PIVOTS)))
    levels = saved(members.groupBy("label", "level").agg(n_blocks.alias("k"), pivots.alias("pivots")), "levels")
    dealt = members.join(levels.drop("pivots"), ["label", "level"]).select("label", block(F.col("level"), at("node", F.col("k"))).alias("i"), "node", "n")
    sent = levels.select("label", "level", F.col("k"), F.explode("pivots").alias("p")).where("p is not null")
    sent = sent.select("label", "level", "p", at("p.node", F.col("k")).alias("home"), F.explode(F.sequence(F.col("level") - NEAR, F.col("level") + NEAR)).alias("to"))
    sent = sent.join(levels.select("label", F.col("level").alias("to"), F.col("k").alias("to_k")), ["label", "to"]).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to_k") - 1)))
    return dealt.unionByName(sent.where("to != level or at != home").select("label", block(F.col("to"), F.col("at")).alias("i"), "p.node", "p.n"))


def _pairs_of_blocks(members: DataFrame, n_blocks: Column) -> DataFrame:
    """label, i, j, node, n, class: pairs of blocks that cover each pair of classes left in a cluster.

    members: label, node, n, level, class.  Blocks of nodes outside the main class meet
    each block in reach; those of the main class meet only them.
    """
    members = saved(members, "rest")
    classes = members.groupBy("label", "class").agg(F.count("*").alias("m"))
    main = saved(classes.groupBy("label").agg(F.max_by("class", F.struct("m", "class")).alias("main"), F.count("*").alias("n_classes")).where("n_classes > 1"), "main")
    sides = saved(members.join(main, "label").withColumn("outside", F.col("class") != F.col("main")).drop("main", "n_classes"), "sides")
    sizes = saved(sides.groupBy("label", "outside", "level").agg(n_blocks.alias("k")), "blocks")
    block = lambda level, outside, at: level * F.lit(1 << 32) + outside.cast("long") * F.lit(1 << 31) + at
    own = sizes.select("label", "outside", "level", F.col("k").alias("own_k"), F.explode(F.sequence(F.col("level") - REACH, F.col("level") + REACH)).alias("to"))
    others = sizes.select("label", F.col("level").alias("to"), F.col("outside").alias("to_outside"), F.col("k").alias("to_k"))
    meets = own.join(others, ["label", "to"]).where("outside or to_outside")
    meets = meets.groupBy("label", "outside", "level", "own_k").agg(F.collect_list(F.struct("to", "to_outside", "to_k")).alias("meets"))  # two for each level in reach at most
    each = sides.join(meets, ["label", "outside", "level"]).select("label", "node", "n", "class", block(F.col("level"), F.col("outside"), F.pmod(F.xxhash64("node"), F.col("own_k"))).alias("own"), F.explode("meets").alias("m"))
    each = each.select("label", "node", "n", "class", "own", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m.to_k") - 1)).alias("at"))
    other = block(F.col("m.to"), F.col("m.to_outside"), F.col("at"))
    return each.select("label", F.least("own", other).alias("i"), F.greatest("own", other).alias("j"), "node", "n", "class")


def _least_of_bands(in_band: DataFrame) -> DataFrame:
    """band, a: the smallest name of each band that holds several.  in_band: name, band.

    Written, so that the join it is for stands alone and adaptive execution can split a hot
    band; it grows with the corpus, so it is never broadcast.
    """
    least = in_band.groupBy("band").agg(F.min("name").alias("a"), F.max("name").alias("last"))
    return saved(least.where("a != last").select("band", "a"), "bands").hint("merge")


def _loose_clusters(nodes: DataFrame) -> DataFrame:
    """node, label of the nodes that share a band with another, directly or through others."""
    in_band = nodes.select(F.col("node").alias("name"), F.explode(F.slice("bands", 1, FIRST)).alias("band"))
    least = in_band.join(_least_of_bands(in_band), "band").groupBy("name").agg(F.min("a").alias("a"))
    named = saved(nodes.join(least.withColumnRenamed("name", "node").hint("merge"), "node", "left").select("node", F.coalesce("a", "node").alias("name"), "bands"), "named")
    in_band = named.select("name", F.explode("bands").alias("band"))
    edges = in_band.join(_least_of_bands(in_band), "band").where("name != a").select("a", F.col("name").alias("b"))
    joined = connected_components(edges, "loose").withColumnRenamed("node", "name")
    labels = saved(named.select("node", "name").join(joined, "name", "left").select("node", F.coalesce("label", "name").alias("label")), "loose")
    shared = labels.where("node != label").select("label").distinct()
    return labels.join(shared, "label")


def near_duplicate_report(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85, block: int = 400, block_shingles: int = 400_000) -> DataFrame:
    """_tag, doc_id, n_shingles, component_id, kept of each row of a `tagged` table."""
    width = band_width(percent)
    each = rows.select("block", F.posexplode(F.arrays_zip(F.col(f"row.`{id_col}`").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"))).alias("pos", "x"))
    source = each.select(_tag_of("block", F.col("pos")).alias("tag"), F.col("x.doc_id").alias("doc_id"), F.col("x.text").alias("text"))
    schema = StructType([*source.schema.fields[:2], StructField("n", LongType()), StructField("set_id", BinaryType()), StructField("bands", ArrayType(LongType()))])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        for batch in batches:
            done = 0
            for sets in _batched((t.as_py() for t in batch.column(2)), size):
                part = batch.slice(done, len(sets))
                done += len(sets)
                keys = bands(sketch(sets), width)
                ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, M // width, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), flat], schema.names)
        _HASHES.clear()
        free_memory()

    with scratch(rows.sparkSession) as tables, arrow_batches(rows.sparkSession, TEXTS):
        sketched = saved(source.mapInArrow(sketches, schema), "sketches")
        tables.keep_last()
        classes = _classes(partial(_texts, rows, text_col), sketched, size, percent, block, block_shingles)
        tables.keep_last()
    return (
        sketched.select("tag", "doc_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
        .join(classes, "set_id", "left")
        .select(
            F.col("tag").alias("_tag"),
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("smallest").isNull(), F.col("doc_id")).otherwise(F.col("smallest.doc_id")).alias("component_id"),
            F.coalesce(F.col("smallest.tag") == F.col("tag"), F.lit(True)).alias("kept"),
        )
    )


def _classes(texts_of: Callable[[DataFrame], DataFrame], sketched: DataFrame, size: int, percent: int, block: int, block_shingles: int) -> DataFrame:
    """set_id, smallest (none, doc_id, tag) of each set that isn't empty."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")
    nodes = saved(sketched.where("n > 0").groupBy("set_id").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands")).withColumn("node", F.col("first.tag")), "nodes")
    level = F.floor(F.log("n") / (max(math.log(100 / percent), 0.005) / LEVELS)).alias("level")
    clusters = saved(_loose_clusters(nodes).join(nodes.select("node", "n", level), "node"), "clusters")
    texts = saved(texts_of(clusters), "cluster-texts")
    n_blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles))

    def solved(members: DataFrame) -> DataFrame:
        """Links a, b within each (label, i, j).  members: label, i, j, node, n, class; a class is joined already."""
        members = saved(members, "members")
        cost = members.agg(F.sum("n").alias("n"), F.count("*").alias("m")).first()
        parts = min(max(1, (cost["n"] or 0) // 250_000, cost["m"] // 500), 100_000)
        groups = members.join(texts, "node").repartition(parts, "label", "i", "j").sortWithinPartitions("label", "i", "j")
        return saved(groups.select("label", "i", "j", "node", "class", "text").mapInArrow(partial(_solve, size=size, percent=percent), "a long, b long"), "links")

    large = saved(clusters.groupBy("label").agg(n_blocks.alias("k")).where("k > 1").select("label"), "large")
    if large.isEmpty():
        dealt = clusters.select("label", F.lit(0).cast("long").alias("i"), "node", "n")
    else:
        split = saved(clusters.join(large, "label"), "split")
        dealt = clusters.join(large, "label", "left_anti").select("label", F.lit(0).cast("long").alias("i"), "node", "n").unionByName(_first_blocks(split, n_blocks))
    confirmed = connected_components(solved(dealt.select("label", "i", F.col("i").alias("j"), "node", "n", F.col("node").alias("class"))), "links")
    if not large.isEmpty():
        members = split.join(confirmed.withColumnRenamed("label", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
        joined = confirmed.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(solved(_pairs_of_blocks(members, n_blocks)))
        confirmed = connected_components(joined, "links")
    labelled = nodes.select("node", "set_id", "first").join(confirmed, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = saved(labelled.groupBy("label").agg(F.min("first").alias("smallest")), "smallest")
    return saved(labelled.join(smallest, "label").select("set_id", "smallest"), "classes")


def near_deduplicate(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, with all columns of docs: the one with the smallest id."""
    rows = tagged(docs)
    dropped = near_duplicate_report(rows, **how).where("not kept").select("_tag")
    return rows_but(rows, dropped.select(*_place_of("_tag")))
