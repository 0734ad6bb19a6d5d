"""Merkle manifest of a dataset: one tree a group, and a tree over the groups' roots.

Leaves stand in order of their ids and are cut into blocks of one task's rows.  A block
is a sparse forest: it hashes each run of siblings that it holds completely, level by
level, and keeps what is left over at its edges, nodes keyed by tree, level and index.
Two forests merge by union, after which every sibling run that has become complete (its
arity is known, as the sizes of all levels follow from the number of leaves) is hashed
into its parent.  Merging is associative, and what a merged forest still holds is no more
than its two edges, so forests are merged in rounds as a tree: first those of one task,
then `FAN` neighbours at a time.  Each round is written, so a lost executor costs one
round.  A finished tree's root becomes a leaf of the tree over all groups, so one forest
holds both and many small groups resolve as well as one large one.

Proofs need the siblings of each ancestor.  A block makes the families within it again;
those that its first and last leaves' paths share with other blocks are sent to it,
two a level.  Leaves shuffle once, to be sorted; texts never do, and neither nodes nor
digests pass through the driver, which gets counts only.

Defined results: NULL columns are marked apart from empty ones; a NULL group is the first
one, NULL ids stand first in it; rows with one id stand in the order of their leaves'
digests, equal rows as they come; a lone leaf is its tree's root, and a lone group's root the
whole's; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywire.llm.blocks import blocks_of, with_messages
from paywire.llm.common import bucket_count, lower_ascii, saved

ARITY_BITS = 3  # eight siblings
FAN_BITS = 4  # neighbours that a round merges: 16
MAX_LEVEL = 21
TOP = -1  # the tree over all groups
FAMILY = "tree long, level int, at long, children array<binary>"
NODE = "tree long, size long, level int, at long, digest binary"


def _one(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values one after another: `-` for NULL, else the bytes of its text, `:` and the text."""
    return F.unhex(F.sha2(F.concat(*map(_one, values)), 256))


def parent(children: list[bytes]) -> bytes:
    """A node's digest from its children's, which are put in as hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def level_sizes(n: int) -> list[int]:
    """Nodes of each level of a tree with n leaves, from the leaves up to one."""
    out = [n]
    while out[-1] > 1:
        out.append((out[-1] + (1 << ARITY_BITS) - 1) >> ARITY_BITS)
    return out


class Forest:
    """Nodes whose sibling runs aren't complete yet, and the families completed on the way."""

    def __init__(self, n_trees: int):
        self.sizes: dict[int, list[int]] = {TOP: level_sizes(n_trees)}
        self.runs: dict[tuple[int, int, int], dict[int, bytes]] = {}  # of a parent (tree, level, index): its children by index
        self.roots: dict[int, bytes] = {}
        self.families: list[tuple[int, int, int, list[bytes]]] = []

    def add(self, tree: int, size: int, level: int, at: int, digest: bytes) -> None:
        """Put in a node; each run that it completes becomes its parent, up to the root."""
        sizes = self.sizes.get(tree)
        if sizes is None:
            sizes = self.sizes[tree] = level_sizes(size)
        while level < len(sizes) - 1:
            key = tree, level + 1, at >> ARITY_BITS
            run = self.runs.setdefault(key, {})
            run[at] = digest
            first = key[2] << ARITY_BITS
            if len(run) < min(1 << ARITY_BITS, sizes[level] - first):
                return
            children = [run[k] for k in range(first, first + len(run))]
            del self.runs[key]
            self.families.append((*key, children))
            level, at, digest = level + 1, key[2], parent(children)
        if tree == TOP:
            self.roots[TOP] = digest
        else:
            self.roots[tree] = digest
            self.add(TOP, 0, 0, tree, digest)

    def left(self) -> Iterator[tuple[int, int, int, int, bytes]]:
        for (tree, level, _), run in self.runs.items():
            for at, digest in run.items():
                yield tree, self.sizes[tree][0], level - 1, at, digest


RUN = "tree long, first long, n long, size long"


def _grown(runs: list, leaves: list[bytes], n_trees: int) -> Forest:
    """The forest of one block: runs (tree, index of the first leaf, leaves, leaves of the whole tree) in order."""
    forest, at = Forest(n_trees), 0
    for run in runs:
        for k in range(run["n"]):
            forest.add(run["tree"], run["size"], 0, run["first"] + k, leaves[at + k])
        at += run["n"]
    return forest


def _node_rows(group: list[int], nodes: list[tuple], families: list[tuple]) -> pa.RecordBatch:
    none = [None] * len(nodes)
    columns = [
        pa.array(group + [None] * len(families), pa.int64()),
        pa.array([x[0] for x in nodes] + [x[0] for x in families], pa.int64()),
        pa.array([x[1] for x in nodes] + [None] * len(families), pa.int64()),
        pa.array([x[2] for x in nodes] + [x[1] for x in families], pa.int32()),
        pa.array([x[3] for x in nodes] + [x[2] for x in families], pa.int64()),
        pa.array([x[4] for x in nodes] + [None] * len(families), pa.binary()),
        pa.array(none + [x[3] for x in families], pa.list_(pa.binary())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["group", "tree", "size", "level", "at", "digest", "children"])


_ROWS = f"group long, {NODE}, children array<binary>"


def _tree_reduced(first: DataFrame, n_trees: int, last_place: int) -> DataFrame:
    """FAMILY rows of all families that no single block holds, from the blocks' nodes (group: place, NODE)."""

    def merged(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
        now, forest = None, Forest(n_trees)

        def done() -> pa.RecordBatch:
            left = list(forest.left())
            return _node_rows([now >> bits] * len(left), left, forest.families)

        for batch in batches:
            for group, *node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and group != now:
                    yield done()
                    forest = Forest(n_trees)
                now = group
                forest.add(*node)
        if now is not None:
            yield done()

    names = ["group", "tree", "size", "level", "at", "digest"]
    nodes, span, rounds = first, last_place + 1, []
    while True:
        dealt = nodes.select(*names).repartition("group").sortWithinPartitions("group")
        rounds.append(saved(dealt.mapInArrow(partial(merged, bits=FAN_BITS), _ROWS), "merkle-round"))
        nodes = rounds[-1].where("group is not null")
        if span == 1:
            break
        span = (span + (1 << FAN_BITS) - 1) >> FAN_BITS
    families = rounds[0].where("group is null")
    for r in rounds[1:]:
        families = families.unionByName(r.where("group is null"))
    return families.select("tree", "level", "at", "children")


class Manifest:
    """Blocks of sorted leaves, their runs, and the families between blocks; `proofs` reads them."""

    def __init__(self, blocks: DataFrame, runs: DataFrame, families: DataFrame, n_trees: int):
        self.blocks, self.runs, self.families, self.n_trees = blocks, runs, families, n_trees

    def _messages(self) -> DataFrame:
        """block, runs, families: what a block must know to prove its leaves."""
        levels = lambda size: F.filter(F.sequence(F.lit(1), F.lit(MAX_LEVEL)), lambda k: size > F.pow(F.lit(float(1 << ARITY_BITS)), k - 1))
        up = lambda at, k: F.expr(f"shiftright({at}, {ARITY_BITS} * {k})")
        own = self.runs.select("block", "tree", F.explode(levels(F.col("size"))).alias("level"), "first", (F.col("first") + F.col("n") - 1).alias("last"))
        span = self.runs.groupBy("block").agg(F.min("tree").alias("first"), F.max("tree").alias("last"))
        top = span.select("block", F.lit(TOP).cast("long").alias("tree"), F.explode(levels(F.lit(self.n_trees))).alias("level"), "first", "last")
        wanted = own.unionByName(top).select("block", "tree", "level", F.explode(F.array_distinct(F.array(up("first", "level"), up("last", "level")))).alias("at"))
        sent = saved(wanted.join(self.families, ["tree", "level", "at"]).groupBy("block").agg(F.collect_list(F.struct("tree", "level", "at", "children")).alias("families")), "merkle-sent")
        runs = self.runs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("tree", "first", "n", "size"))).alias("runs"))
        return runs.join(sent, "block", "left")

    def proofs(self, changed: str | None = None) -> DataFrame:
        """id, tree, index, size, leaf, subroot, root, siblings, folded_root of each leaf; digests in binary.

        siblings: the digests beside the leaf and beside each of its ancestors up to the root, left to right and level
        by level, one after another; with tree, index and size they are all that `fold` needs.
        changed: a column of the leaves with another digest to fold in the leaf's place, where it isn't NULL.
        """
        n_trees = self.n_trees
        kind = self.blocks.schema["id"].dataType.elementType.simpleString()
        names = ["id", "tree", "index", "size", "leaf", "subroot", "root", "siblings", "folded_root"]

        def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    ids, (leaves, others, runs, sent) = batch.column(0)[row].values, (c[row].as_py() for c in batch.columns[1:])
                    done = 0
                    for part in _proved(leaves, others, runs, sent or [], n_trees):
                        columns = [pa.array(c, pa.int64() if k < 3 else pa.binary()) for k, c in enumerate(zip(*part, strict=True))]
                        yield pa.RecordBatch.from_arrays([ids.slice(done, len(part)), *columns], names)
                        done += len(part)

        other = F.col(changed) if changed else F.transform("leaf", lambda _: F.lit(None).cast("binary"))
        both = with_messages(self.blocks.select("place", "block", "id", "leaf", other.alias("other")), self._messages())
        schema = f"id {kind}, tree long, index long, size long, " + ", ".join(f"{x} binary" for x in names[4:])
        return both.select("id", "leaf", "other", "runs", "families").mapInArrow(proved, schema)


def fold(leaf: bytes, tree: int, index: int, size: int, n_trees: int, siblings: bytes) -> bytes:
    """The root that a leaf and its proof lead to; what a reader of one document checks."""
    digest, at, used = leaf, index, 0
    for sizes, start in ((level_sizes(size), index), (level_sizes(n_trees), tree)):
        at = start
        for n in sizes[:-1]:
            place, width = at & 7, min(8, n - (at & ~7))
            beside = [siblings[k : k + 32] for k in range(used, used + 32 * (width - 1), 32)]
            used += 32 * (width - 1)
            digest, at = parent([*beside[:place], digest, *beside[place:]]), at >> ARITY_BITS
    return digest


def _proved(leaves: list[bytes], others: list[bytes | None], runs: list, sent: list, n_trees: int, rows: int = 2_000) -> Iterator[list[tuple]]:
    """(tree, index, size, leaf, subroot, root, siblings, folded_root) of a block's leaves in order, some at a time."""
    known = {(f[0], f[1], f[2]): f[3] for f in _grown(runs, leaves, n_trees).families}
    known |= {(f["tree"], f["level"], f["at"]): f["children"] for f in sent}
    top = len(level_sizes(n_trees)) - 1
    paths: dict[tuple[int, int, int], bytes] = {}

    def above(tree: int, height: int, level: int, at: int) -> bytes:
        """Digests beside a node and its ancestors."""
        if level == height:
            return b"" if tree == TOP else above(TOP, top, 0, tree)
        found = paths.get((tree, level, at))
        if found is None:
            children, place = known[tree, level + 1, at >> ARITY_BITS], at & 7
            found = b"".join([*children[:place], *children[place + 1 :], above(tree, height, level + 1, at >> ARITY_BITS)])
            if level or height == 0:
                paths[tree, level, at] = found
        return found

    def folded(tree: int, height: int, at: int, digest: bytes) -> bytes:
        for level in range(height):
            children, place = known[tree, level + 1, at >> ARITY_BITS], at & 7
            digest = parent([*children[:place], digest, *children[place + 1 :]])
            at >>= ARITY_BITS
        return digest

    out: list[tuple] = []
    at = 0
    for run in runs:
        tree, size = run["tree"], run["size"]
        height = len(level_sizes(size)) - 1
        subroot = parent(known[tree, height, 0]) if height else leaves[at]
        root = parent(known[TOP, top, 0]) if top else subroot
        for index in range(run["first"], run["first"] + run["n"]):
            leaf, other = leaves[at], others[at]
            end = folded(TOP, top, tree, folded(tree, height, index, leaf if other is None else other))
            out.append((tree, index, size, leaf, subroot, root, above(tree, height, 0, index), end))
            at += 1
            if len(out) >= rows:
                yield out
                out = []
    if out:
        yield out


def _before(sums: DataFrame, value: str, by: list[str], order: str, name: str) -> DataFrame:
    """Each row's sum of the rows before it; there is a row for each task at most in a window."""
    return sums.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order)) - F.col(value))


def build(leaves: DataFrame, max_rows: int = 20_000) -> Manifest:
    """leaves: group (string, may be NULL), id, leaf (digest), and other columns, which stay with them."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))  # in order, and without a NULL
    rows = saved(leaves.withColumn("group", tree).withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    order = ["group", "id", "leaf", "_row"]  # the last splits rows that are the same
    in_order = rows.repartitionByRange(max(bucket_count(rows), 1), *order).sortWithinPartitions(*order).drop("_row")
    blocks = blocks_of(in_order, max_rows)
    return _of_blocks(blocks)


def _of_blocks(blocks: DataFrame) -> Manifest:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, block, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                names, n = np.unique(np.array(groups.values.to_pylist(), object), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(n), pa.int64()), pa.array([block] * len(n), pa.int64()), pa.array(names.tolist(), pa.string()), pa.array(n, pa.int64())], ["place", "block", "group", "n"])

    pieces = saved(blocks.select("place", "block", "group").mapInArrow(cut, "place long, block long, group string, n long"), "merkle-pieces")
    by_task = pieces.groupBy("group", "place").agg(F.sum("n").alias("m"))
    by_task = saved(_before(by_task, "m", ["group"], "place", "before").withColumn("size", F.sum("m").over(Window.partitionBy("group"))), "merkle-tasks")
    begun = by_task.where("before = 0").select("place", "group", "size")  # where each tree begins
    counts = saved(_before(begun.groupBy("place").agg(F.count("*").alias("trees")), "trees", [], "place", "earlier"), "merkle-trees")
    numbered = begun.join(counts, "place").select("group", "size", (F.col("earlier") + F.row_number().over(Window.partitionBy("place").orderBy("group")) - 1).alias("tree"))
    n_trees = int(counts.agg(F.sum("trees")).first()[0] or 0)
    trees = saved(numbered, "merkle-groups")
    within = _before(pieces, "n", ["group", "place"], "block", "inside")
    runs = within.join(by_task.select("group", "place", "before"), ["group", "place"]).join(trees, "group")
    runs = saved(runs.select("place", "block", "tree", (F.col("before") + F.col("inside")).alias("first"), "n", "size"), "merkle-runs")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                place, leaves, own = (c[row].as_py() for c in batch.columns)
                left = list(_grown(own, leaves, n_trees).left())
                yield _node_rows([place] * len(left), left, [])

    sent = runs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("tree", "first", "n", "size"))).alias("runs"))
    nodes = with_messages(blocks.select("place", "block", "leaf"), sent).select("place", "leaf", "runs").mapInArrow(edges, _ROWS)
    last = blocks.agg(F.max("place")).first()[0] or 0
    return Manifest(blocks, runs, _tree_reduced(nodes, n_trees, last), n_trees)


def document_leaves(docs: DataFrame, id_col: str, group_col: str, columns: list[str], tampered: Column | None = None, text_col: str = "text") -> DataFrame:
    """group, id, leaf of documents; with tampered also `changed`, the leaf after lower-casing the text's A-Z where it holds."""
    quoted = {c: F.col(f"`{c}`") for c in [id_col, *columns]}
    rows = [F.col(f"`{group_col}`").cast("string").alias("group"), quoted[id_col].alias("id"), leaf_digest(*(quoted[c] for c in columns)).alias("leaf")]
    if tampered is not None:
        other = leaf_digest(*(lower_ascii(quoted[c]) if c == text_col else quoted[c] for c in columns))
        rows.append(F.when(tampered, other).alias("changed"))
    return docs.select(*rows)


def proof_digest(siblings: Column) -> Column:
    """SHA-256 over the hex text of a proof's siblings."""
    return F.sha2(F.lower(F.hex(siblings)), 256)
