"""Exact top-k by inner product: a kNN join over Voronoi cells.

Vectors become integers, floor(scale * x).  Pivots are k-means centres of a bounded sample,
and each vector belongs to its nearest pivot.  A cell's vectors are dealt into chunks of
bounded size, so a hot cell is many chunks on many tasks, and are summed up as count and
radius; these summaries, one a pivot, are all that reaches the driver.

Queries are grouped by pivot too.  For query q and a cell with pivot c and radius r every
vector x of the cell has |q.x - q.c| <= |q| r.  First a group is solved in its own cell.
The k-th score found there, or one that the summaries of enough vectors vouch for, is a
floor: the group then goes only to those other cells that can reach the floor of one of
its queries, and there only scores that reach it leave the task.  Of the two
sides the queries are the smaller, so it is they that are replicated; data chunks are dealt
once and stay where they are.  The last step keeps k rows a query, cut once before the shuffle.

Products are exact: in double precision while they fit 53 bits, beyond in whole numbers.

Defined results: vectors that are NULL or hold NULL or a non-finite component take no
part, nor do those whose scaled components aren't finite; shorter vectors count as if zeros followed; of equal scores the smaller id comes
first, NULL last; repeated rows are candidates each, and a query is no candidate of itself, but its
copies are; with fewer than k candidates all are returned; a score beyond 64 bits
counts as the nearest 64-bit integer; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from paywire.llm.blocks import PLACE_SHIFT, with_messages
from paywire.llm.common import bucket_count, bucketed, saved

SAMPLE_BYTES = 16 << 20  # of the sample that pivots are fitted on
SAMPLE_ROWS = 8_192
MAX_PIVOTS = 256
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 8_192
GROUP_QUERIES = 1_000
MAX_BROADCAST = 500_000  # rows (chunk, cell) of 12 bytes; with more, they are merged with the query groups instead
EXACT = 2.0**53


def vectors(rows: DataFrame, id_col: str, vector_col: str, is_query: Column, scale: int) -> DataFrame:
    """tag, id, query, v: valid vectors as whole numbers in double precision."""
    x = F.col(f"`{vector_col}`")
    scaled = lambda c: c.cast("double") * F.lit(float(scale))
    sound = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(scaled(c)) < float("inf"), F.lit(False)))  # NaN is greater than all
    whole = F.transform(x, lambda c: F.when(F.abs(scaled(c)) < EXACT, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    return rows.where(sound).select(F.monotonically_increasing_id().alias("tag"), F.col(f"`{id_col}`").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), whole.alias("v"))


@dataclass
class Cells:
    """Pivots, and what is known of each one's cell."""

    pivots: np.ndarray  # [cells, width]
    count: np.ndarray
    radius: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each query (row) with a vector of each cell; a little slack for rounding."""
        with np.errstate(over="ignore", invalid="ignore"):  # what overflows bounds nothing
            return self._bounds(q)

    def _bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = q @ self.pivots.T
        norms = np.sqrt((q**2).sum(1))[:, None]
        reach = norms * self.radius * (1 + 1e-9) + 1e-9 * norms * np.sqrt((self.pivots**2).sum(1)) + 1
        return middle - reach, middle + reach

    def floors(self, low: np.ndarray, k: int) -> np.ndarray:
        """Scores that k vectors besides the query itself surely reach; -inf where there aren't so many."""
        order = np.argsort(-low, 1)
        enough = np.cumsum(self.count[order], 1) >= k + 1
        at = np.where(enough.any(1), enough.argmax(1), 0)
        found = np.take_along_axis(low, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
        return np.where(enough.any(1) & ~np.isnan(found), found, -np.inf)


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centres of the sample, from rows of it drawn with the generator's seed."""
    distinct = np.unique(sample, axis=0)
    rnd = np.random.default_rng(seed)
    centres = distinct[rnd.permutation(len(distinct))[:n]]
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, 1)
        count = np.bincount(nearest, minlength=len(centres))
        sums = np.stack([np.bincount(nearest, sample[:, d], len(centres)) for d in range(sample.shape[1])], 1) if sample.shape[1] else np.zeros((len(centres), 0))
        centres = np.where(count[:, None] > 0, sums / np.maximum(1, count)[:, None], centres)
    return centres


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, with zeros behind shorter ones."""
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat, n = lists.flatten().to_numpy(zero_copy_only=False), len(lists)
    if n and (np.diff(ends) == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    for i in range(n):
        out[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
    return out


def _assigned(rows: DataFrame, pivots, width: int) -> DataFrame:
    """rows with their cell and distance to its pivot."""
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("distance", DoubleType())])
    at = rows.columns.index("v")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = pivots.value
        for batch in batches:
            x = _matrix(batch.column(at), width)
            cell = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
            distance = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distance)], schema.names)

    return rows.mapInArrow(nearest, schema)


def _packed(rows: DataFrame, width: int, most: int, label: str) -> DataFrame:
    """place, block, cell, n, and tag, id and floor as arrays, matrix: rows (cell, tag, id, v, floor), which stand by cell, some of one cell at a time."""
    kind = rows.schema["id"].dataType
    names = ["place", "block", "cell", "n", "tags", "ids", "floors", "matrix"]
    schema = StructType([*(StructField(x, LongType()) for x in names[:2]), StructField("cell", IntegerType()), StructField("n", LongType()), StructField("tags", ArrayType(LongType())), StructField("ids", ArrayType(kind)), StructField("floors", ArrayType(DoubleType())), StructField("matrix", BinaryType())])
    most = max(1, min(most, CHUNK_BYTES // (8 * max(1, width))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lists = [pa.ListArray.from_arrays(np.array([0, n], np.int32), whole.column(c)) for c in (1, 2, 4)]
            matrix = _matrix(whole.column(3), width).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([(place << PLACE_SHIFT) + k], pa.int64()), pa.array([whole.column(0)[0].as_py()], pa.int32()), pa.array([n], pa.int64()), *lists, pa.array([matrix], pa.binary())], names)

        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and (held[0].column(0)[0].as_py() != cell[a] or n >= most):
                        yield done()
                        k, held, n = k + 1, [], 0
                    take = min(b - a, most - n)
                    held.append(batch.slice(a, take))
                    a, n = a + take, n + take
        if held:
            yield done()

    ready = rows.select("cell", "tag", "id", "v", "floor").mapInArrow(packed, schema)
    return bucketed(ready, label, "place", bucket_count(rows))


def _by_cell(rows: DataFrame, counts: dict[int, int], most: int) -> DataFrame:
    """rows sorted by cell, a cell with more rows than `most` in several tasks."""
    parts = rows.sparkSession.createDataFrame([(c, -(-n // most)) for c, n in counts.items()] or [(0, 1)], "cell int, parts long")
    dealt = rows.join(F.broadcast(parts), "cell").withColumn("_part", F.pmod(F.xxhash64("tag"), F.col("parts")))  # at most MAX_PIVOTS rows
    n = max(1, min(sum(-(-x // most) for x in counts.values()), 10_000))
    return dealt.repartition(n, "cell", "_part").sortWithinPartitions("cell")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly: doubles where they hold every partial sum, Python's integers elsewhere."""
    largest = np.sqrt((a**2).sum(1).max(initial=0)) * np.sqrt((b**2).sum(1).max(initial=0))
    if largest < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    exact = whole(a) @ whole(b).T
    return np.array([[min(max(x, -(1 << 63)), (1 << 63) - 1) for x in row] for row in exact.tolist()], object).reshape(exact.shape)


def _solved(chunks: DataFrame, pairs: DataFrame, k: int, width: int) -> DataFrame:
    """query_tag, id, tag, score: of each pair of a chunk and a query group the k best of each query that reach its floor."""
    kind = chunks.schema["ids"].dataType.elementType
    schema = StructType([StructField("query_tag", LongType()), StructField("id", kind), StructField("tag", LongType()), StructField("score", LongType())])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tags, ids, matrix, q_tags, floors, q_matrix = (batch.column(c)[row] for c in range(6))
                x = np.frombuffer(matrix.as_py(), np.float64).reshape(-1, width) if width else np.zeros((len(tags.values), 0))
                q = np.frombuffer(q_matrix.as_py(), np.float64).reshape(-1, width) if width else np.zeros((len(q_tags.values), 0))
                own, mine, least = tags.values.to_numpy(), q_tags.values.to_numpy(), floors.values.to_numpy()
                place = _order(ids.values)
                found = [[], [], [], []]
                for i in range(0, len(q), 64):
                    scores = _products(q[i : i + 64], x)
                    for s, tag, floor in zip(scores, mine[i : i + 64], least[i : i + 64], strict=True):
                        near = np.flatnonzero((s >= floor) & (own != tag))
                        if len(near) > k:
                            cut = np.partition(s[near], len(near) - k)[len(near) - k] if s.dtype != object else sorted(s[near])[-k]
                            near = near[s[near] >= cut]
                            near = near[np.lexsort((place[near], -s[near]))[:k]] if s.dtype != object else np.array(sorted(near, key=lambda j: (-s[j], place[j]))[:k])
                        if len(near):
                            found[0].append(np.full(len(near), tag))
                            found[1].append(near)
                            found[2].append(own[near])
                            found[3].append(s[near].astype(np.int64))
                if found[0]:
                    which = np.concatenate(found[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[0])), ids.values.take(pa.array(which)), pa.array(np.concatenate(found[2])), pa.array(np.concatenate(found[3]))], schema.names)

    return with_messages(chunks, pairs).select("tags", "ids", "matrix", "q_tags", "q_floors", "q_matrix").mapInArrow(solved, schema)


def _order(ids: pa.Array) -> np.ndarray:
    """Each id's place in ascending order, NULL last; equal ids in any order."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_tag").orderBy(F.desc("score"), F.asc_nulls_last("id"), "tag")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "id", vector_col: str = "vector", scale: int = 1024, max_pivots: int = MAX_PIVOTS, chunk_rows: int = CHUNK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """query_id, rank, id, score: the k greatest inner products of each row for which is_query holds, among all other rows."""
    spark = rows.sparkSession
    every = saved(vectors(rows, id_col, vector_col, is_query, scale), "knn-vectors")
    known = every.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = known["n"], max(known["width"] or 0, 0)
    few = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, width))))
    sample = every.orderBy(F.xxhash64("v", "tag"), "tag").limit(few).select("v").toArrow().combine_chunks()
    lists = sample.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    points = _matrix(lists, width) if n else np.zeros((1, width))
    centres = fit_pivots(points, max(1, min(max_pivots, int(n**0.5) // 4 + 1, few)))
    pivots = spark.sparkContext.broadcast(centres)
    placed = saved(_assigned(every, pivots, width), "knn-cells")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.count_if("query").alias("queries")).collect()  # a row a pivot
    cells = Cells(centres, np.zeros(len(centres)), np.zeros(len(centres)))
    for r in summary:
        cells.count[r["cell"]], cells.radius[r["cell"]] = r["n"], r["radius"]
    none = F.lit(0.0).alias("floor")
    chunks = _packed(_by_cell(placed.select("cell", "tag", "id", "v", none), {r["cell"]: r["n"] for r in summary}, chunk_rows), width, chunk_rows, "knn-chunks")
    counts = {r["cell"]: r["queries"] for r in summary if r["queries"]}
    asked = placed.where("query")

    def groups(queries: DataFrame) -> DataFrame:
        return _packed(_by_cell(queries.select("cell", "tag", "id", "v", "floor"), counts, group_queries), width, group_queries, "knn-queries")

    homes = chunks.select("block", F.col("cell").alias("to"))
    homes = F.broadcast(homes) if homes.count() <= MAX_BROADCAST else homes.hint("merge")

    def sent(queries: DataFrame) -> DataFrame:
        """block (of chunks) and the query group that must see it; queries: to (cell) and a group's columns."""
        return queries.select("to", F.col("tags").alias("q_tags"), F.col("floors").alias("q_floors"), F.col("matrix").alias("q_matrix")).join(homes, "to").drop("to")

    shared = spark.sparkContext.broadcast(cells)

    @F.arrow_udf("double")
    def vouched(v: pa.Array) -> pa.Array:
        found = shared.value
        return pa.array(found.floors(found.bounds(_matrix(v, width))[0], k))

    first = groups(asked.withColumn("floor", vouched("v")))
    home = saved(_best(_solved(chunks, sent(first.withColumn("to", F.col("cell"))), k, width), k), "knn-home")
    reached = home.groupBy("query_tag").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("reached"))
    under = F.col("reached") - F.abs("reached") * F.lit(4e-16)  # where a double can't hold the score
    floor = F.greatest(F.coalesce(under, F.lit(float("-inf"))), vouched("v"))
    second = groups(asked.join(reached, asked["tag"] == reached["query_tag"], "left").withColumn("floor", floor))

    @F.arrow_udf("array<int>")
    def others(cell: pa.Array, matrix: pa.Array, floors: pa.Array) -> pa.Array:
        found, out = shared.value, []
        for own, raw, least in zip(cell, matrix, floors, strict=True):
            q = np.frombuffer(raw.as_py(), np.float64).reshape(-1, width) if width else np.zeros((len(least.values), 0))
            need = ((found.bounds(q)[1] >= least.values.to_numpy()[:, None]).any(0)) & (found.count > 0)
            need[own.as_py()] = False
            out.append(np.flatnonzero(need).tolist())
        return pa.array(out, pa.list_(pa.int32()))

    away = _solved(chunks, sent(second.withColumn("to", F.explode(others("cell", "matrix", "floors")))), k, width)
    best = _best(home.drop("rank").unionByName(away), k)
    names = asked.select(F.col("tag").alias("query_tag"), F.col("id").alias("query_id"))
    return best.join(names, "query_tag").select("query_id", "rank", "id", "score")
