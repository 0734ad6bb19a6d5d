"""Quality classifier: a byte-level convolutional network in numpy.

Every `STEP` bytes a window of `WIDTH` bytes is seen by learned filters (an
embedding of each byte at each place, summed); behind a text there are only
zeros, so its score is the same alone and in any batch.  A document is covered by chunks
of 256 bytes that overlap by half; in a chunk each filter keeps its maximum.  The
mean, the maximum and the minimum of the chunks' values go through one logistic
unit: a chunk of repeats has few windows, so its maxima are low.
Training is plain back-propagation with Adam on the driver, over whole texts of
at most `max_rows` labelled rows, those with the smallest hash of their id.

Defined results: NULL counts as the empty text, which gets a score like any
other (it is all padding); with no labelled rows every score is 0.5; a label that is
NULL is left out, of several labels of one id the largest counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywire.llm.common import free_memory

WIDTH, STEP, FILTERS = 8, 4, 16
BLOCK = 32  # window positions in half a chunk: 128 bytes
MAX_BYTES = 1 << 20  # in a batch inside a task


@dataclass
class Network:
    table: np.ndarray  # [WIDTH, 256, FILTERS]
    bias: np.ndarray  # [FILTERS]
    head: np.ndarray  # [3 * FILTERS]
    offset: np.ndarray  # [1]

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rnd = np.random.default_rng(seed)
        draw = lambda scale, *shape: rnd.normal(0, scale, shape).astype(np.float32)
        return cls(draw(0.15, WIDTH, 256, FILTERS), np.zeros(FILTERS, np.float32), draw(0.3, 3 * FILTERS), np.zeros(1, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.head, self.offset]

    def pairs(self) -> np.ndarray:
        """The table for two bytes at a time: [WIDTH / 2, 65536, FILTERS]."""
        return np.stack([(self.table[w + 1][:, None] + self.table[w][None]).reshape(65_536, FILTERS) for w in range(0, WIDTH, 2)])


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with each document padded with zeros to whole blocks, and each document's number of blocks."""
    span = BLOCK * STEP
    blocks = np.array([max(1, -(-len(t) // span)) for t in texts], np.int64)
    flat = b"".join(t.ljust(n * span, b"\0") for t, n in zip(texts, blocks.tolist(), strict=True))
    return np.frombuffer(flat + bytes(WIDTH), np.uint8), blocks


def last_windows(blocks: np.ndarray) -> np.ndarray:
    """The last window of each document: its bytes from STEP on would be the next document's."""
    return np.cumsum(blocks) * BLOCK - 1


def _chunks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block of each chunk, and where each document's chunks begin."""
    n = np.maximum(1, blocks - 1)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    first = np.arange(n.sum()) + np.repeat(np.concatenate([[0], np.cumsum(blocks)[:-1]]) - starts, n)
    last = first + np.repeat((blocks > 1).astype(np.int64), n)
    return first, last, starts


def pooled(net: Network, pairs: np.ndarray, data: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Largest rectified response of each filter in each block: [blocks, FILTERS]."""
    two = data[:-1].astype(np.int32) | data[1:].astype(np.int32) << 8
    n_blocks, last = int(blocks.sum()), last_windows(blocks)
    out = np.empty((n_blocks, FILTERS), np.float32)
    at = 128  # blocks at a time, so that the responses stay in the cache
    for k in range(0, n_blocks, at):
        m = min(at, n_blocks - k)
        lo = k * BLOCK * STEP
        ends = last[np.searchsorted(last, k * BLOCK) : np.searchsorted(last, (k + m) * BLOCK)] - k * BLOCK
        r = pairs[0][two[lo : lo + m * BLOCK * STEP : STEP]]
        for w in range(1, WIDTH // 2):
            seen = two[lo + 2 * w : lo + 2 * w + m * BLOCK * STEP : STEP]
            if 2 * w >= STEP:
                seen = seen.copy()
                seen[ends] = 0
            r = r + pairs[w][seen]
        out[k : k + m] = r.reshape(m, BLOCK, FILTERS).max(1)
    return np.maximum(out + net.bias, 0)


def score(net: Network, pairs: np.ndarray, texts: list[bytes]) -> np.ndarray:
    data, blocks = laid_out(texts)
    best = pooled(net, pairs, data, blocks)
    first, last, starts = _chunks(blocks)
    chunk = np.maximum(best[first], best[last])
    mean = np.add.reduceat(chunk, starts) / np.maximum(1, blocks - 1)[:, None]
    features = np.concatenate([mean, np.maximum.reduceat(chunk, starts), np.minimum.reduceat(chunk, starts)], 1).astype(np.float64)
    logit = (features * net.head).sum(1) + net.offset  # row by row, so that a row's sum doesn't depend on the number of rows
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    data, blocks = laid_out(texts)
    n, total = len(texts), int(blocks.sum())
    r = np.zeros((total * BLOCK, FILTERS), np.float32)
    seen = np.stack([data[w : w + total * BLOCK * STEP : STEP] for w in range(WIDTH)])
    seen[STEP:, last_windows(blocks)] = 0
    for w in range(WIDTH):
        r += net.table[w][seen[w]]
    r = r.reshape(total, BLOCK, FILTERS)
    where = r.argmax(1)
    raw = np.take_along_axis(r, where[:, None], 1)[:, 0] + net.bias
    best = np.maximum(raw, 0)
    first, last, starts = _chunks(blocks)
    winner = np.where(best[first] >= best[last], first[:, None], last[:, None])
    columns = np.arange(FILTERS)
    chunk = best[winner, columns]
    count = np.maximum(1, blocks - 1)
    mean = np.add.reduceat(chunk, starts) / count[:, None]
    extremes = [np.maximum.reduceat(chunk, starts), np.minimum.reduceat(chunk, starts)]
    features = np.concatenate([mean, *extremes], 1)
    error = (1 / (1 + np.exp(-np.clip(features @ net.head + net.offset, -40, 40))) - labels) / n
    d = error[:, None] * net.head
    doc = np.repeat(np.arange(n), count)
    d_chunk = (d[:, :FILTERS] / count[:, None])[doc]
    for k, value in enumerate(extremes, 1):
        at = chunk == value[doc]
        d_chunk = d_chunk + np.where(at, d[:, k * FILTERS : (k + 1) * FILTERS][doc] / np.maximum(1, np.add.reduceat(at.astype(np.float32), starts))[doc], 0)
    d_best = np.zeros_like(best)
    np.add.at(d_best, (winner, np.broadcast_to(columns, winner.shape)), d_chunk)
    d_best *= raw > 0
    place = np.arange(total)[:, None] * BLOCK + where
    g = np.zeros(WIDTH * 256 * FILTERS)
    for w in range(WIDTH):
        g += np.bincount((w * 256 + seen[w][place].astype(np.int64)).ravel() * FILTERS + np.tile(columns, total), d_best.ravel(), len(g))
    return [g.reshape(net.table.shape).astype(np.float32), d_best.sum(0), features.T @ error, np.array([error.sum()])]


def train(texts: list[bytes], labels: list[int], epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    net, rnd, y = Network.fresh(seed), np.random.default_rng(seed), np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.head[:] = 0
        if len(y):
            net.offset[:] = 4 if y[0] else -4
        return net
    first, second = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rnd.permutation(len(texts))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            step += 1
            for p, m, v, g in zip(net.params(), first, second, _gradients(net, [texts[i] for i in some], y[some]), strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_text_bytes: int = 1 << 20) -> Network:
    """Train on the `max_rows` rows of `labels` with the smallest id hash; only these reach the driver.

    Rows with longer texts than `max_text_bytes` are not learned from, which bounds the driver's share.
    """
    key, label = F.col(f"`{id_col}`").alias("_k"), F.col(f"`{label_col}`").alias("_y")
    docs = docs.select(key, F.col(f"`{text_col}`").alias("_t")).where(F.coalesce(F.octet_length("_t"), F.lit(0)) <= max_text_bytes)
    known = labels.select(key, label).where("_y is not null and _k is not null").groupBy("_k").agg(F.max("_y").alias("_y"))
    known = known.orderBy(F.xxhash64("_k"), "_k").limit(max_rows)
    rows = docs.join(F.broadcast(known), "_k").orderBy(F.xxhash64("_k"), "_t").limit(max_rows).select("_t", "_y").collect()
    return train([(r["_t"] or "").encode("utf-8", "surrogatepass") for r in rows], [int(r["_y"]) for r in rows])


def with_scores(docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score in `score_col` (in place of a column of that name)."""
    shared = docs.sparkSession.sparkContext.broadcast((net, net.pairs()))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        free_memory()
        net, pairs = shared.value
        out, held, n = [], [], 0

        def flush() -> None:
            out.append(score(net, pairs, held))

        for t in texts:
            held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
            n += len(held[-1])
            if n >= MAX_BYTES or len(held) >= 1000:
                flush()
                held, n = [], 0
        if held:
            flush()
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(score_col, scored(F.col(f"`{text_col}`")))


def keep_good(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches the threshold, with all columns of docs."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    return with_scores(rows, net).where(F.col("score") >= threshold).select("row.*")
