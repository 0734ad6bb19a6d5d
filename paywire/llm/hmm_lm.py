"""Hidden Markov language model with exact sequence likelihoods.

Documents are packed once into blocks: a block's distinct words, their counts in
its training documents, and its texts as numbers of those words.  Word counts over
the whole corpus are sums of (word, count) rows, each word already summed within its
block and then within its task, so a word that every block holds costs no more than
another; the counts come back to the blocks by joins that adaptive execution can split.
The texts themselves never shuffle: blocks are bucketed, and their counts come to them.

The latent states emit one of `CLASSES` word classes (a hash of the word); within its
class a word is drawn by its corpus count, so the counts grow with the corpus while
the states' tables stay of one size:

    P(word | state) = P(class | state) * (c - D) / (C_class + D)

A word without a count takes the class's one unseen share, D * (V_class + 1) /
(C_class + D), so a class's shares sum to one; D is the usual absolute discount,
n1 / (n1 + 2 * n2) over the corpus.  Baum-Welch starts from states drawn around the
corpus's class shares and makes up to `passes` passes over all training documents, until
a pass raises the likelihood by less than `settled` of itself.  In a pass each task sums its
expected counts and sends those of the classes it met, cut into segments; those of over `ONE_STEP` tasks are added
up in two steps, first by segment and a share of the tasks, so that no task gets more than about the square root of
the number of tasks, then by segment.  Only the new parameters reach the driver.  Scores come from the scaled forward recursion.

Defined results: NULL counts as the empty text, whose only token is the end;
repeated documents are learned from and scored each; with no training documents
all words are unseen; a training text of over `TRAIN_CUT` tokens is learned from in
pieces of that length, none left out (its score is exact); ids keep their type; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from paywire.llm.blocks import PLACE_SHIFT, with_messages
from paywire.llm.common import LOWER_TABLE, arrow_batches, bucket_count, bucketed, saved

CLASSES, STATES, SEGMENTS = 1 << 15, 8, 64
SEGMENT = CLASSES // SEGMENTS
ONE_STEP = 256  # tasks whose sums are added up in one step: 16 KB each a segment
BLOCK_TOKENS, BLOCK_BYTES = 2_000_000, 24 << 20
TRAIN_CUT = 1_000
BATCH_TOKENS = 500_000
END = b""  # no word is empty


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split(), END]


def word_class(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % CLASSES


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """place, block, words, counts (in training documents), classes, doc_ids, held, lengths, ids; bucketed by place."""
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), held_out.alias("held"), F.col(f"`{text_col}`").alias("t"))
    kinds = {"place": LongType(), "block": LongType(), "words": ArrayType(BinaryType()), "counts": ArrayType(LongType()), "classes": BinaryType(), "doc_ids": ArrayType(rows.schema["k"].dataType), "held": ArrayType(BooleanType()), "lengths": ArrayType(LongType()), "ids": BinaryType()}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << PLACE_SHIFT
        number, keys, held, ids, n, size = _Numbers(), [], [], [], 0, 0

        def done(key_type: pa.DataType) -> pa.RecordBatch:
            counts = np.zeros(len(number), np.int64)
            for h, x in zip(held, ids, strict=True):
                if not h:
                    np.add.at(counts, x, 1)
            classes = np.fromiter(map(word_class, number), "<u2", len(number)).tobytes()
            row = [block >> PLACE_SHIFT, block, list(number), counts, classes, keys, held, [len(x) for x in ids], np.concatenate(ids).astype("<u4").tobytes()]
            types = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.list_(key_type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], list(kinds))

        for batch in batches:
            for key, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                words = tokens(text)
                keys.append(key)
                held.append(bool(out))
                ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                n, size = n + len(words), size + len(text or "")
                if n >= BLOCK_TOKENS or size >= BLOCK_BYTES:
                    yield done(batch.schema.field(0).type)
                    block, number, keys, held, ids, n, size = block + 1, _Numbers(), [], [], [], 0, 0
        if keys:
            yield done(batch.schema.field(0).type)

    schema = StructType([StructField(x, t) for x, t in kinds.items()])
    with arrow_batches(docs.sparkSession, 1_000):
        return bucketed(rows.mapInArrow(packed, schema), "hmm-blocks", "place", bucket_count(rows))


def corpus_counts(packed: DataFrame) -> DataFrame:
    """word, c: each word's tokens in all training documents, where there are any."""
    each = packed.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).where("x.counts > 0")
    return saved(each.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("c")), "hmm-words")


def block_counts(packed: DataFrame, corpus: DataFrame) -> DataFrame:
    """block, corpus: the corpus count of each of its words, in their order, as little-endian integers."""
    each = packed.select("block", F.posexplode("words").alias("pos", "word"))
    known = each.join(corpus, "word", "left").select("block", "pos", F.coalesce("c", F.lit(0).cast("long")).alias("c"))
    dealt = known.repartition("block").sortWithinPartitions("block", "pos")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, c = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.concatenate(c).astype("<i8").tobytes()], pa.binary())], ["block", "corpus"])

        for batch in batches:
            block, count = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if c and block[a] != now:
                    yield done()
                    c = []
                now = int(block[a])
                c.append(count[a:b].copy())
        if c:
            yield done()

    return saved(dealt.mapInArrow(gathered, "block long, corpus binary"), "hmm-counts")


PARTS = "share int, segment int, at binary, values binary"  # classes of a segment, and a row of values each


def _added(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows of one (share, segment) as one, added up in double precision."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for share, segment, at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            at = np.frombuffer(at.as_py(), "<u2")
            x = np.frombuffer(raw.as_py(), kind).reshape(len(at), -1)
            total.setdefault((share, segment), np.zeros((SEGMENT, x.shape[1])))[at] += x
    for (share, segment), x in total.items():
        at = np.flatnonzero(x.any(1))
        if len(at):
            yield _parts(share, [(segment, at, x[at])], "<f8")


def in_shares(parts: DataFrame, tasks: int, kind: str) -> DataFrame:
    """PARTS in double precision of one share for each segment, from those of `tasks` tasks: each share adds up about the square root of them."""
    shares = max(1, math.isqrt(tasks))
    few = parts.withColumn("share", F.pmod("share", F.lit(shares)))
    return few.repartition(min(4 * shares, 2_000), "share", "segment").sortWithinPartitions("share", "segment").mapInArrow(partial(_added, kind=kind), PARTS)


def _summed(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Sums by segment of PARTS rows, [SEGMENT, values]."""
    tasks = bucket_count(parts)
    if tasks > ONE_STEP:
        parts, kind = in_shares(parts, tasks, kind), "<f8"
    whole = parts.withColumn("share", F.lit(0)).repartition(16, "segment").mapInArrow(partial(_added, kind=kind), PARTS)
    out: dict[int, np.ndarray] = {}
    for r in whole.collect():
        at = np.frombuffer(r["at"], "<u2")
        x = np.frombuffer(r["values"], "<f8").reshape(len(at), -1)
        out[r["segment"]] = np.zeros((SEGMENT, x.shape[1]))
        out[r["segment"]][at] = x
    return out


def _parts(share: int, rows: list[tuple[int, np.ndarray, np.ndarray]], kind: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([share] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].astype("<u2").tobytes() for r in rows], pa.binary()), pa.array([r[2].astype(kind).tobytes() for r in rows], pa.binary())], ["share", "segment", "at", "values"])


def _emit(table: np.ndarray, rest: np.ndarray, kind: str) -> pa.RecordBatch:
    """PARTS of a [CLASSES, k] table, without classes that are all zero; `rest` as segment -1, a value a row."""
    met = np.flatnonzero(table.any(1))
    cuts = np.searchsorted(met, np.arange(SEGMENTS + 1) * SEGMENT)
    rows = [(k, met[a:b] - k * SEGMENT, table[met[a:b]]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
    return _parts(TaskContext.get().partitionId(), [*rows, (-1, np.arange(len(rest)), rest)], kind)


def _table(found: dict[int, np.ndarray], width: int) -> np.ndarray:
    return np.concatenate([found.get(k, np.zeros((SEGMENT, width))) for k in range(SEGMENTS)])


def class_totals(corpus: DataFrame) -> tuple[np.ndarray, float]:
    """[CLASSES, 2], the training tokens and distinct training words of each class; and the discount."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, few = np.zeros((CLASSES, 2)), np.zeros(2)
        for batch in batches:
            c = batch.column(1).to_numpy()
            g = np.fromiter(map(word_class, batch.column(0).to_pylist()), np.int64, len(c))
            out[:, 0] += np.bincount(g, c, CLASSES)
            out[:, 1] += np.bincount(g, minlength=CLASSES)
            few += [(c == 1).sum(), (c == 2).sum()]
        yield _emit(out, few, "<f8")

    found = _summed(corpus.select("word", "c").mapInArrow(totals, PARTS), "<f8")
    ones, twos = found.get(-1, np.zeros((2, 1)))[:2, 0]
    discount = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5
    return _table(found, 2), discount


@dataclass
class Hmm:
    start: np.ndarray  # [STATES]
    move: np.ndarray  # [STATES, STATES]
    emit: np.ndarray  # [CLASSES, STATES]: P(class | state)


def _batches(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Sequence numbers by falling length, BATCH_TOKENS or so at a time."""
    order = np.argsort(-lengths, kind="stable")
    upto = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_TOKENS, "right")))
        yield order[at:end]
        at = end


def log_likelihoods(model: Hmm, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural logarithms of P(class sequence) by the scaled forward recursion; sequences stand one after another."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    out = np.zeros(len(lengths))
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    for some in _batches(lengths):
        at, live = starts[some], _live(lengths[some])
        alpha = model.start.astype(np.float32) * emit[classes[at]]
        total = np.zeros(len(some))
        for t, m in enumerate(live):
            if t:
                alpha = (alpha[:m] @ move) * emit[classes[at[:m] + t]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:m] += np.log(scale)
        out[some] = total
    return out


def _live(lengths: np.ndarray) -> list[int]:
    """How many of the sequences (by falling length) reach each step."""
    ends = np.bincount(lengths)[1:]
    return (len(lengths) - np.concatenate([[0], np.cumsum(ends)[:-1]])).tolist()


def expected_counts(model: Hmm, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch expectations: of starts [STATES], moves [STATES, STATES] and emissions [CLASSES, STATES]; and the log-likelihood."""
    begun, moved, made, likelihood = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)), 0.0
    if not len(lengths):
        return begun, moved, made, likelihood
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    cut = [(s + k, min(TRAIN_CUT, n - k)) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True) for k in range(0, n, TRAIN_CUT)]
    starts, lengths = np.array([c[0] for c in cut]), np.array([c[1] for c in cut])
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    back = np.ascontiguousarray(move.T)
    for some in _batches(lengths):
        at, live = starts[some], _live(lengths[some])
        where = np.concatenate([at[:m] + t for t, m in enumerate(live)])
        shown = classes[where]
        e = emit[shown]
        place = np.concatenate([[0], np.cumsum(live)])
        alpha = np.empty_like(e)
        scale = np.empty(len(e), np.float32)
        for t, m in enumerate(live):
            a, b = place[t], place[t + 1]
            x = (alpha[place[t - 1] : place[t - 1] + m] @ move if t else model.start.astype(np.float32)) * e[a:b]
            scale[a:b] = x.sum(1)
            alpha[a:b] = x / scale[a:b, None]
        beta = np.ones((live[-1], STATES), np.float32)
        gamma = alpha  # overwritten from the end
        for t in range(len(live) - 1, 0, -1):
            a, b, before, m = place[t], place[t + 1], place[t - 1], live[t]
            ahead = e[a:b] * beta / scale[a:b, None]
            gamma[a:b] *= beta
            moved += move * (alpha[before : before + m].T @ ahead)
            beta = np.ones((live[t - 1], STATES), np.float32)
            beta[:m] = ahead @ back
        gamma[: live[0]] *= beta
        begun += gamma[: live[0]].sum(0)
        likelihood += float(np.log(scale, dtype=np.float64).sum())
        for k in range(STATES):
            made[:, k] += np.bincount(shown, gamma[:, k], CLASSES)
    return begun, moved, made, likelihood


def reestimated(begun: np.ndarray, moved: np.ndarray, made: np.ndarray, prior: np.ndarray) -> Hmm:
    """The M-step; a state's emissions lean on the corpus's class shares with as many tokens as it has kinds of class."""
    weight = np.minimum(made, 1).sum(0) + 1
    return Hmm((begun + 1) / (begun + 1).sum(), (moved + 1) / (moved + 1).sum(1, keepdims=True), (made + weight * prior[:, None]) / (made.sum(0) + weight))


def first_model(prior: np.ndarray, seed: int = 3) -> Hmm:
    """States that like to stay, each drawn around the corpus's class shares."""
    emit = prior[:, None] * (np.random.default_rng(seed).gamma(1.0, 1.0, (CLASSES, STATES)) + 0.1)
    return Hmm(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES), emit / emit.sum(0))


def score_documents(docs: DataFrame, held_out: Column, passes: int = 12, settled: float = 1e-3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    held_out: true where a document must not be learned from.
    """
    spark = docs.sparkSession
    packed = blocks(docs, held_out, id_col, text_col)
    corpus = corpus_counts(packed)
    totals, discount = class_totals(corpus)
    n_train, n_words = int(totals[:, 0].sum()), int(totals[:, 1].sum())
    seat, unseen = totals[:, 0] + discount, discount * (totals[:, 1] + 1)
    prior = seat / seat.sum()

    def gather(shared) -> DataFrame:
        def expectations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, sums = shared.value, None
            for batch in batches:
                for row in range(batch.num_rows):  # one block at a time
                    classes, held, lengths, ids = (c[row].as_py() for c in batch.columns)
                    sequence, lengths = np.frombuffer(classes, "<u2")[np.frombuffer(ids, "<u4")], np.array(lengths)
                    learned = ~np.array(held, bool)
                    found = expected_counts(model, sequence[np.repeat(learned, lengths)], lengths[learned])
                    sums = found if sums is None else tuple(a + b for a, b in zip(sums, found, strict=True))
            if sums is not None:
                yield _emit(sums[2], np.concatenate([sums[0], sums[1].ravel(), [sums[3]]]), "<f4")

        return packed.select("classes", "held", "lengths", "ids").mapInArrow(expectations, PARTS)

    model, before = first_model(prior), -np.inf
    for _ in range(passes if n_train else 0):
        found = _summed(gather(spark.sparkContext.broadcast(model)), "<f4")
        begun, moved, (likelihood, *_) = np.split(found[-1][:, 0], [STATES, STATES + STATES**2])
        model = reestimated(begun, moved.reshape(STATES, STATES), _table(found, STATES), prior)
        if likelihood - before < settled * abs(likelihood):
            break
        before = likelihood
    shared = spark.sparkContext.broadcast((model, seat, unseen))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seat, unseen = shared.value
        floor = np.log10(n_train + 0.5 * (n_words + 1))
        for batch in batches:
            for row in range(batch.num_rows):  # one block at a time
                corpus, classes, _, held, lengths, ids = (None if k == 2 else c[row].as_py() for k, c in enumerate(batch.columns))
                keys = batch.column(2)[row].values
                c, g, at, lengths = np.frombuffer(corpus, "<i8"), np.frombuffer(classes, "<u2"), np.frombuffer(ids, "<u4"), np.array(lengths)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                base = np.add.reduceat((np.log10(c + 0.5) - floor)[at], starts)
                within = np.add.reduceat(np.log10(np.where(c > 0, c - discount, unseen[g]) / seat[g])[at], starts)
                known = np.add.reduceat((c > 0).astype(np.int64)[at], starts)
                latent = log_likelihoods(model, g[at], lengths) / np.log(10)
                columns = [keys, pa.array(held, pa.bool_()), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), n_train)), pa.array(base), pa.array(latent + within)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    whole = with_messages(packed.drop("words", "counts"), block_counts(packed, corpus)).select("corpus", "classes", "doc_ids", "held", "lengths", "ids")
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return whole.mapInArrow(scores, schema)
