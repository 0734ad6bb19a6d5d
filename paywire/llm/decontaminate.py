"""Benchmark decontamination: an FM-index per shard of the training documents.

A task cuts each batch of documents that it is handed into shards of at most about
`shard_words` words, so an index is never larger than that or one document.  A shard's
text is its word ids; words that no benchmark phrase holds become separators, and
runs of benchmark words shorter than the shortest phrase are left out, as no
phrase fits there.  Over that text it builds a suffix array, the Burrows-Wheeler
transform, a wavelet matrix with ranks and suffix positions sampled every
`SAMPLE` words and at run starts.  All phrases are searched backwards at once;
each occurrence is located by stepping to a sampled position; the spans are
merged and mapped back to documents.

The phrases are a stated query set: they are broadcast in blocks of at most
`block_phrases`, one pass over the documents a block.

Defined results: NULL or empty texts have no words and no hits; benchmark items
without words are never hit; an item of fewer words than the window is one
phrase; NULL item ids count and are named by the empty string; repeated item ids count once; repeated
documents are judged each; empty tables give no hits or an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paywire.llm.blocks import blocks_of, rows_but, with_messages
from paywire.llm.common import arrow_batches, free_memory, saved

SAMPLE = 32
WINDOW = 13

_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of words in lower case; every other ASCII byte is a space.
_WORDS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Phrases:
    """Distinct phrases of a block as word ids (from 1), and the items that each stands for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.items)}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i : i + window]), set()).add(place[name])
        self.length = np.array([len(p) for p in found], np.int64)
        self.words = np.zeros((len(found), int(self.length.max(initial=0))), np.int64)
        for i, p in enumerate(found):
            self.words[i, : len(p)] = p
        self.owners = [np.array(sorted(x), np.int64) for x in found.values()]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; each 0 is a separator of its own, so no comparison passes one."""
    n = len(text)
    zeros = text == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, text + zeros.sum()).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank[order], order)
    step = 1
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = _ranks(key[order], order)
        step *= 2
    return order


def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    return rank


class Bits:
    """A bit array with ranks: a count before each 64 bits, and popcounts within."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        each = np.bitwise_count(self.words)
        self.before = (np.cumsum(each, dtype=np.int64) - each).astype(np.int32)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask).astype(np.int64)


class WaveletMatrix:
    """Ranks of symbols and access to them in about 1.5 bits for each bit of a symbol, for arrays of symbols and places."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = range(max(1, int(n_symbols).bit_length()))[::-1]
        self.bits, self.zeros, row = [], [], symbols
        for level in self.levels:
            bit = (row >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(row) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        every = np.arange(n_symbols + 1)
        self.start = self._descend(every, np.zeros_like(every))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bits, zeros, level in zip(self.bits, self.zeros, self.levels, strict=True):
            ones = bits.rank(i)
            i = np.where((c >> level) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c among the first i."""
        return self._descend(c, i) - self.start[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its occurrences before."""
        c = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one, ones = bits[i], bits.rank(i)
            c = c << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.start[c]


class FMIndex:
    """Over word ids with 0 as separator; the text must end with 0.  Of the transformed text only the wavelet matrix is kept."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_array(text)
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        self.wavelet = WaveletMatrix(bwt, n_symbols)
        sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.sampled = Bits(sampled)
        self.position = order[sampled]
        self.n = len(text)

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase: one backward step for all phrases at a time."""
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        for back in range(1, words.shape[1] + 1):
            live = np.flatnonzero((back <= length) & (lo < hi))
            if not len(live):
                break
            c = words[live, length[live] - back]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            c, before = self.wavelet.access(rows[walking])
            rows[walking] = self.first[c] + before
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.position[self.sampled.rank(rows)] + steps


def shard_hits(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[list[int], list[int], list[int]]]:
    """Of each document (word ids, 0 for words of no phrase): merged span starts, span ends, item numbers."""
    none: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in docs]
    if not docs or not len(phrases.words):
        return none
    text = np.concatenate([x for d in docs for x in (d, [0])]).astype(np.int64)
    start = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    zero = np.flatnonzero(np.concatenate([[0], text]) == 0)  # ends of runs, and one before the text
    run = np.diff(zero) - 1
    keep = run >= phrases.length.min()
    kept_words = np.repeat(keep, run + 1)
    if not kept_words.any():
        return none
    origin = np.flatnonzero(kept_words)
    small = text[origin]
    index = FMIndex(small, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.words, phrases.length)
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    at = index.locate(np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()))
    begin, end = origin[at], origin[at] + phrases.length[which]
    edge = np.bincount(begin, minlength=len(text) + 1) - np.bincount(end, minlength=len(text) + 1)
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turns = np.flatnonzero(covered[1:] != covered[:-1])
    doc_of = np.searchsorted(start, turns[::2], "right") - 1
    for d, a, b in zip(doc_of.tolist(), turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        none[d][0].append(a - int(start[d]))
        none[d][1].append(b - int(start[d]))
    pairs = np.unique((np.searchsorted(start, begin, "right") - 1) * np.int64(len(lo)) + which)
    items: dict[int, set[int]] = {}
    for pair in pairs.tolist():
        items.setdefault(pair // len(lo), set()).update(phrases.owners[pair % len(lo)].tolist())
    return [(a, b, sorted(items.get(i, ()))) for i, (a, b, _) in enumerate(none)]


HITS = "n_words long, starts array<int>, ends array<int>, items array<string>"


def _pass(docs: DataFrame, phrases: Phrases, key_cols: list[str], text_col: str, shard_words: int) -> DataFrame:
    """key_cols and HITS of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    rows = docs.select(*key_cols, F.col(f"`{text_col}`"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(HITS).fields])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        phrases = shared.value
        get = phrases.vocabulary.get
        for batch in batches:
            texts, done = batch.column(batch.num_columns - 1), 0
            while done < len(texts):
                docs, held, first = [], 0, done
                while done < len(texts) and held < shard_words:
                    words = words_of(texts[done].as_py())
                    docs.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
                    held += len(words) + 1
                    done += 1
                found = shard_hits(docs, phrases)
                columns = [c.slice(first, done - first) for c in batch.columns[:-1]]
                columns += [
                    pa.array([len(d) for d in docs], pa.int64()),
                    pa.array([x[0] for x in found], pa.list_(pa.int32())),
                    pa.array([x[1] for x in found], pa.list_(pa.int32())),
                    pa.array([[phrases.items[i] for i in x[2]] for x in found], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_words", "starts", "ends", "items"])

    return rows.mapInArrow(hits, schema)


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_phrases: int) -> Iterator[Phrases]:
    block, held = [], 0
    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"), F.col(text_col).alias("t")).toLocalIterator():
        if words := words_of(row["t"]):
            block.append((row["k"], words))
            held += max(1, len(words) - window + 1)
            if held >= block_phrases:
                yield Phrases(block, window)
                block, held = [], 0
    if block:
        yield Phrases(block, window)


def _hits_of_blocks(rows: DataFrame, blocks: Iterator[Phrases], text_col: str, shard_words: int) -> DataFrame:
    """block, pos, n_words, starts, ends, items of the rows of a `blocks_of` table that any phrase hits; only these shuffle, without their texts."""
    each = rows.select("block", F.posexplode(F.col(f"row.`{text_col}`")).alias("pos", "text"))
    with arrow_batches(rows.sparkSession, 1_000):
        passes = [saved(_pass(each, b, ["block", "pos"], "text", shard_words).where(F.size("starts") > 0), "hits") for b in blocks]
    every = passes[0]
    for x in passes[1:]:
        every = every.unionByName(x)
    if len(passes) == 1:
        return every
    merged = every.groupBy("block", "pos").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans = F.expr("""aggregate(array_sort(spans), cast(array() as array<struct<starts:int,ends:int>>), (done, x) ->
        if(size(done) > 0 and element_at(done, -1).ends >= x.starts,
           concat(slice(done, 1, size(done) - 1), array(named_struct('starts', element_at(done, -1).starts, 'ends', greatest(element_at(done, -1).ends, x.ends)))),
           concat(done, array(x))))""")
    return merged.withColumn("spans", spans).select("block", "pos", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")


_DENSE = "array<struct<starts:array<int>,ends:array<int>,items:array<string>>>"


def _with_hits(rows: DataFrame, hits: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """key_cols and HITS of every row of a `blocks_of` table, from those of the rows that are hit."""

    @F.arrow_udf(_DENSE)
    def by_place(found: pa.Array) -> pa.Array:
        out = []
        for some in found.to_pylist():
            dense = [None] * (1 + max(x["pos"] for x in some))
            for x in some:
                dense[x.pop("pos")] = x
            out.append(dense)
        return pa.array(out, pa.list_(pa.struct([("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])))

    @F.arrow_udf("long")
    def n_words(texts: pa.Array) -> pa.Array:
        return pa.array([len(words_of(t.as_py())) for t in texts], pa.int64())

    sent = hits.groupBy("block").agg(F.collect_list(F.struct("pos", "starts", "ends", "items")).alias("found"))
    both = with_messages(rows.select("place", "block", "row"), saved(sent.select("block", by_place("found").alias("found")), "hits"), "left")
    each = both.select(F.explode(F.arrays_zip("row", F.coalesce("found", F.array().cast(_DENSE)).alias("hit"))).alias("x"))
    none = lambda name, kind: F.coalesce(F.col(f"x.hit.{name}"), F.array().cast(f"array<{kind}>")).alias(name)
    keys = [F.col(f"x.row.`{c}`").alias(c) for c in key_cols]
    return each.select(*keys, n_words(F.col(f"x.row.`{text_col}`")).alias("n_words"), none("starts", "int"), none("ends", "int"), none("items", "string"))


def find_hits(docs: DataFrame, benchmark: DataFrame, key_cols: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = 300_000, block_phrases: int = 500_000) -> DataFrame:
    """key_cols (none may be named like the others), n_words, starts, ends (merged spans of word positions, end exclusive) and items (distinct, sorted as strings).

    Phrases of several blocks take a pass over the documents each, which are written once in blocks of rows; what the
    passes find meets them there.
    """
    blocks = phrase_blocks(benchmark, item_id, item_text, window, block_phrases)  # one at a time on the driver
    first, second = next(blocks, None) or Phrases([], window), next(blocks, None)
    if second is None:
        return _pass(docs, first, key_cols, text_col, shard_words)
    rows = blocks_of(docs.select(F.struct(*(F.col(f"`{c}`") for c in dict.fromkeys([*key_cols, text_col]))).alias("row")))
    return _with_hits(rows, _hits_of_blocks(rows, chain([first, second], blocks), text_col, shard_words), key_cols, text_col)


def n_hit_words():
    return F.coalesce(F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (s, x) -> s + x)"), F.lit(0).cast("long"))


def contaminated(n_hit, n_words):
    """The contamination rule: a hit, and at least one word in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _whole_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows as one struct, so that no column's name can clash with ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("_text"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = 300_000, block_phrases: int = 500_000) -> DataFrame:
    """The documents that the rule leaves, with all their columns; only the places of the others move."""
    rows = blocks_of(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))
    blocks = phrase_blocks(benchmark, item_id, item_text, window, block_phrases)
    hits = _hits_of_blocks(rows, chain([next(blocks, None) or Phrases([], window)], blocks), text_col, shard_words)
    return rows_but(rows, hits.where(contaminated(n_hit_words(), F.col("n_words"))).select("block", "pos"))


def cut_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs with the words of each merged span, and what stands between them, cut out of the text."""
    found = find_hits(_whole_rows(docs, text_col), benchmark, ["row"], "_text", **how)

    @F.udf("string")
    def cut(text: str | None, starts: list[int], ends: list[int]) -> str | None:
        if not starts:
            return text
        raw = text.encode("utf-8", "surrogatepass")
        flags = np.concatenate([[False], np.frombuffer(raw.translate(_WORDS), np.uint8) != 0x20, [False]])
        edges = np.flatnonzero(flags[1:] != flags[:-1])
        out, at = [], 0
        for a, b in zip(starts, ends, strict=True):
            out.append(raw[at : edges[2 * a]])
            at = edges[2 * b - 1]
        return (b"".join(out) + raw[at:]).decode("utf-8", "surrogatepass")

    done = found.withColumn("row", F.col("row").withField(f"`{text_col}`", cut(f"row.`{text_col}`", "starts", "ends")))
    return done.select("row.*")
