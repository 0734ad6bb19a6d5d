"""All maximal periodic runs of a text's words, by suffix arrays and longest previous factors.

A run is a stretch with smallest period q, of at least `MIN_LENGTH` words and two
periods, that no neighbouring word extends.  Texts with runs repeat six words
somewhere (a run of length m repeats m - q words at a distance of q), so texts without such a
repeat are done at once.  The others are taken in batches:

1. Prefix doubling names the blocks of 1, 2, 4, .. words, which sorts each text's suffixes and
   compares any two places forwards and backwards in a step a power of two.
2. Suffix array and LCP array give each place's longest previous factor and where that stands:
   places leave a list in suffix order from the text's end on, so a place's neighbours are
   the nearest suffixes that begin before it.
3. Longest previous factors cut the text into LZ blocks.
4. Main's extensions: at each border between blocks, of lengths A before and B behind it, the
   words around it are extended for each period up to B to the right and A + B to the left.
   Each run that isn't strictly inside a block touches a border at which it is found.
5. A run strictly inside a block also stands where the block was copied from: buckets of runs
   by their start are copied along, from left to right.

Every step works on whole texts; one text is one task's work, many texts share a batch.

Defined results: NULL counts as the empty text, which has no runs; words are what stands
between runs of ASCII white space; every row counts by itself, whatever its id; a NULL id is
never changed by `planted`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

MIN_LENGTH = 12
SEED = MIN_LENGTH // 2  # words that each run repeats
BATCH_WORDS = 200_000
_MIX, _FOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)  # odd constants of the published splitmix64

Run = tuple[int, int, int]  # start, end, period


def planted(key: object, words: list) -> list:
    """The words with a repeated stretch from some place on, for every tenth id."""
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers of the texts in which some `SEED` words in a row occur twice (or whose hashes say so)."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (doc[:n].astype(np.uint64) + np.uint64(1)) * _MIX
    key ^= key >> np.uint64(32)
    for k in range(SEED):
        key = (key ^ ids[k : n + k].astype(np.uint64)) * _FOLD
        key ^= key >> np.uint64(29)
        key *= _MIX
        key ^= key >> np.uint64(32)
    whole = np.flatnonzero(doc[:n] == doc[SEED - 1 :])
    order = whole[np.argsort(key[whole])]
    same = key[order[1:]] == key[order[:-1]]
    return np.unique(doc[order[1:][same]])


class Texts:
    """Several texts one after another: names of their blocks of 2^k words, and their suffix array.

    ids: words as numbers, no number in two texts; start, end: of the text that a place is in.
    """

    def __init__(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray):
        n = len(ids)
        self.start, self.end = start, end
        order = np.argsort(ids, kind="stable")
        first = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.names = [rank]
        width = 1
        while True:
            open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
            if not len(open_):
                break
            after = open_ + width
            inside = after < end[open_]
            then = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
            order = np.lexsort((then, rank[open_]))
            old, then = rank[open_][order], then[order]
            new_old = np.concatenate([[True], old[1:] != old[:-1]])
            new = new_old | np.concatenate([[True], then[1:] != then[:-1]])
            at = np.arange(len(order))
            shift = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_old, at, 0))
            rank = rank.copy()
            rank[open_[order]] = old + shift
            self.names.append(rank)
            width *= 2
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same; i < j, in one text, j may be its end."""
        i, j = i.copy(), j.copy()
        begin, end = j.copy(), self.end[i]
        for k in range(len(self.names) - 1, -1, -1):
            near = np.flatnonzero(j + (1 << k) <= end)
            near = near[self.names[k][i[near]] == self.names[k][j[near]]]
            i[near] += 1 << k
            j[near] += 1 << k
        return j - begin

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are the same; i < j, in one text, j may be its end."""
        i, j = i.copy(), j.copy()
        begin, start = i.copy(), self.start[j - 1]
        for k in range(len(self.names) - 1, -1, -1):
            near = np.flatnonzero(i - (1 << k) >= start)
            near = near[self.names[k][i[near] - (1 << k)] == self.names[k][j[near] - (1 << k)]]
            i[near] -= 1 << k
            j[near] -= 1 << k
        return begin - i

    def previous_factors(self) -> tuple[list[int], list[int]]:
        """The longest previous factor of each place, and where it stands."""
        n, sa = len(self.suffixes), self.suffixes
        lcp = np.zeros(n + 1, np.int64)
        a, b = np.minimum(sa[1:], sa[:-1]), np.maximum(sa[1:], sa[:-1])
        both = np.flatnonzero(self.start[a] == self.start[b])
        lcp[1:n][both] = self.forwards(a[both], b[both])
        rank = np.empty(n, np.int64)
        rank[sa] = np.arange(n)
        before, after, shared = list(range(-1, n)), list(range(1, n + 2)), lcp.tolist()  # by suffix order; n ends the list
        place, ranks = sa.tolist(), rank.tolist()
        longest, source = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            r = ranks[i]
            p, x = before[r], after[r]
            left, right = shared[r], shared[x]
            if left >= right:
                if left:
                    longest[i], source[i] = left, place[p]
                shared[x] = right
            else:
                longest[i], source[i] = right, place[x]
                shared[x] = left
            if p >= 0:
                after[p] = x
            before[x] = p
        return longest, source


def lz_blocks(longest: list[int], start: int, end: int) -> list[int]:
    """Where the blocks of the text from start to end begin, and its end."""
    out = [start]
    while out[-1] < end:
        out.append(out[-1] + max(1, longest[out[-1]]))
    return out


def _at_borders(texts: Texts, borders: list[list[int]]) -> np.ndarray:
    """Distinct (start, end, least period) of the stretches that Main's extensions give."""
    at, before, behind = [], [], []
    for cuts in borders:
        sizes = np.diff(cuts)
        at.append(np.array(cuts[1:]))
        before.append(sizes)
        behind.append(np.append(sizes[1:], 0))
    b, left, right = np.concatenate(at), np.concatenate(before), np.concatenate(behind)
    room = b - texts.start[b - 1]

    def periods(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.repeat(b, n)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + 1

    out = []
    for border, p, to_right in ((*periods(right), True), (*periods(np.minimum(left + right, room)), False)):
        i, j = (border, border + p) if to_right else (border - p, border)
        ahead, back = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        own = border - (not to_right)  # a place inside the text: a border on the right side may be the text's end
        some = np.flatnonzero(j < texts.end[own])
        ahead[some] = texts.forwards(i[some], j[some])
        some = np.flatnonzero(i > texts.start[own])
        back[some] = texts.backwards(i[some], j[some])
        found = (ahead + back >= p) & (ahead + back + p >= MIN_LENGTH)
        out.append(np.stack([i - back, j + ahead, p], 1)[found])
    every = np.concatenate(out)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    fresh = np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(1)]) if len(every) else np.zeros(0, bool)
    return every[fresh]


def _copied(found: dict[int, list[tuple[int, int]]], longest: list[int], source: list[int], cuts: list[int]) -> None:
    """Add the runs strictly inside blocks: copies of those where the block was copied from."""
    for b, e in zip(cuts, cuts[1:], strict=False):
        if e - b < MIN_LENGTH + 2 or not longest[b]:
            continue
        shift = b - source[b]
        for i in range(b + 1, e - MIN_LENGTH):
            for end, period in found.get(i - shift, ()):
                if end + shift < e:
                    found.setdefault(i, []).append((end + shift, period))


def runs_of(texts: list[np.ndarray]) -> list[list[Run]]:
    """All runs of each text (words as numbers, which texts may share), by start, then period."""
    texts = [np.unique(t, return_inverse=True)[1] for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    start, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    out: list[list[Run]] = [[] for _ in texts]
    if not len(start):
        return out
    whole = Texts(np.concatenate(texts) + start, start, end)
    longest, source = whole.previous_factors()
    cuts = [lz_blocks(longest, e - n, e) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True) if n]
    found: dict[int, list[tuple[int, int]]] = {}
    for s, e, p in _at_borders(whole, cuts).tolist():
        found.setdefault(s, []).append((e, p))
    for c in cuts:
        _copied(found, longest, source, c)
    for s in sorted(found):
        k = int(np.searchsorted(ends, s, "right"))
        lo = int(ends[k] - sizes[k])
        out[k] += sorted(((s - lo, e - lo, p) for e, p in found[s]), key=lambda r: r[2])
    return out


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that stand in a run behind its first period."""
    keep, upto = [], 0
    for a, b in sorted((s + p, e) for s, e, p in runs):
        if a > upto:
            keep += words[upto:a]
        upto = max(upto, b)
    return keep + words[upto:]


def _batches(rows: Iterator[tuple[object, str | None]], repeat: Callable[[object, list], list] | None) -> Iterator[tuple[list[list[bytes]], list[list[Run]]]]:
    """Words and runs of the rows, some at a time."""
    number: dict[bytes, int] = {}
    fresh = count()
    held: list[list[bytes]] = []
    ids: list[np.ndarray] = []
    n = 0

    def done() -> tuple[list[list[bytes]], list[list[Run]]]:
        runs: list[list[Run]] = [[] for _ in held]
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        some = _repeats(np.concatenate(ids), doc)
        for k, r in zip(some.tolist(), runs_of([ids[k] for k in some.tolist()]), strict=True):
            runs[k] = r
        return held, runs

    for key, text in rows:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if repeat:
            words = repeat(key, words)
        for w in words:
            if w not in number:
                number[w] = next(fresh)
        held.append(words)
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        n += len(words)
        if n >= BATCH_WORDS or len(held) >= 5_000:
            yield done()
            held, ids, n = [], [], 0
            number.clear()
    if held:
        yield done()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: Callable[[object, list], list] | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), digests of all runs and of the collapsed text.

    runs_sha256 covers a line `start,length,period` for each run.  repeat: changes (id, words) before anything else.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    schema = StructType([rows.schema.fields[0], *(StructField(x, LongType()) for x in numbers), *(StructField(x, StringType()) for x in ("runs_sha256", "collapsed_sha256"))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, done = batch.column(0), batch.column(1), 0
            for held, runs in _batches(((k.as_py(), t.as_py()) for k, t in zip(keys, texts, strict=True)), repeat):
                out = [_summary(w, r) for w, r in zip(held, runs, strict=True)]
                columns = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([keys.slice(done, len(held)), *columns], schema.names)
                done += len(held)

    return rows.mapInArrow(found, schema)


def _summary(words: list[bytes], runs: list[Run]) -> tuple:
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
    rest = hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
    best = min(((s - e, s, p) for s, e, p in runs), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), rest


def collapse_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the repetitions of each run cut out of the text, its words joined by one space."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for held, runs in _batches(((None, t.as_py()) for t in texts), None):
            out += [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(held, runs, strict=True)]
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, F.when(F.col(f"`{text_col}`").isNotNull(), cut(F.col(f"`{text_col}`"))))
