"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with one blank between runs.  For each order a
sorted array of n-gram hashes holds the interpolated probabilities of all
languages side by side, and a second one the back-off weights of contexts; a
lookup goes by the leading 16 bits of the hash, for the grams not found above.  Labelled texts often quote another
language, and a conditional model learns a language well from few quotes, so
training pieces that a bigram model gives to another language are left out.  The
language with the lowest cross-entropy a character wins.  A temperature, fitted
on a held part of the training rows, turns cross-entropies into a probability; a
text is accepted unless its best cross-entropy is beyond the language's calibrated limit.

Models are trained on the driver on at most `max_rows` rows a language, those with
the smallest hash of their id; whole texts count.

Defined results: NULL texts and texts without letters are `und` with score 0; rows
without a language are not learned from; with no training rows all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = 4
PIECE = 200_000  # characters scored at a time
CUT = 240  # characters of a training piece
_ODD = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point its lower-case letter, or 0."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def codes(text: str | None) -> np.ndarray:
    """Letters with a 0 before, between and after runs; empty if there is none."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    c = _letters()[raw]
    if not c.any():
        return np.zeros(0, np.uint32)
    c = np.concatenate([[0], c, [0]]).astype(np.uint32)
    return c[(c != 0) | (np.concatenate([[1], c[:-1]]) != 0)]


def grams(c: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that end at each position from ORDER - 1 on."""
    key = np.full(len(c) - ORDER + 1, order, np.uint64)
    for k in range(ORDER - order, ORDER):
        key = (key ^ c[k : len(c) - ORDER + 1 + k]) * _ODD
        key ^= key >> np.uint64(29)
    return key


def contexts(c: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the order - 1 characters before each of these positions."""
    key = np.full(len(c) - ORDER + 1, 100 + order, np.uint64)
    for k in range(ORDER - order, ORDER - 1):
        key = (key ^ c[k : len(c) - ORDER + 1 + k]) * _ODD
        key ^= key >> np.uint64(29)
    return key


def padded(c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(ORDER - 2, np.uint32), c])


class Hashes:
    """A sorted array of hashes, and where each leading 16 bits begin in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.starts = np.searchsorted(keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int32)
        ends = np.append(self.starts[1:], len(keys))
        self.longest = int((ends - self.starts).max())

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and whether they are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        last = len(self.keys) - 1
        at = np.minimum(self.starts[(keys >> np.uint64(48)).astype(np.int64)], last)
        hit = self.keys[at] == keys
        left = np.flatnonzero(~hit)
        for _ in range(self.longest - 1):
            at[left] = np.minimum(at[left] + 1, last)
            found = self.keys[at[left]]
            hit[left] = found == keys[left]
            left = left[found < keys[left]]
            if not len(left):
                break
        return at, hit


@dataclass
class Model:
    languages: list[str]
    grams: list[Hashes]  # by order
    logs: list[np.ndarray]  # by order, [grams, languages]
    contexts: list[Hashes]
    backoff: list[np.ndarray]  # by order, [contexts, languages], logarithms
    floor: np.ndarray  # log probability of a character that was never seen
    temperature: float = 1.0
    limit: np.ndarray | None = None

    def position_logs(self, c: np.ndarray) -> np.ndarray:
        """[positions, languages] log2 probabilities of each character after its context."""
        out = np.zeros((len(c) - ORDER + 1, len(self.languages)), np.float32)
        left = np.arange(len(out))
        for order in range(len(self.grams), 0, -1):
            at, hit = self.grams[order - 1].find(grams(c, order)[left])
            out[left[hit]] += self.logs[order - 1][at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if order > 1:
                at, hit = self.contexts[order - 1].find(contexts(c, order)[left])
                out[left[hit]] += self.backoff[order - 1][at[hit]]
        out[left] += self.floor
        return out

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy a character by language, [texts, languages]; NaN rows for texts without letters."""
        found = np.full((len(texts), len(self.languages)), np.nan)
        held, which, n = [], [], 0

        def flush() -> None:
            starts = np.concatenate([[0], np.cumsum([len(c) for c in held])[:-1]])
            logs = self.position_logs(np.concatenate([*held, np.zeros(ORDER - 1, np.uint32)]))
            # the last ORDER - 1 positions of a text run into the next one
            ends = starts + [len(c) - ORDER + 1 for c in held]
            cuts = np.stack([starts, ends], 1).ravel()
            sums = np.add.reduceat(np.concatenate([logs, np.zeros((1, logs.shape[1]), np.float32)]), cuts)[::2]
            found[which] = -sums / (ends - starts)[:, None]

        for i, text in enumerate(texts):
            c = codes(text)
            if not len(c):
                continue
            c = padded(c)
            if len(c) > PIECE:
                total, at = np.zeros(len(self.languages)), 0
                while at < len(c) - ORDER + 1:
                    part = c[at : at + PIECE + ORDER - 1]
                    total += self.position_logs(part).sum(0, dtype=np.float64)
                    at += PIECE
                found[i] = -total / (len(c) - ORDER + 1)
                continue
            held.append(c)
            which.append(i)
            n += len(c)
            if n >= PIECE:
                flush()
                held, which, n = [], [], 0
        if held:
            flush()
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its probability, and whether the text is accepted as that language."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        h = self.entropies(texts)
        none = np.isnan(h[:, 0])
        h = np.where(none[:, None], 0, h)
        best = h.argmin(1)
        weight = np.exp(-(h - h.min(1)[:, None]) * self.temperature)
        score = np.where(none, 0, 1 / weight.sum(1))
        accepted = ~none & (h.min(1) <= (np.inf if self.limit is None else self.limit[best]))
        return ["und" if x else self.languages[k] for x, k in zip(none.tolist(), best.tolist(), strict=True)], score, accepted


def _pieces(texts: list[str]) -> list[np.ndarray]:
    return [padded(c[k : k + CUT]) for t in texts for c in (codes(t),) for k in range(0, len(c), CUT)]


def train(texts: dict[str, list[str]]) -> Model:
    """texts by language; a fifth of each is used for calibration only, where there are 10 or more."""
    languages = sorted(texts)
    held = {x: texts[x][::5] if len(texts[x]) >= 10 else [] for x in languages}
    rows = {x: _pieces([t for i, t in enumerate(texts[x]) if i % 5 or not held[x]]) for x in languages}
    for top in (2, ORDER):
        sieve = _fit(rows, languages, top)
        if len(languages) > 1:
            rows = {x: [c for c in rows[x] if sieve.position_logs(c).sum(0).argmax() == k] or rows[x] for k, x in enumerate(languages)}
    model = _fit(rows, languages, ORDER)
    if languages:
        _calibrate(model, held)
    return model


def _fit(rows: dict[str, list[np.ndarray]], languages: list[str], top: int) -> Model:
    n_lang = len(languages)
    model = Model(languages, [], [], [], [], np.zeros(n_lang, np.float32))
    if not languages:
        return model
    alphabet = len(np.unique(np.concatenate([np.zeros(1, np.uint32), *(c for x in rows.values() for c in x)]))) + 1
    # distinct grams of each order: key, context key, key of the gram without its first character, and counts by language
    orders = []
    for order in range(1, top + 1):
        stats = []
        for x in languages:
            keys = [grams(c, order) for c in rows[x]]
            key, first, count = np.unique(np.concatenate(keys), return_index=True, return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            ctx = np.concatenate([contexts(c, order) for c in rows[x]])[first] if keys else key
            short = np.concatenate([grams(c, order - 1) for c in rows[x]])[first] if keys and order > 1 else np.zeros(len(key), np.uint64)
            stats.append((key, ctx, short, count))
        orders.append(stats)
    below_keys, below = None, None
    for order in range(1, top + 1):
        every = np.unique(np.concatenate([s[0] for s in orders[order - 1]]))
        every_ctx = np.unique(np.concatenate([s[1] for s in orders[order - 1]]))
        own, gamma = np.zeros((len(every), n_lang)), np.ones((len(every_ctx), n_lang))
        ctx_of, short_of = np.zeros(len(every), np.uint64), np.zeros(len(every), np.uint64)
        for k in range(n_lang):
            key, ctx, short, count = orders[order - 1][k]
            if order < top:  # continuation counts: in how many longer grams this one ends
                longer_key, longer_count = np.unique(orders[order][k][2], return_counts=True)
                at, hit = Hashes(longer_key).find(key)
                count = np.where(hit, longer_count[at] if len(longer_count) else 0, 0)
            at = np.searchsorted(every, key)
            ctx_of[at], short_of[at] = ctx, short
            if not len(key):
                continue
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
            ctx_at = np.searchsorted(every_ctx, ctx)
            total = np.bincount(ctx_at, count, len(every_ctx))
            kinds = np.bincount(ctx_at, count > 0, len(every_ctx))
            seen = total > 0
            gamma[seen, k] = discount * kinds[seen] / total[seen]
            own[at, k] = np.maximum(count - discount, 0) / np.maximum(total[ctx_at], 1)
        weight = gamma[np.searchsorted(every_ctx, ctx_of)]
        lower = np.full((len(every), n_lang), 1 / alphabet) if order == 1 else below[np.searchsorted(below_keys, short_of)]
        prob = own + weight * lower
        if order == 1:
            model.floor = np.log2(gamma[0] / alphabet).astype(np.float32)
        below_keys, below = every, prob
        model.grams.append(Hashes(every))
        model.logs.append(np.log2(prob).astype(np.float32))
        model.contexts.append(Hashes(every_ctx))
        model.backoff.append(np.log2(gamma).astype(np.float32))
    return model


def _calibrate(model: Model, held: dict[str, list[str]]) -> None:
    """Temperature of the greatest likelihood on the held texts; limits that 99.5 in 100 of them keep, with a tenth to spare."""
    h, y = [], []
    for k, x in enumerate(model.languages):
        e = model.entropies(held[x])
        e = e[~np.isnan(e[:, 0])]
        h.append(e)
        y += [k] * len(e)
    h, y = np.concatenate(h), np.array(y, np.int64)
    if not len(y):
        return

    def loss(t: float) -> float:
        z = -(h - h.min(1)[:, None]) * t
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))

    model.temperature = float(min(np.geomspace(0.5, 64, 29), key=loss))
    model.limit = np.array([1.1 * np.quantile(h[y == k, k], 0.995) if (y == k).any() else np.inf for k in range(len(model.languages))])


def fit(docs: DataFrame, max_rows: int = 250, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_text_bytes: int = 1 << 20) -> Model:
    """Train on the `max_rows` rows of each language with the smallest id hash; only these reach the driver.

    Rows with longer texts than `max_text_bytes` are not learned from, and rows of one
    repeated id don't add up to more than `max_rows`; so the driver's share is bounded.
    """
    docs = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in ((id_col, "k"), (lang_col, "l"), (text_col, "t")))).where(F.octet_length("t") <= max_text_bytes)
    ids = docs.where("l is not null and t is not null").select("k", "l")
    # thinned by hash first, so that no language's rows meet in one task
    sizes = {r["l"]: r["n"] for r in ids.groupBy("l").agg(F.approx_count_distinct("k").alias("n")).collect()}
    if not sizes:
        return train({})
    share = F.create_map(*[x for l, n in sizes.items() for x in (F.lit(l), F.lit(min(1.0, 3 * max_rows / max(1, n))))])
    unit = F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / (1 << 20)
    thin = ids.where(unit < share[F.col("l")])
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k"))
    chosen = thin.withColumn("rank", rank).where(F.col("rank") <= max_rows).select("k", "l").distinct()
    rows = docs.join(F.broadcast(chosen), ["k", "l"])
    texts: dict[str, list[str]] = {}
    rows = rows.select("l", F.xxhash64("k").alias("h"), "t").withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("rank") <= max_rows)
    for r in sorted(rows.collect(), key=lambda r: (r["l"], r["h"], r["t"] or "")):
        texts.setdefault(r["l"], []).append(r["t"])
    return train(texts)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a struct column `language` (in place of one of that name): lang, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    @F.arrow_udf("lang string, score double, accepted boolean")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            lang, score, accepted = [], [], []
            for at in range(0, len(texts), 500):
                a, b, c = model.predict(texts.slice(at, 500).to_pylist())
                lang += a
                score += b.tolist()
                accepted += c.tolist()
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], fields=list(kind))

    return docs.withColumn("language", predicted(F.col(f"`{text_col}`")))
