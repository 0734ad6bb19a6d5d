import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paywire.llm import common, hmm_lm


def random_model(seed):
    rnd = np.random.default_rng(seed)
    return hmm_lm.Hmm(rnd.dirichlet(np.ones(hmm_lm.STATES)), rnd.dirichlet(np.ones(hmm_lm.STATES), hmm_lm.STATES), rnd.dirichlet(np.ones(hmm_lm.CLASSES), hmm_lm.STATES).T)


def paths(model, seq):
    """Every state path with its probability."""
    for p in itertools.product(range(hmm_lm.STATES), repeat=len(seq)):
        x = model.start[p[0]] * model.emit[seq[0], p[0]]
        for a, b, g in zip(p, p[1:], seq[1:], strict=False):
            x *= model.move[a, b] * model.emit[g, b]
        yield p, x


def test_forward_and_expectations_against_all_paths(monkeypatch):
    monkeypatch.setattr(hmm_lm, "BATCH_TOKENS", 5)
    model, seqs = random_model(1), [[5, 6, 5], [7], [8, 5, 5, 9], [6]]
    flat, lengths = np.array([g for s in seqs for g in s]), np.array([len(s) for s in seqs])
    got = hmm_lm.log_likelihoods(model, flat, lengths)
    begun, moved, made, likelihood = hmm_lm.expected_counts(model, flat, lengths)
    assert likelihood == pytest.approx(got.sum(), rel=1e-5)
    want = [np.zeros_like(x) for x in (begun, moved, made)]
    for s, ll in zip(seqs, got, strict=True):
        every = list(paths(model, s))
        total = sum(x for _, x in every)
        assert ll == pytest.approx(math.log(total), abs=1e-3)
        for p, x in every:
            want[0][p[0]] += x / total
            for a, b in zip(p, p[1:], strict=False):
                want[1][a, b] += x / total
            for g, k in zip(s, p, strict=True):
                want[2][g, k] += x / total
    for a, b in zip((begun, moved, made), want, strict=True):
        assert np.allclose(a, b, atol=1e-3)


def test_learning_raises_likelihood():
    rnd = np.random.default_rng(2)
    seqs = [np.concatenate([rnd.integers(k * 50, k * 50 + 50, 30), [999]]) for k in rnd.integers(0, 4, 80)]
    flat, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    prior = (np.bincount(flat, minlength=hmm_lm.CLASSES) + 1e-3) / (len(flat) + 1e-3 * hmm_lm.CLASSES)
    model, after = hmm_lm.first_model(prior), []
    for _ in range(10):
        model = hmm_lm.reestimated(*hmm_lm.expected_counts(model, flat, lengths)[:3], prior)
        after.append(hmm_lm.log_likelihoods(model, flat, lengths).sum())
    assert after[-1] > after[0] and after[-1] > np.log(prior[flat]).sum()


@pytest.mark.parametrize("block", [3_000_000, 20])
def test_scores(spark, monkeypatch, block):
    monkeypatch.setattr(hmm_lm, "BLOCK_TOKENS", block)
    rows = [(i, " ".join(f"W{(i * 7 + j * j) % 11}" for j in range(i % 9))) for i in range(40)] + [(50, None), (51, "new words here"), (52, ""), (None, "w1 w1"), (3, "w1 again")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, block string")
    out = {}
    for r in hmm_lm.score_documents(docs, common.id_bucket("doc_id", 5) == 1).collect():
        out.setdefault(r["doc_id"], []).append(r)
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    words = lambda t: [*(t or "").lower().split(), ""]
    counts = Counter(w for k, t in rows if not held(k) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    assert sum(map(len, out.values())) == len(rows)
    for k, t in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
        match = [r for r in out[k] if r["base_score"] == pytest.approx(base)]
        assert match, (k, t)
        r = match[0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(k), len(words(t)), sum(counts[w] > 0 for w in words(t)), n)
        assert r["score"] < 0
    assert hmm_lm.score_documents(docs.limit(0), F.lit(False)).count() == 0
    none = hmm_lm.score_documents(docs, F.lit(True)).collect()
    assert len(none) == len(rows) and {r["n_known"] for r in none} == {0}


def test_probabilities_of_single_words_sum_to_one(spark):
    """Texts of one word each, all known words and one unseen word of every class would make 1; the known ones stay below it."""
    vocabulary = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(vocabulary)] + [(99, "")], "doc_id long, text string")
    scored = hmm_lm.score_documents(docs, F.lit(False)).collect()
    assert 0.01 < sum(10 ** r["score"] for r in scored) < 1


def plain_scores(rows, held, passes):
    """The model in plain Python, in double precision: Baum-Welch over all training texts, then scores."""
    split = lambda t: [*"".join(c.lower() if c.isascii() else c for c in t or "").encode().split(), b""]
    texts = [split(t) for _, t in rows]
    kind = lambda w: xxhash.xxh3_64_intdigest(w) % hmm_lm.CLASSES
    counts = Counter(w for (k, _), ws in zip(rows, texts, strict=True) if not held(k) for w in ws)
    ones, twos = (sum(c == n for c in counts.values()) for n in (1, 2))
    d = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5
    tokens, kinds = Counter(), Counter()
    for w, c in counts.items():
        tokens[kind(w)] += c
        kinds[kind(w)] += 1
    whole = sum(counts.values()) + d * hmm_lm.CLASSES
    prior = np.array([(tokens[g] + d) / whole for g in range(hmm_lm.CLASSES)])
    first = hmm_lm.first_model(prior)
    start, move, emit = first.start.tolist(), first.move.tolist(), {g: first.emit[g].tolist() for g in {kind(w) for ws in texts for w in ws}}
    states = range(hmm_lm.STATES)

    def forward(seq):
        alphas, scales = [], []
        for t, g in enumerate(seq):
            a = [(start[j] if not t else sum(alphas[-1][i] * move[i][j] for i in states)) * emit[g][j] for j in states]
            scales.append(sum(a))
            alphas.append([x / scales[-1] for x in a])
        return alphas, scales

    train = [[kind(w) for w in ws] for (key, _), ws in zip(rows, texts, strict=True) if not held(key)]
    for _ in range(passes):
        begun, moved, made = [0.0] * len(start), [[0.0] * len(start) for _ in states], {}
        for seq in train:
            alphas, scales = forward(seq)
            beta = [1.0] * len(start)
            for t in reversed(range(len(seq))):
                gamma = [alphas[t][i] * beta[i] for i in states]
                for i in states:
                    made.setdefault(seq[t], [0.0] * len(start))[i] += gamma[i]
                if not t:
                    begun = [x + y for x, y in zip(begun, gamma, strict=True)]
                    break
                ahead = [emit[seq[t]][j] * beta[j] / scales[t] for j in states]
                for i in states:
                    for j in states:
                        moved[i][j] += alphas[t - 1][i] * move[i][j] * ahead[j]
                beta = [sum(move[i][j] * ahead[j] for j in states) for i in states]
        weight = [sum(min(m[i], 1) for m in made.values()) + 1 for i in states]
        total = [sum(m[i] for m in made.values()) + weight[i] for i in states]
        start = [(x + 1) / (sum(begun) + len(begun)) for x in begun]
        move = [[(x + 1) / (sum(r) + len(r)) for x in r] for r in moved]
        emit = {g: [(made[g][i] if g in made else 0) / total[i] + weight[i] * prior[g] / total[i] for i in states] for g in emit}
    out = []
    for ws in texts:
        latent = sum(math.log10(x) for x in forward([kind(w) for w in ws])[1])
        inside = 0.0
        for w in ws:
            g = kind(w)
            share = counts[w] - d if counts[w] else d * (kinds[g] + 1)
            inside += math.log10(share / (tokens[g] + d))
        out.append(latent + inside)
    return out


def test_scores_against_plain_python(spark, monkeypatch):
    """Every score of the operator, over several blocks, NULL, repeated and text ids."""
    monkeypatch.setattr(hmm_lm, "BLOCK_TOKENS", 40)
    rnd = np.random.default_rng(8)
    rows = [(f"d{i}", " ".join(f"W{rnd.integers(0, 12)}" if i % 2 else f"v{rnd.integers(0, 9)}" for _ in range(rnd.integers(0, 20)))) for i in range(40)]
    rows += [("long", "w1 w2 " * 60), ("null", None), (None, "w1 new"), ("d1", "again w1"), ("d1", "again w1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id string, text string, lengths int")
    held = lambda k: k is not None and zlib.crc32(k.encode()) % 5 == 1
    got = hmm_lm.score_documents(docs, common.id_bucket("doc_id", 5) == 1, passes=4, settled=-1.0).collect()
    want = plain_scores(rows, held, 4)
    assert sorted((r["doc_id"] or "", round(r["score"], 2)) for r in got) == sorted((k or "", round(x, 2)) for (k, _), x in zip(rows, want, strict=True))


def test_long_texts_are_learned_whole(monkeypatch):
    """In pieces, none of which is left out."""
    model, seq = random_model(4), [5, 6, 5, 7, 8, 5, 9, 6, 5, 7, 7]
    pieces = [seq[k : k + 4] for k in range(0, len(seq), 4)]
    want = hmm_lm.expected_counts(model, np.array(seq), np.array([len(x) for x in pieces]))
    monkeypatch.setattr(hmm_lm, "TRAIN_CUT", 4)
    got = hmm_lm.expected_counts(model, np.array(seq), np.array([len(seq)]))
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True)) and got[2].sum() == pytest.approx(len(seq), rel=1e-4)


def test_sums_in_shares(spark):
    """With many tasks no share gets more than about the square root of them, and the sums are the same as in one step."""
    def made(batches):
        for batch in batches:
            table = np.zeros((hmm_lm.CLASSES, 2))
            for i in batch.column(0).to_pylist():
                table[[i * 131 % hmm_lm.CLASSES, 7, hmm_lm.CLASSES - 1]] += [[i, 1], [1, 0], [2, 2]]
            yield hmm_lm._emit(table, np.array([1.0, 0.0, 5.0]), "<f8")

    parts = spark.range(0, 100, 1, 100).mapInArrow(made, hmm_lm.PARTS)
    shares = hmm_lm.in_shares(parts, 100, "<f8").select("share", "segment").collect()
    assert len({r["share"] for r in shares}) == 10 and len(shares) == len(set(shares))
    one, two = hmm_lm._summed(parts, "<f8"), hmm_lm._summed(hmm_lm.in_shares(parts, 100, "<f8"), "<f8")
    want = np.zeros((hmm_lm.CLASSES, 2))
    for i in range(100):
        want[[i * 131 % hmm_lm.CLASSES, 7, hmm_lm.CLASSES - 1]] += [[i, 1], [1, 0], [2, 2]]
    for found in (one, two):
        assert np.array_equal(hmm_lm._table(found, 2), want)
        assert found[-1][:3, 0].tolist() == [100, 0, 500]


def test_fewer_buckets_than_tasks(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "BLOCK_TOKENS", 40)
    docs = spark.range(0, 200, 1, 8).selectExpr("id as doc_id", "concat('w', id % 7, ' w', id % 11, ' ', repeat('z ', int(id % 5))) as text")
    key = "spark.sql.sources.bucketing.maxBuckets"
    old, whole = spark.conf.get(key), hmm_lm.score_documents(docs, F.lit(False), passes=2).collect()
    spark.conf.set(key, "3")
    try:
        few = hmm_lm.score_documents(docs, F.lit(False), passes=2).collect()
    finally:
        spark.conf.set(key, old)
    score = lambda rows: {r["doc_id"]: round(r["score"], 3) for r in rows}
    assert len(few) == 200 and score(few) == score(whole)
