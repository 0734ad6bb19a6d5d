import random

import numpy as np
import pytest

from paywire.llm import quality


def corpus(n, seed):
    rnd = random.Random(seed)
    good = lambda: " ".join(rnd.choice(["the", "rain", "falls", "on", "hills", "and", "mead"]) for _ in range(rnd.choice([4, 60, 400])))
    bad = lambda: " ".join(rnd.choice(["BUY!!", "$$$", "click|", "WIN##"]) for _ in range(rnd.choice([4, 60, 400])))
    out = [(good() if i % 3 else good()[:600] + bad(), int(i % 3 > 0)) for i in range(n)]
    return [t for t, _ in out], [y for _, y in out]


@pytest.fixture(scope="module")
def net():
    texts, labels = corpus(300, 1)
    return quality.train([t.encode() for t in texts], labels)


def test_held_out_accuracy(net):
    texts, labels = corpus(200, 2)
    s = quality.score(net, net.pairs(), [t.encode() for t in texts])
    assert ((s >= 0.5) == labels).mean() > 0.97


def test_score_against_plain_loops(net):
    rnd = random.Random(3)
    texts = [bytes(rnd.choices(range(256), k=n)) for n in (0, 1, 127, 128, 129, 700)]
    got = quality.score(net, net.pairs(), texts)
    for t, s in zip(texts, got, strict=True):
        span = quality.BLOCK * quality.STEP
        n_blocks = max(1, -(-len(t) // span))
        data = t.ljust(n_blocks * span, b"\0") + bytes(quality.WIDTH)
        response = [np.sum([net.table[w, data[p + w]] for w in range(quality.WIDTH)], 0) + net.bias for p in range(0, n_blocks * span, quality.STEP)]
        blocks = [np.max(response[k : k + quality.BLOCK], 0) for k in range(0, len(response), quality.BLOCK)]
        chunks = np.maximum([np.maximum(a, b) for a, b in zip(blocks, blocks[1:], strict=False)] or blocks, 0)
        logit = np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0)]) @ net.head + net.offset[0]
        assert s == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)


def test_a_score_does_not_depend_on_the_batch(net):
    rnd = random.Random(5)
    texts = [bytes(rnd.choices(range(256), k=n)) for n in (0, 1, 124, 128, 129, 256, 256, 384, 700, 40_000)] + [b"", b"BUY!! $$$"]
    texts = texts * 5
    fresh = quality.Network.fresh(9)
    for network in (net, fresh):
        alone = {t: quality.score(network, network.pairs(), [t])[0] for t in set(texts)}
        for _ in range(4):
            rnd.shuffle(texts)
            assert quality.score(network, network.pairs(), texts).tolist() == [alone[t] for t in texts]


def test_gradients_do_not_depend_on_the_order(net):
    rnd = random.Random(6)
    texts = [(bytes(rnd.choices(range(256), k=n)), n % 2) for n in (0, 128, 256, 384, 77)]
    sums = []
    for _ in range(2):
        sums.append(quality._gradients(net, [t for t, _ in texts], np.array([y for _, y in texts], np.float32)))
        rnd.shuffle(texts)
    for a, b in zip(*sums, strict=True):
        assert np.allclose(a, b, atol=1e-6)


def test_equal_texts_in_different_partitions(spark, net):
    rows = [(i, ["", "the rain", "$$$ BUY!!", None, "on hills " * 300][i % 5]) for i in range(400)]
    docs = spark.createDataFrame(rows, "`my.id` long, `my.text` string").repartition(5)
    scores = quality.with_scores(docs, net, text_col="my.text", score_col="s").collect()
    assert len({(r["my.text"] or "", r["s"]) for r in scores}) == 4
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "`my.id` long, `a.label` int")
    assert quality.fit(docs, labels, id_col="my.id", text_col="my.text", label_col="a.label").head.any()


def test_gradients(net):
    texts, labels = corpus(6, 4)
    raw, y = [t.encode() for t in texts], np.array(labels, np.float32)
    fresh = quality.Network.fresh(1)

    def loss():
        s = np.clip(quality.score(fresh, fresh.pairs(), raw), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for p, g in zip(fresh.params(), quality._gradients(fresh, raw, y), strict=True):
        for i in np.argsort(-np.abs(g.ravel()))[:4]:
            old, step = p.flat[i], 2e-3
            p.flat[i] = old + step
            up = loss()
            p.flat[i] = old - step
            down = loss()
            p.flat[i] = old
            assert g.flat[i] == pytest.approx((up - down) / (2 * step), rel=0.1, abs=2e-4)


def test_defined_results(spark, net):
    rows = [(1, None, 0.1), (2, "", 0.2), (3, "the rain " * 200_000, 0.3), (3, "$$$ BUY!! " * 50, 0.3), (None, "on hills", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    scored = quality.with_scores(docs, net, score_col="s").collect()
    by = {r["text"]: r["s"] for r in scored}
    assert len(scored) == 5 and all(0 <= r["s"] <= 1 for r in scored) and by[None] == by[""]
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns and kept.where("text like '$%'").count() == 0
    assert quality.with_scores(docs.limit(0), net).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, quality int")
    assert {r["s"] for r in quality.with_scores(docs, quality.fit(docs, labels), score_col="s").collect()} == {0.5}
