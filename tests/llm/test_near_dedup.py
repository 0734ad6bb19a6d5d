import random

import numpy as np
import pytest

from paywire.llm import near_dedup as nd
from paywire.llm.graph import connected_components


def brute(docs, size=5, percent=85):
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for i, (k, _) in enumerate(docs):
        least[root[i]] = min(least.get(root[i], k), k)
    return {k: (len(sets[i]), least[root[i]]) for i, (k, _) in enumerate(docs)}


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("xyzuvw") + rnd.choice("ABCD")
    texts = [None, "", " \n", "one", "ONE", "a b c", "a b c d e", "a b c d e f"]
    for _ in range(n):
        base = [word() for _ in range(rnd.choice([6, 20, 120, 400]))]
        for _ in range(rnd.choice([0, 1, 4])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 5])):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    rnd.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("block", [400, 2])
def test_against_brute_force(spark, block):
    docs = corpus(3)
    rows = nd.tagged(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, bands string"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicate_report(rows, block=block).collect()}
    assert got == brute(docs)


def test_rows_that_stay(spark):
    docs = corpus(4, 20) + [(100, "again"), (100, "again")]
    table = spark.createDataFrame([(*d, 1) for d in docs] + [(None, None, 1), (None, "again", 1)], "doc_id long, text string, _tag int")
    kept = nd.near_deduplicate(table)
    assert kept.columns == table.columns
    classes = {v[1] for v in brute([d for d in docs if d[1] != "again"]).values()}
    assert sorted(r["doc_id"] for r in kept.collect() if r["text"] != "again" and r["doc_id"] is not None) == sorted(classes)
    assert kept.where("text = 'again'").count() == 1 and kept.where("doc_id is null").count() == 1
    assert nd.near_deduplicate(table.limit(0)).count() == 0


def test_sketch_merges_and_estimates():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 1150, np.int64).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[150:])
    both = nd.sketch([a, b, np.union1d(a, b), pool[:1], np.zeros(0, np.uint64)])
    assert (np.maximum(both[0], both[1]) == both[2]).all() and (both[4] == 0).all()
    assert (nd.sketch([pool[:1]])[0] == both[3]).all()
    estimate = nd.joint_estimate(both[0], len(a), both[1:2], np.array([len(b)]))[0]
    assert abs(estimate - 850 / 1150) < 0.12
    small = nd.sketch([rnd.integers(0, 2**63, 400, np.int64).astype(np.uint64) for _ in range(300)])
    share = (small[::2] == small[1::2]).mean()
    assert share < 0.01


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_cluster_in_two_passes(spark):
    """A base text, many copies of it that no pivot joins all, and a chain whose ends only its links join."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for at in rnd.sample(range(80), rnd.choice([1, 1, 1, 2, 3])):
            copy[at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    chain = [f"c{i}" for i in range(120)]
    for step in range(0, 60, 2):
        texts.append(" ".join(f"d{i}" if i < step else w for i, w in enumerate(chain)))
    docs = list(enumerate(texts))
    rnd.shuffle(docs)
    rows = nd.tagged(spark.createDataFrame(docs, "doc_id long, text string"))
    want = brute(docs)
    for how in ({}, {"block": 3}, {"block_shingles": 300}):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicate_report(rows, **how).collect()} == want


def test_bands_follow_the_threshold():
    for percent in (50, 80, 85, 95):
        width = nd.band_width(percent)
        assert (1 - (percent / 100) ** width) ** (nd.M // width) <= 1e-8
    assert (nd.band_width(80), nd.band_width(85)) == (5, 6)
    registers = np.arange(2 * nd.M, dtype=np.uint16).reshape(2, nd.M)
    assert nd.bands(registers, 5).shape == (2, 50) and nd.bands(registers, 6).shape == (2, 42)


def test_edges_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Names by the first bands leave few edges between nodes, however large the group."""
    seen = {}

    def counted(edges, label):
        seen.setdefault(label, edges.distinct().count())
        return connected_components(edges, label)

    monkeypatch.setattr(nd, "connected_components", counted)
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(2000):
        copy = list(base)
        for at in rnd.sample(range(150), rnd.choice([1, 1, 2, 3])):
            copy[at] = f"x{rnd.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    nodes = nd.tagged(spark.createDataFrame(docs, "doc_id long, text string"))
    report = nd.near_duplicate_report(nodes, percent=80)
    assert seen["loose"] < 0.5 * len(docs)
    assert report.where("kept").count() < 0.05 * len(docs)


def test_templates_of_one_boilerplate(spark, monkeypatch):
    """Texts that share a part but hardly any of them a link: only blocks of like set sizes meet."""
    compared, all_blocks = [], nd._pairs_of_blocks

    def counted(members, n_blocks):
        made = all_blocks(members, n_blocks)
        groups = {}
        for r in made.collect():
            groups.setdefault((r["label"], r["i"], r["j"]), set()).add(r["node"])
        compared.append((len({(a, b) for g in groups.values() for a in g for b in g if a < b}), members.count()))
        return made

    monkeypatch.setattr(nd, "_pairs_of_blocks", counted)
    rnd = random.Random(13)
    part = [f"b{i}" for i in range(150)]
    docs = [(i, " ".join(part + [f"d{rnd.randrange(10**6)}" for _ in range(10 + 2 * i)])) for i in range(160)]
    docs += [(1000 + i, docs[40 + i][1] + " tail") for i in range(10)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicate_report(nd.tagged(spark.createDataFrame(docs, "doc_id long, text string")), block=10).collect()}
    assert got == brute(docs)
    pairs, n = compared[0]
    assert n > 100 and pairs < 0.6 * n * (n - 1) / 2


def test_ids_of_other_types(spark):
    docs = [("b", "one two three four five six"), ("a", "one two three four five six"), (None, "one two three four five six"), ("c", None), ("c", "other words")]
    table = spark.createDataFrame([(*d, 1.5) for d in docs], "`doc id` string, text string, `a.b c` double")
    kept = nd.near_deduplicate(table, id_col="doc id")
    assert kept.columns == table.columns and sorted((r[0], r[1]) for r in kept.collect() if r[1]) == [("a", docs[1][1]), ("c", "other words")]
