import random

import numpy as np
import pytest

from paywire.llm import decontaminate as d


def brute(docs, items, window):
    out = []
    for text in docs:
        w, hit, names = d.words_of(text), set(), set()
        for name, item in items:
            v = d.words_of(item)
            n = min(window, len(v))
            for i in range(len(v) - n + 1) if v else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        names.add("" if name is None else str(name))
        out.append((len(w), hit, sorted(names)))
    return out


def case(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("aa ab ba bb c É9 x".split())
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 2, 4, 5, 9])))) for i in range(8)] + [(3, "aa c"), (None, "c c x"), (9, None)]
    docs = [None, "", "..."] + [", ".join(word().upper() for _ in range(rnd.choice([1, 3, 30, 200]))) for _ in range(12)]
    docs += [docs[-1]] * 3 + ["zz " + (items[5][1] or "q") + " zz"]
    return docs, items


def test_suffix_array():
    rnd = np.random.default_rng(5)
    for _ in range(30):
        text = np.append(rnd.integers(0, 4, rnd.integers(0, 60)), 0)
        n_zero, seps = (text == 0).sum(), iter(range(10_000))
        keys = [next(seps) if t == 0 else int(t + n_zero) for t in text]
        assert d.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: keys[i:])


@pytest.mark.parametrize("how", [{}, {"shard_words": 7}, {"block_phrases": 3}])
def test_against_brute_force(spark, how):
    for seed in range(3):
        docs, items = case(seed)
        table = spark.createDataFrame([(i, t, "q") for i, t in enumerate(docs)], "doc_id long, text string, items string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        found = d.find_hits(table, bench, ["doc_id"], window=4, **how).orderBy("doc_id").collect()
        for row, (n, hit, names) in zip(found, brute(docs, items, 4), strict=True):
            spans = {k for a, b in zip(row["starts"], row["ends"], strict=True) for k in range(a, b)}
            assert (row["n_words"], spans, sorted(row["items"])) == (n, hit, names)
            assert all(a > b for a, b in zip(row["starts"][1:], row["ends"], strict=False))


def test_filters_and_cut(spark):
    phrase = " ".join(f"w{i}" for i in range(13))
    rows = [(1, f"clean words, {phrase}! more", "a"), (2, "nothing here", None), (3, phrase + " z" * 300, "b"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, starts string")
    bench = spark.createDataFrame([(1, phrase.upper())], "item_id long, text string")
    assert sorted(r["doc_id"] for r in d.remove_contaminated(docs, bench).collect()) == [2, 3, 4]
    texts = {r["doc_id"]: r["text"] for r in d.cut_spans(docs, bench).collect()}
    assert texts == {1: "clean words, ! more", 2: "nothing here", 3: " z" * 300, 4: None}
    assert d.find_hits(docs.limit(0), bench, ["doc_id"]).count() == 0
    assert d.remove_contaminated(docs, bench.limit(0)).count() == 4


def test_wavelet_matrix_against_counts():
    rnd = np.random.default_rng(3)
    for n, k in ((1, 1), (63, 5), (64, 2), (65, 300), (1000, 17)):
        text = rnd.integers(0, k + 1, n)
        w = d.WaveletMatrix(text, k)
        i = np.arange(n + 1)
        for c in rnd.integers(0, k + 1, 4):
            assert w.rank(np.full(n + 1, c), i).tolist() == [int((text[:j] == c).sum()) for j in i]
        symbol, before = w.access(np.arange(n))
        assert symbol.tolist() == text.tolist() and before.tolist() == [int((text[:j] == text[j]).sum()) for j in range(n)]


def test_columns_of_any_name_and_long_texts(spark):
    rows = [(1, "aa ba " * 60_000, "x", 5), (2, "ba aa c", "y", 6), (3, None, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `my col` string, n_words int")
    items = spark.createDataFrame([("i", "ba aa c")], "item_id string, text string")
    kept = d.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert {r["doc_id"]: r["text"] for r in d.cut_spans(docs, items).collect()}[2] == ""


def test_blocks_of_phrases_move_no_texts(spark):
    """Several passes: what they find goes to the rows; no text and no row is in an exchange."""
    rows = [(i, f"clean words {i} " + ("w1 w2 w3 w4 w5 " if i % 5 == 0 else "v1 v2 v3 v4 v5 ") * 3, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5"), (2, "v1 v2 v3 v4 v5"), (3, "q1 q2 q3 q4")], "item_id long, text string")
    found = d.find_hits(docs, bench, ["doc_id"], window=4, block_phrases=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    below = plan[plan.index(moved[0]) :] if moved else ""
    assert len(moved) == 1 and "text" not in below and "row" not in below.replace("arrow", "").lower().replace("columnartorow", "").replace("throw", "")
    assert {r["doc_id"]: tuple(r["items"]) for r in found.collect()} == {i: ("1",) if i % 5 == 0 else ("2",) for i in range(60)}
    one = d.find_hits(docs, bench, ["doc_id"], window=4)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, one.collect())) == sorted(map(key, found.collect()))
