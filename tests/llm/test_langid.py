import math
import random

import numpy as np
import pytest

from paywire.llm import langid

SYLLABLES = {"aa": "ba ke mi to lu".split(), "bb": "sch ung ver heit zu".split(), "cc": "été ça où île née".split()}


def made(lang, n, rnd):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.choice([1, 2, 3]))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    return {x: [made(x, rnd.choice([5, 40, 200]), rnd) for _ in range(60)] for x in SYLLABLES}


def test_kneser_ney_by_hand():
    """Order 2 on one language against the formula, and it sums to one."""
    texts = ["abab aab b"]
    model = langid._fit({"x": langid._pieces(texts)}, ["x"], 2)
    c = "\0\0" + "\0abab\0aab\0b\0"
    bigrams = {}
    for p, q in zip(c[2:], c[3:], strict=False):
        bigrams[p + q] = bigrams.get(p + q, 0) + 1
    alphabet = 4  # blank, a, b, and one for what was never seen

    def discount(counts):
        ones, twos = sum(v == 1 for v in counts), sum(v == 2 for v in counts)
        return min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5

    follow = {ch: sum(k[1] == ch for k in bigrams) for ch in "\0ab"}
    d1, total1 = discount(list(follow.values())), sum(follow.values())
    p1 = {ch: max(v - d1, 0) / total1 + d1 * sum(x > 0 for x in follow.values()) / total1 / alphabet for ch, v in follow.items()}
    p1["?"] = d1 * sum(x > 0 for x in follow.values()) / total1 / alphabet
    d2 = discount(list(bigrams.values()))
    for h in "\0ab":
        own = {k: v for k, v in bigrams.items() if k[0] == h}
        n = sum(own.values())
        want = {ch: max(own.get(h + ch, 0) - d2, 0) / n + d2 * len(own) / n * p1[ch] for ch in p1}
        assert sum(want.values()) == pytest.approx(1)
        for ch in "\0ab":
            got = model.position_logs(np.array([0, 0, ord(h) * (h != "\0"), ord(ch) * (ch != "\0")], np.uint32))[0, 0]
            assert got == pytest.approx(math.log2(want[ch]), abs=1e-4)


def test_held_out_accuracy_and_quotes(texts):
    quoted = {x: list(t) for x, t in texts.items()}
    for i in range(0, 60, 3):  # a third of one language's texts quote another
        quoted["aa"][i] += " " + texts["cc"][i]
    model = langid.train(quoted)
    rnd = random.Random(2)
    for x in SYLLABLES:
        names, score, accepted = model.predict([made(x, 30, rnd) for _ in range(50)])
        assert names == [x] * 50 and score.mean() > 0.9 and accepted.mean() > 0.9
    assert not model.predict(["zzzz qqqq xxxx wwww yyyy"])[2].any()


def test_defined_results(spark, texts, monkeypatch):
    rows = [(i, t, x, "z") for x, ts in texts.items() for i, t in enumerate(ts)] + [(900, None, "aa", None), (901, "bake", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string")
    model = langid.fit(docs)
    assert model.languages == sorted(SYLLABLES)
    odd = spark.createDataFrame([(1, None), (2, "123 !?"), (3, "baketo milu" * 100_000), (4, ""), (5, "bake")], "doc_id long, text string")
    got = {r["doc_id"]: r["language"] for r in langid.identify(odd, model).collect()}
    assert [got[k]["lang"] for k in (1, 2, 3, 4, 5)] == ["und", "und", "aa", "und", "aa"]
    assert got[1]["score"] == 0 and not got[1]["accepted"] and 0 < got[3]["score"] <= 1
    assert langid.identify(odd.limit(0), model).count() == 0
    none = langid.fit(docs.limit(0))
    assert {r["language"]["lang"] for r in langid.identify(odd, none).collect()} == {"und"}
    whole = model.entropies(["bake milu" * 500])
    monkeypatch.setattr(langid, "PIECE", 50)
    assert model.entropies(["bake milu" * 500, "x"])[0] == pytest.approx(whole[0], rel=1e-5)


def test_training_rows_are_bounded(spark):
    """Copies of one id and over-long texts don't add to what the driver gets."""
    docs = [(1, f"der hund und die katze {i}", "de") for i in range(50)] + [(i, "the dog and the cat " + str(i), "en") for i in range(2, 9)] + [(99, "x " * 600_000, "en")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    seen = {}
    real, langid.train = langid.train, lambda texts: seen.update(texts)
    try:
        langid.fit(table, max_rows=5)
    finally:
        langid.train = real
    assert {k: len(v) for k, v in seen.items()} == {"de": 5, "en": 5} and max(len(t) for v in seen.values() for t in v) < 100


def plain_language(model, text):
    """lang, score and accepted by loops: each character after its context, from the highest order that knows it."""
    letters = [c for c in text or ""]
    low = [c.lower() if len(c.lower()) == 1 else c for c in letters]
    codes = [ord(x) if c.isalpha() else 0 for c, x in zip(letters, low, strict=True)]
    if not any(codes):
        return "und", 0.0, False
    squeezed = [0]
    for c in [*codes, 0]:
        if c or squeezed[-1]:
            squeezed.append(c)
    line = [0] * (langid.ORDER - 2) + squeezed
    tables = [{int(k): logs[i] for i, k in enumerate(h.keys)} for h, logs in zip(model.grams, model.logs, strict=True)]
    back = [{int(k): logs[i] for i, k in enumerate(h.keys)} for h, logs in zip(model.contexts, model.backoff, strict=True)]
    total, n = np.zeros(len(model.languages)), 0
    for at in range(len(line) - langid.ORDER + 1):
        window = np.array(line[at : at + langid.ORDER], np.uint32)
        for order in range(langid.ORDER, 0, -1):
            key = int(langid.grams(window, order)[0])
            if key in tables[order - 1]:
                total += tables[order - 1][key]
                break
            if order > 1:
                total += back[order - 1].get(int(langid.contexts(window, order)[0]), 0)
        else:
            total += model.floor
        n += 1
    h = (-total / n).tolist()
    best = min(range(len(h)), key=h.__getitem__)
    score = 1 / sum(math.exp(-(x - h[best]) * model.temperature) for x in h)
    return model.languages[best], score, h[best] <= model.limit[best]


def test_identify_against_loops(spark, texts, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 300)
    model = langid.train({x: t[:30] for x, t in texts.items()})
    rnd = random.Random(8)
    rows = [None, "", "12 .!", "ba", "Qx zz 9 yw", "\u0130 \U0001d400 ß"] + [made(rnd.choice("aa bb cc".split()), n, rnd) for n in (1, 3, 50, 900)] + [made("aa", 5, rnd) + " 1 " + made("bb", 5, rnd).upper()]
    docs = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(rows)], "doc_id long, `my.text` string, language string")
    got = {r["doc_id"]: r["language"] for r in langid.identify(docs, model, "my.text").collect()}
    for i, t in enumerate(rows):
        lang, score, accepted = plain_language(model, t)
        assert (got[i]["lang"], got[i]["accepted"]) == (lang, accepted) and got[i]["score"] == pytest.approx(score, abs=1e-4), t
    named = spark.createDataFrame([(i, t, x) for x in texts for i, t in enumerate(texts[x][:12])], "`my.id` long, `my.text` string, `the.lang` string")
    assert langid.fit(named, 10, "my.id", "my.text", "the.lang").languages == sorted(texts)
