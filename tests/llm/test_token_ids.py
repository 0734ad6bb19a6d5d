import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paywire.llm import token_ids
from paywire.llm.tokens import Encoder

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ENCODERS = {(p, special): Encoder(p, max_chunks=50, special_as_text=special) for p in (WORDS, BYTES) for special in (False, True)}
LIBRARY = {key: Tokenizer.from_file(key[0]) for key in ENCODERS}  # unaltered, but for the option
for key, own in LIBRARY.items():
    if key[1]:
        own.encode_special_tokens = True
LETTERS = st.sampled_from("ab Z'\n\t\r  \x0b\xa0é,.1９Σς 　<|>́İß\x1c\x85!日本\U0001f600")


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS | st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "endoftext|>"]), max_size=60).map("".join))
def test_memo_equals_library(text):
    for key, e in ENCODERS.items():
        assert np.frombuffer(e.encode(text), "<u2").tolist() == LIBRARY[key].encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("stremvldaS'  \n\t\r\x0b\x0c19.,-|_~@[`{/:×÷ÀÖØÞßöøÿéÉªµ²"), max_size=40).map("".join))
def test_plain_texts_equal_library(text):
    for key, e in ENCODERS.items():
        assert np.frombuffer(e.encode(text), "<u2").tolist() == LIBRARY[key].encode(text, add_special_tokens=False).ids


def test_frequent_parts_stay_in_the_memo():
    """And a piece that is known costs nothing more with punctuation behind it."""
    for path in (BYTES, WORDS):
        e, asked = Encoder(path, max_chunks=40), []
        model = e.model
        e.model = lambda piece, asked=asked, model=model: asked.append(piece) or model(piece)
        word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04}")
        for i in range(0, 2000, 8):
            e.encode(" often " + " ".join(map(word, range(i, i + 8))) + " often. often, often")
        assert sum("often" in p for p in asked) == 1
        assert len(asked) <= 2000 + 2 + 250  # each other word once, with a space before it or not


def test_case_takes_no_entry_of_its_own():
    e, asked = Encoder(WORDS), []
    model = e.model
    e.model = lambda piece: asked.append(piece) or model(piece)
    text = "Often often, OFTEN. Été été; ÉTÉ's often's"
    assert np.frombuffer(e.encode(text), "<u2").tolist() == LIBRARY[WORDS, False].encode(text, add_special_tokens=False).ids
    assert len(asked) == len(e.memo) == 6  # often, été, 's and three marks


def test_memo_is_bounded_within_a_text():
    for path in (BYTES, WORDS):
        e = Encoder(path, max_chunks=50)
        text = " ".join(f"w{i} é{i} 日{i} " + "x" * (65 + i % 7) for i in range(500))
        for own in (text, text.replace("日", "e")):
            ids = np.frombuffer(e.encode(own), "<u2").tolist()
            assert ids == LIBRARY[path, False].encode(own, add_special_tokens=False).ids
            assert len(e.memo) + len(e.memo.older) <= 50
            assert max(map(len, [*e.memo, *e.memo.older])) <= 64


def test_control_strings():
    ids = lambda p, special: np.frombuffer(ENCODERS[p, special].encode("a<|endoftext|>b"), "<u2").tolist()
    assert ids(BYTES, False) == [64, 50256, 65] and 50256 not in ids(BYTES, True)
    assert 49407 in ids(WORDS, False) and 49407 not in ids(WORDS, True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=400))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    code = token_ids.EliasFano.encode(values)
    back, used = token_ids.EliasFano.from_bytes(memoryview(code.to_bytes()), len(values), code.low_bits, len(code.high))
    assert used == len(code.to_bytes())
    assert back.select(np.arange(len(values))).tolist() == values.tolist()
    some = np.arange(len(values))[::-3]
    assert back.select(some).tolist() == values[some].tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.full(20_000, 700))
    assert len(token_ids.EliasFano.encode(values).to_bytes()) * 8 < 20_000 * (2.2 + np.log2(700) + 0.3)


@pytest.mark.parametrize("shard_bytes", [1, 60, 1 << 20])
def test_file_round_trip(spark, tmp_path, shard_bytes):
    texts = {5: "Hello  World", 3: None, 9: "", 1: "naïve\ncafé" * 50, None: "no id", 7: "Hello  World"}
    rows = [(k, t, "x", 0) for k, t in texts.items()] + [(7, "Hello  World", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, k int")
    token_ids.write_token_file(docs, str(tmp_path / "f"), WORDS, shard_bytes=shard_bytes)
    found = [tuple(r) for r in token_ids.read_token_file(spark, str(tmp_path / "f"), with_ids=True).orderBy("start").collect()]
    library, start, want = Tokenizer.from_file(WORDS), 0, []
    for k, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert found == want


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_ids.write_token_file(docs, str(tmp_path / "f"), WORDS)
    assert token_ids.read_token_file(spark, str(tmp_path / "f")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.integers(-(2**63), 2**63 - 1), max_size=40))
def test_document_ids_of_a_shard(ids):
    ids = sorted(ids, key=lambda k: (k is not None, k or 0))
    shard = token_ids.Shard(token_ids.pack_shard(ids, [bytes(2 * (i % 5)) for i in range(len(ids))], 2))
    assert [None if n else int(k) for k, n in zip(shard.doc_ids, shard.nulls, strict=True)] == ids
    assert [len(shard.document(i)) for i in range(len(ids))] == [i % 5 for i in range(len(ids))]


def test_document_ids_take_little_space():
    ids = list(range(10**12, 10**12 + 70_000, 7))
    assert len(token_ids.pack_shard(ids, [b""] * len(ids), 2)) < len(ids) * 1.2


def test_long_text_and_ids_of_other_types(spark, tmp_path):
    docs = spark.createDataFrame([(2, "word " * 100_000), (1, "x" * 200_000)], "doc_id int, text string")
    token_ids.write_token_file(docs, str(tmp_path / "f"), WORDS)
    library = Tokenizer.from_file(WORDS)
    want = [(k, len(library.encode(t, add_special_tokens=False).ids) + 1) for k, t in ((1, "x" * 200_000), (2, "word " * 100_000))]
    assert [(r["doc_id"], r["n_tokens"]) for r in token_ids.read_token_file(spark, str(tmp_path / "f")).orderBy("start").collect()] == want
    with pytest.raises(TypeError, match="integer type"):
        token_ids.write_token_file(docs.selectExpr("cast(doc_id as string) as doc_id", "text"), str(tmp_path / "g"), WORDS)
