import gc
import itertools
import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paywire.llm import common, packing, tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_every_piece_once_and_no_overflow(lengths):
    which, offset = packing.pack_lengths(lengths, 100)
    for b in range(which.max() + 1 if lengths else 0):
        own = sorted((int(offset[i]), lengths[i]) for i in np.flatnonzero(which == b))
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert 0 < at <= 100


def test_exchanges_empty_bins():
    """A poor start: the search alone must get near the bound, and squared fill must rise."""
    rnd = random.Random(5)
    lengths = [rnd.randint(20, 45) for _ in range(300)]
    bins = packing.Bins([], 100)
    bins.lengths = lengths
    for i in range(0, 300, 2):  # two to a bin, whatever they are
        bins.items.append([])
        bins.fill.append(0)
        bins.change(i // 2, [], [i, i + 1])
    squares = sum(f * f for f in bins.fill)
    bins.improve()
    used = [f for f in bins.fill if f]
    assert sum(f * f for f in used) > squares and max(used) <= 100
    assert sorted(i for x in bins.items for i in x) == list(range(300))
    assert len(used) < 112 and sum(lengths) / 100 <= len(used)


def test_pieces_against_library(spark):
    texts = {1: None, 2: "", 3: "hello there", 4: "a b " * 40, 5: "x" * 5000, None: "no id", 6: "hello there"}
    docs = spark.createDataFrame([(*kv, 1) for kv in texts.items()], "doc_id long, text string, _group int")
    library = Tokenizer.from_file(BYTES)
    want = {}
    for k, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        at, n, piece = 0, len(ids) % 16 or 16, 0
        while at < len(ids):
            want[k, piece] = (at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))
            at, n, piece = at + n, 16, piece + 1
    rows = packing.pack(docs, BYTES, capacity=16, group_tokens=100).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 16
    made = packing.sequences(docs, BYTES, capacity=16).collect()
    assert sum(r["n_tokens"] for r in made) == sum(v[1] for v in want.values()) and all(len(r["ids"]) == 16 for r in made)
    assert packing.pack(docs.limit(0), BYTES).count() == 0


def test_near_the_bound(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, "a " * rnd.randint(1, 1200)) for i in range(800)], "doc_id long, text string")
    rows = packing.pack(docs, BYTES).collect()
    total, used = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert used <= 1.02 * total / 2048 + 2


def test_partners_from_the_whole_group():
    """Best fit leaves 800 + 800, 648 * 3 and 600 * 3; the emptiest bins can only trade with the others."""
    lengths = [n for n in (800, 648, 600) for _ in range(300)]
    start = packing.Bins(lengths, 2048)
    which, _ = packing.pack_lengths(lengths, 2048)
    assert len(start.items) == 350
    fills = np.bincount(which, lengths)
    assert (fills**2).sum() > sum(f * f for f in start.fill) and fills.max() <= 2048 and len(fills) < 335


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(20, 60), min_size=1, max_size=40))
def test_no_step_is_left(lengths):
    """Against brute force over all pairs of bins and up to two pieces of each."""
    bins = packing.Bins(lengths, 100)
    bins.improve()
    assert sorted(i for x in bins.items for i in x) == list(range(len(lengths)))
    used = [b for b, f in enumerate(bins.fill) if f]
    assert all(bins.fill[b] == sum(lengths[i] for i in bins.items[b]) <= 100 for b in used)
    if len(used) <= -(-sum(lengths) // 100):
        return
    parts = {b: {sum(lengths[i] for i in c) for k in range(3) for c in itertools.combinations(bins.items[b], k)} for b in used}
    for a, b in itertools.permutations(used, 2):
        for x, y in itertools.product(parts[a], parts[b]):
            more, less = bins.fill[b] + x - y, bins.fill[a] - x + y
            assert max(more, less) > 100 or more**2 + less**2 <= bins.fill[a] ** 2 + bins.fill[b] ** 2


def test_equal_rows_are_dealt_over_groups(spark):
    docs = spark.range(3000).selectExpr("cast(null as string) as `doc id`", "'the same text' as text", "1 as length")
    rows = packing.pack(docs, BYTES, capacity=16, id_col="doc id", group_tokens=2000).collect()
    groups = {}
    for r in rows:
        groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + 1
    assert len(rows) == 3000 and len(groups) > 3 and max(groups.values()) < 1500 and {r["doc_id"] for r in rows} == {None}


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word and word " * 40_000), (2, "x")], "doc_id long, text string")
    n = len(Tokenizer.from_file(BYTES).encode("word and word " * 40_000, add_special_tokens=False).ids) + 1
    rows = [r for r in packing.pack(docs, BYTES).collect() if r["doc_id"] == 1]
    assert sum(r["length"] for r in rows) == n and len(rows) == -(-n // 2048)


def test_a_long_text_goes_on_in_small_batches(spark):
    """The function that a task runs, on one text of 600,000 ids: what it holds at once doesn't grow with the text."""

    class Rows:
        schema = spark.createDataFrame([], "doc_id long, text string").schema
        select = lambda self, *_: self
        mapInArrow = lambda self, cut, _: cut

    text = "word and word " * 200_000
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": [text, "x"]})
    made = list(packing.pieces(Rows(), BYTES)(iter([batch])))
    assert max(b.nbytes for b in made) < 1_500_000 and len(made) > 1
    rows = pa.Table.from_batches(made).to_pylist()
    ids = tokens.encoder(BYTES).encode(text)
    want = np.append(np.frombuffer(ids, "<u2"), 0).astype("<u4").tobytes()
    assert b"".join(r["ids"] for r in rows if r["doc_id"] == 1) == want and [r["piece"] for r in rows if r["doc_id"] == 2] == [0]
    at = 0
    for r in rows[:-1]:
        assert r["start"] == at and r["length"] == len(r["ids"]) // 4
        at += r["length"]


def test_other_operators_get_the_encoders_memory():
    enc = tokens.encoder(BYTES)
    enc.encode("some words")
    gone = weakref.ref(enc)
    del enc
    gc.disable()
    try:
        common.free_memory()
        assert gone() is None
    finally:
        gc.enable()
