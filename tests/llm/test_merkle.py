import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from paywire.llm import blocks, merkle, oracles, queries


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(*values):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(part, values)))


def plain(rows):
    """rows: (group, id, leaf) -> (group, id, leaf, subroot, root, siblings) with digests as hex text."""
    null_first = lambda x: (x is not None, x if x is not None else 0)
    groups = {}
    for g, k, leaf in rows:
        groups.setdefault(g, []).append((k, leaf))

    def tree(nodes):
        levels, beside = [nodes], [[] for _ in nodes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            for i in range(len(nodes)):
                j = i >> 3 * (len(levels) - 1)
                run = range(j & ~7, min((j & ~7) + 8, len(now)))
                beside[i] += [now[k] for k in run if k != j]
            levels.append([sha("".join(now[k : k + 8])) for k in range(0, len(now), 8)])
        return levels[-1][0], beside

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = []
    for g in names:
        inside = sorted(groups[g], key=lambda x: (null_first(x[0]), x[1]))
        done.append((g, inside, *tree([leaf for _, leaf in inside])))
    root, above = tree([d[2] for d in done])
    return [(g, k, leaf, subroot, root, "".join(own + above[t])) for t, (g, inside, subroot, beside) in enumerate(done) for (k, leaf), own in zip(inside, beside, strict=True)]


def built(spark, rows, **how):
    leaves = spark.createDataFrame([(g, k, bytearray.fromhex(leaf), "x") for g, k, leaf in rows], "group string, id long, leaf binary, root string")
    return merkle.build(leaves.drop("root"), **how)


def shown(found):
    return sorted((r["id"] is not None, r["id"] or 0, r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), r["siblings"].hex()) for r in found.collect())


CASES = {
    "one": [("a", 1, sha("1"))],
    "lone leaves": [(g, i, sha(f"{g}{i}")) for i, g in enumerate([None, "", "b", "a", "ä", "B"])],
    "edges": [(f"g{n:03}", i, sha(f"{n} {i}")) for n in (1, 2, 7, 8, 9, 15, 64, 65, 73) for i in range(n)],
    "many groups": [(f"t{i % 90}", i, sha(str(i))) for i in range(400)],
    "ties": [("a", 5, sha("same"))] * 30 + [("a", None, sha("n"))] * 3 + [("a", 4, sha(str(i % 4))) for i in range(12)] + [(None, 4, sha("q"))] * 9,
}


@pytest.mark.parametrize("case", CASES)
def test_against_plain_trees(spark, case):
    rows = CASES[case]
    want = sorted((k is not None, k or 0, leaf, s, r, b) for _, k, leaf, s, r, b in plain(rows))
    for how in ({}, {"max_rows": 5}):
        assert shown(built(spark, rows, **how).proofs()) == want


def test_many_tasks_and_blocks(spark):
    """Several rounds of merging: over 16 tasks, blocks of a few leaves, one group with most of the rows."""
    rows = [("hot" if i % 10 else f"g{i % 7}", i, sha(str(i))) for i in range(1500)]
    leaves = spark.createDataFrame([(g, k, bytearray.fromhex(x)) for g, k, x in rows], "group string, id long, leaf binary")
    ordered = leaves.withColumn("group", F.concat(F.lit("="), "group")).repartitionByRange(40, "group", "id").sortWithinPartitions("group", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = blocks.blocks_of(ordered, 7)
        assert cut.select("place").distinct().count() > 16
        found = merkle._of_blocks(cut)
        assert found.families.count() > 50
        assert shown(found.proofs()) == sorted((True, k, *x) for _, k, *x in plain(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_merging_is_associative():
    """Any way to merge the same fragments resolves the same families and leaves the same nodes."""
    nodes = [(0, 100, 0, i, hashlib.sha256(str(i).encode()).digest()) for i in range(100)] + [(1, 3, 0, i, b"x" * 32) for i in range(3)]

    def merged(parts):
        forest = merkle.Forest(2)
        for part in parts:
            for node in part:
                forest.add(*node)
        return forest

    whole = merged([nodes])
    assert set(whole.roots) == {0, 1, merkle.TOP} and not list(whole.left())
    for cuts in ([13, 50, 77], [1, 2, 3, 99], [40]):
        parts = [nodes[a:b] for a, b in zip([0, *cuts], [*cuts, None], strict=True)]
        forests = [merged([p]) for p in parts]
        left = merged([list(f.left()) for f in forests[:2]])
        right = merged([list(f.left()) for f in forests[2:]])
        last = merged([list(left.left()), list(right.left())])
        families = [x for f in (*forests, left, right, last) for x in f.families]
        assert sorted(families) == sorted(whole.families)
        assert [f.roots[merkle.TOP] for f in (left, right, last) if merkle.TOP in f.roots] == [whole.roots[merkle.TOP]]


def test_a_reader_checks_one_proof(spark):
    found = built(spark, CASES["edges"] + CASES["many groups"], max_rows=50)
    for r in found.proofs().collect():
        assert merkle.fold(r["leaf"], r["tree"], r["index"], r["size"], found.n_trees, r["siblings"]) == r["root"]
        assert merkle.fold(b"y" * 32, r["tree"], r["index"], r["size"], found.n_trees, r["siblings"]) != r["root"]


def test_leaves_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "s", "en", 3, "AbC"), (None, "s", "en", -5, "ÄB"), (3, "", "", 0, ""), (4, "s", "en", 9, "X" * 400_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "`doc.id` long, source string, lang string, n_chars long, text string, leaf int")
    columns = ["doc.id", "source", "lang", "n_chars", "text"]
    got = {r["id"]: r for r in merkle.document_leaves(docs, "doc.id", "lang", columns, F.col("`doc.id`") > 1).collect()}
    for k, source, lang, n, text in rows:
        assert got[k]["leaf"].hex() == leaf_of(k, source, lang, n, text)
        want = leaf_of(k, source, lang, n, "".join(c.lower() if c.isascii() else c for c in text)) if k and k > 1 else None
        assert (got[k]["changed"].hex() if got[k]["changed"] else None) == want
    assert merkle.build(merkle.document_leaves(docs.limit(0), "doc.id", "lang", columns)).proofs().count() == 0


def test_query_on_odd_tables(spark, tmp_path):
    """The registered query: NULL languages and ids, equal rows, tampering; against plain trees."""
    rows = [(i if i % 9 else None, f"Text {i % 7} A", ["en", "de", None, "é"][i % 4], "s", i) for i in range(60)] + [(5, "Text", "en", "s", 1)] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect())
    want = plain([(g, k, leaf_of(k, s, g, n, t)) for k, t, g, s, n in rows])
    assert got == sorted((k is not None, k or 0, leaf, s, r, sha(b)) for _, k, leaf, s, r, b in want)
    for r in queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect():
        assert r["verified"] == (r["folded_root"] == r["root"]) == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0)
    assert "op11_merkle_manifest" in oracles.ORACLE_SQL
