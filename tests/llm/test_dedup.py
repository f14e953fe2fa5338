"""Exact and near de-duplication."""

import random

import pytest

from chorale.llm import exact_dedup, near_dedup
from tests.llm.helpers import TRICKY, docs, near_components, oracle, same_rows


def test_cuckoo_index_against_a_dictionary():
    rng = random.Random(3)
    index, held = exact_dedup.CuckooIndex(4), {}
    keys = [rng.randbytes(32) for _ in range(3000)]
    for step in range(20_000):
        key = rng.choice(keys)
        if rng.random() < 0.6:
            assert index.insert(key, step) == held.get(key)
            held.setdefault(key, step)
        else:
            assert index.delete(key) == (held.pop(key, None) is not None)
        if step % 1000 == 0:
            assert dict(index.items()) == held
    assert index.live == len(held) and index.resizes > 3
    assert all(index.get(k) == held.get(k) for k in keys)


def test_equal_fingerprints_are_told_apart_by_their_keys():
    index = exact_dedup.CuckooIndex(2)
    keys = [bytes([i]) * 22 + b"samebucket" for i in range(40)]
    assert all(index.insert(k, i) is None for i, k in enumerate(keys[:8]))
    assert [index.get(k) for k in keys[:9]] == [*range(8), None] and index.misses > 0
    # beyond eight no size separates them
    assert all(index.insert(k, i) is None for i, k in enumerate(keys) if i >= 8)
    assert [index.get(k) for k in keys] == [*range(40)] and index.beside and len(index.prints) < 10_000
    assert index.delete(keys[39]) and index.delete(keys[0]) and not index.delete(keys[0]) and index.live == 38
    assert [index.get(k) for k in keys] == [None, *range(1, 39), None]


def test_the_index_decides(spark, data):
    """What map tasks pass on is what their indexes found; hits and resizing happen there."""
    rows = exact_dedup._decided(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text").select("doc_id", "digest")
    index = exact_dedup.CuckooIndex(8)
    for r in rows.collect():
        exact_dedup._join(index, bytes(r.digest), r.doc_id, 1)
    assert index.hits > 0 and index.resizes > 0
    n = sum(1 for _ in index.items())
    got = exact_dedup.build_index(rows).collect()
    assert len(got) == n == rows.count() - index.hits
    assert {bytes(r.digest): (r.keep_id, r.group_size) for r in got} == dict(index.items())


def test_more_equal_fingerprints_than_slots_raise_nothing_silently():
    index = exact_dedup.CuckooIndex(2)
    for i in range(6):
        index.insert(bytes([i]) * 22 + b"samebucket", i)
    assert len(dict(index.items())) == 6


def test_exact_on_tricky_rows(spark):
    table = docs(spark, TRICKY)
    got = exact_dedup.exact_dedup(table).toArrow()
    rows = {(r["doc_id"], r["text_sha256"]): r for r in got.to_pylist()}
    assert got.num_rows == len(TRICKY)
    by_id = {r["doc_id"]: r for r in rows.values()}
    assert by_id[2]["keep_id"] == 1 and by_id[3]["keep_id"] == 3 and by_id[9]["keep_id"] == 4 and by_id[5]["keep_id"] == 5
    assert by_id[4]["group_size"] == 3 and by_id[None]["kept"]
    known = [r for r in TRICKY if r[0] is not None]
    assert same_rows(exact_dedup.exact_dedup(docs(spark, known)).toArrow(), oracle(exact_dedup.ORACLE_SQL, documents=docs(spark, known)))


def test_exact_on_the_table(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    assert same_rows(exact_dedup.op5(spark, data).toArrow(), oracle(exact_dedup.ORACLE_SQL, documents=documents))


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, near_dedup.near_dedup])
def test_empty_table(spark, run):
    assert run(docs(spark, [])).count() == 0


def test_index_takes_insertions_and_deletions(spark):
    digests = lambda rows: spark.createDataFrame([(i, bytearray(d * 24)) for i, d in rows], "doc_id long, digest binary")
    index = exact_dedup.build_index(digests([(1, b"aa"), (2, b"aa"), (3, b"bb")]))
    after = exact_dedup.update_index(index, digests([(0, b"aa"), (9, b"cc"), (5, b"bb")]), digests([(0, b"bb")]).select("digest"))
    got = {bytes(r.digest)[:2]: (r.keep_id, r.group_size) for r in after.collect()}
    assert got == {b"aa": (0, 3), b"bb": (5, 1), b"cc": (9, 1)}


def test_stage_keeps_columns_and_one_of_each(spark):
    table = docs(spark, [(1, "a  b"), (2, "a b"), (3, "c")])
    out = exact_dedup.drop_exact_copies(table)
    assert out.columns == table.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


CLASHES = [
    (3, "a b c d e f"), (4, "a b c d e f"), (4, "a text of its own"), (5, "z"), (5, "z"), (None, "n 1"), (None, "n 1"), (None, "n  1"), (6, "z"), (7, None), (8, ""),
    (9, "x y"), (9, "x  y"),
]


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, near_dedup.drop_near_copies])
def test_stages_judge_rows_not_ids(spark, drop):
    table = docs(spark, CLASHES).selectExpr("*", "1 AS row_id", "2 AS gone_key", "3 AS __chorale_id", "'p' AS `a.b`")
    out = drop(table)
    assert out.columns == table.columns
    got = sorted(((r.doc_id, " ".join((r.text or "").split())) for r in out.collect()), key=str)
    want = [(3, "a b c d e f"), (4, "a text of its own"), (5, "z"), (None, "n 1"), (7, ""), (9, "x y")]
    # empty texts are equal, but not near to anything
    assert got == sorted(want if drop is exact_dedup.drop_exact_copies else [*want, (8, "")], key=str)


def test_near_rows_without_id_and_classes_that_share_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (None, long + " x"), (2, "p q r s t u v w"), (2, long + " y"), (7, "p q r s t u v w"), (9, "nothing like it at all here")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_dedup(docs(spark, rows)).collect()}
    assert got == {(None, 56): (2, False), (None, 57): (2, False), (2, 57): (2, True), (2, 4): (2, True), (7, 4): (2, False), (9, 2): (9, True)}
    kept = near_dedup.drop_near_copies(docs(spark, rows)).collect()
    assert sorted(r.text for r in kept) == sorted([rows[2][1], rows[3][1], rows[5][1]])


def _near(table):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(table).collect()}


def test_near_on_tricky_rows(spark):
    rows = [r for r in dict(TRICKY).items()]
    got = _near(docs(spark, TRICKY))
    known = near_components([r for r in rows if r[0] is not None])
    assert {i: v[:2] for i, v in got.items() if i is not None} == known
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[8] == (known[8][0], 7, False)
    assert got[5] == (1, 4, False)


def test_near_on_the_table(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    assert same_rows(near_dedup.op4(spark, data).toArrow(), oracle(near_dedup.ORACLE_SQL, documents=documents))


@pytest.mark.parametrize("small", [24, 1])
def test_near_against_all_pairs(spark, data, monkeypatch, small):
    """With small = 1 every shared key goes through stars and the prefix join."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    table = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    want = near_components(rows)
    assert {i: v[:2] for i, v in _near(table).items()} == want


def test_large_group_of_near_copies_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # mutations scattered so that many pairs are near the threshold
        words = list(base)
        for k in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"m{i}x{k}"
        rows.append((i, " ".join(words)))
    for i in range(100, 112):  # each a shift of the one before
        rows.append((i, " ".join(f"c{k}" for k in range((i - 100) * 9, (i - 100) * 9 + 100))))
    assert {i: v[:2] for i, v in _near(docs(spark, rows)).items()} == near_components(rows)


def test_signature_keys_guarantee_the_distance():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (200, near_dedup.LANES), dtype=np.uint16)
    b = a.copy()
    for row in range(200):
        b[row, rng.choice(near_dedup.LANES, near_dedup.DISTANCE, replace=False)] ^= 1
    assert ((near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any(axis=1)).all()
