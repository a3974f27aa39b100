import random
import subprocess
import sys

from casehours.llm import chosen_path
from casehours.llm.common import ROW, with_row_ids
from tests.llm.helpers import DOCS, components_of, edited, frame, odd_texts, prose, shingles


def check(spark, texts):
    got = {r["doc_id"]: r for r in chosen_path.near_duplicates(frame(spark, texts)).collect()}
    expected = components_of(dict(enumerate(texts)))
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(shingles(t)) for i, t in enumerate(texts)}
    assert all(r["kept"] == (i == expected[i]) for i, r in got.items())


def test_copies_and_odd_texts(spark):
    rng = random.Random(1)
    texts = odd_texts(rng)
    for _ in range(20):
        base = prose(rng, rng.randint(8, 200))
        texts += [base] + [edited(rng, base, rng.choice([0.01, 0.03, 0.06])) for _ in range(3)]
    check(spark, texts)


def test_dense_group_goes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "NODE", 4)
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    rng = random.Random(2)
    base = prose(rng, 120)
    texts = [base]
    for _ in range(90):  # a walk of edits: similarities from low to high, chains included
        texts.append(edited(rng, rng.choice(texts[-12:]), 0.02))
    called = []
    own = chosen_path.links_in_large_nodes
    monkeypatch.setattr(chosen_path, "links_in_large_nodes", lambda *a: called.append(x := own(*a)) or x)
    check(spark, texts)
    assert called and called[0] is not None


def test_nulls_repeats_and_empty_table(spark):
    text = " ".join("abcdefghij")
    rows = [(None, text, None, None, None), (3, text, None, None, None), (3, text, None, None, None), (5, text, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", n int, component_id int")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in chosen_path.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, None, True), (None, None, True), (3, 3, True), (3, 3, True), (5, 3, False)], key=repr)
    assert chosen_path.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert chosen_path.drop_near_duplicates(df).columns == df.columns


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in pairs], DOCS)


def test_rows_of_one_id_unite_whatever_their_order(spark):
    rng = random.Random(5)
    a, b = prose(rng, 80), prose(rng, 90)
    pairs = [(1, a), (1, b), (2, edited(rng, a, 0.01)), (3, edited(rng, b, 0.01)), (4, prose(rng, 50)), (6, ""), (6, a.upper()), (7, None), (7, " "), (8, prose(rng, 70)), (8, prose(rng, 70))]
    for order in (pairs, [pairs[1], pairs[0], *pairs[2:]], pairs[::-1]):
        got = {(r["doc_id"], r["component_id"], r["kept"]) for r in chosen_path.near_duplicates(rows_of(spark, order)).collect()}
        assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (6, 1, False), (7, 7, True), (8, 8, True)}


def test_drop_leaves_one_of_repeated_rows(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 60) for _ in range(3))
    pairs = [(7, a)] * 5 + [(None, b)] * 4 + [(1, c), (9, edited(rng, c, 0.01)), (3, ""), (3, "")]
    for order in (pairs, pairs[::-1]):
        left = sorted(((r["doc_id"], r["text"]) for r in chosen_path.drop_near_duplicates(rows_of(spark, order)).collect()), key=str)
        assert left == sorted([(7, a), (None, b), (1, c), (3, "")], key=str)


def test_near_dedup_asks_little_of_the_driver(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(80)]
    texts += [edited(rng, t, 0.01) for t in texts[:20]]
    df = frame(spark, texts)
    spark.sparkContext.setJobGroup("near", "near")
    try:
        left = {r["doc_id"] for r in chosen_path.drop_near_duplicates(df).collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert left == {i for i, c in components_of(dict(enumerate(texts))).items() if i == c}
    # every job leaves plans, threads and compiled code with the driver
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near")) <= 80


def test_ids_of_one_text_need_no_join(spark):
    df = rows_of(spark, [(1, "a"), (1, "a"), (2, "b"), (None, "b")])
    keyed = with_row_ids(df, "doc_id", "text")
    assert "Join" not in keyed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r[ROW] for r in keyed.collect())[:3] == [1, 1, 2] and keyed.filter(f"{ROW} >= {1 << 62}").count() == 1
    assert "Join" in with_row_ids(df.unionByName(rows_of(spark, [(2, "c")])), "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()


def test_the_driver_makes_no_hash_tables():
    made = "import tracemalloc; tracemalloc.start(); import casehours.llm.shingles; print(tracemalloc.get_traced_memory()[1])"
    assert int(subprocess.run([sys.executable, "-c", "import numpy; " + made], capture_output=True, text=True, check=True).stdout) < 4_000_000
