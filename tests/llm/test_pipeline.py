"""The pipeline against a brute-force version of its stages, and its contract."""

import hashlib
import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from casehours.llm.common import table
from casehours.llm.queries import tokenizer_file
from tests.llm.helpers import components_of

DATA = "/root/testdata/sf0.01"


def brute(docs: dict, items: list) -> dict:
    docs = {i: t for i, t in docs.items() if t and re.search(r"[^\W\d_]{2}", t)}
    groups = defaultdict(list)
    for i, t in docs.items():
        groups[t].append(i)
    docs = {max(ids): t for t, ids in groups.items()}
    docs = {i: docs[i] for i, c in components_of(docs).items() if i == c}
    return {i: t for i, t in docs.items() if not any(x in t for x in items)}


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    items = [r["text"] for r in table(spark, DATA, "benchmark").collect()]
    expected = brute(docs, items)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(expected)
    tool = Tokenizer.from_file(tokenizer_file(spark, "word_bpe_49k.json"))
    for i, t in expected.items():
        ids = tool.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        assert got[i]["decoded_sha256"] == hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_the_columns_of_documents(spark):
    empty = table(spark, DATA, "documents").limit(0)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "bpe_tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, DATA)
        assert out.columns == empty.columns and out.count() == 0


def test_stages_judge_rows_not_ids(spark):
    import random

    from tests.llm.helpers import DOCS, edited, prose

    rng = random.Random(31)
    item = table(spark, DATA, "benchmark").first()["text"]
    base, other, third = (prose(rng, 120) for _ in range(3))
    near = edited(rng, base, 0.01)
    rows = [(1, base), (5, near), (5, other), (None, near), (None, third), (6, f"{third} x"), (7, "12 34"), (7, prose(rng, 50)), (8, f"{prose(rng, 30)} {item}"), (8, prose(rng, 40)), (None, f"{prose(rng, 30)} {item}"), (None, "!!"), (9, None), (10, prose(rng, 9000)), (3, prose(rng, 60)), (3, prose(rng, 60))]
    rows += [(100 + k, prose(rng, 80)) for k in range(40)]
    df = spark.createDataFrame([(i, t, "en", None, 1, 2, "w") for i, t in rows], DOCS + ", kept int, words string")
    texts = lambda out: sorted((r["text"] or "") for r in out.collect())
    stages = dict(corpus_pipeline.STAGES)
    out = stages["language_id"](spark, df, DATA)
    assert out.columns == df.columns and texts(out) == sorted(t for _, t in rows if t not in (None, "12 34", "!!"))
    out = stages["near_dedup"](spark, df, DATA)
    left = texts(out)
    assert out.columns == df.columns and len([t for t in left if t in (base, near)]) == 1 and len([t for t in left if t.startswith(third)]) == 1
    assert {t for _, t in rows if t and t not in (base, near) and not t.startswith(third)} <= set(left)
    out = stages["decontamination"](spark, df, DATA)
    assert out.columns == df.columns and texts(out) == sorted((t or "") for _, t in rows if item not in (t or ""))
    out = stages["exact_dedup"](spark, df.unionByName(df), DATA)
    assert out.columns == df.columns and texts(out) == sorted({t or "" for _, t in rows})
    out = stages["near_dedup"](spark, df.unionByName(df), DATA)
    assert texts(out) == left
