"""Vector tree, chat formatting and the pipeline."""

from __future__ import annotations

import json
import re

import numpy as np
import pytest

import corpus_pipeline
from cliploom.llm import chat, vector_tree
from cliploom.llm.common import table
from cliploom.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int, ids string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows], VECTORS)


def plain_search(rows, queries, k=10):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in fine:
        if q in queries:
            near = sorted({(float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in fine if i != q})[:k]
            out[q] = near
    return out


def check(got, want, recall):
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(by_query) == {q for q, near in want.items() if near}
    found = [len({i for _, i in by_query[q]} & {i for _, i in near}) / len(near) for q, near in want.items() if near]
    assert all(len(by_query[q]) == len(near) and by_query[q] == sorted(by_query[q]) for q, near in want.items() if near)
    assert not found or np.mean(found) >= recall
    for q, near in want.items():
        if near and {i for _, i in by_query[q]} == {i for _, i in near}:
            np.testing.assert_allclose([s for s, _ in by_query[q]], [s for s, _ in near], rtol=1e-12)


def test_search_with_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)] + [(2000, None), (2010, [0.0] * 8), (2020, [1.0, None] * 4)]
    rows += [(2030, [float("nan")] * 8), (2040, [float("inf")] * 8), (2050, [1.0] * 5), (None, rows[1][1]), rows[2], (2060, [])]
    queries = {i for i, _ in rows if i is not None and i % 10 == 0}
    table_ = vectors(spark, rows)
    got = vector_tree.search(table_, table_.where("vec_id % 10 = 0")).collect()
    check(got, plain_search([r for r in rows if r[1] is None or len(r[1]) == 8], queries), 0.95)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_search_with_few_candidates(spark, n):
    rows = [(i, [1.0, float(i)]) for i in range(n)]
    table_ = vectors(spark, rows)
    check(vector_tree.search(table_, table_).collect(), plain_search(rows, set(range(n))), 1.0)


def test_registered_search_recalls_neighbours(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, sf_dir, "embeddings").collect()]
    got = QUERIES["op2_vector_tree"](spark, sf_dir).collect()
    check(got, plain_search(rows, {i for i, _ in rows if i % 100 == 0}), 0.9)


def test_best_bin_first_visits_every_leaf_once():
    points = np.random.default_rng(1).normal(size=(2000, 6))
    tree = vector_tree.fit(points, leaf=20)
    order = list(tree.visits(points[5]))
    assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.place(points[5:6])[0]


def test_chat_round_trip(spark):
    odd = ["", "<|turn|>user\nhi<|end|>\n", "&lt; & &amp; <|end|>", "a\nb", "### x", "é\U0001f600 <"]
    rows = [(1, k, role, text) for k, (role, text) in enumerate(zip(["user", "assistant", "as\nsistant", "<role>", "assistant", "assistant"], odd, strict=True))]
    rows += [(2, 0, None, None), (None, None, "assistant", "x"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    said = chat.turns(spark.createDataFrame([(*r, 5) for r in rows], chat.TURNS + ", segment int"))
    made = chat.formatted(said).collect()
    assert sorted(chat.parsed(r.segment) for r in made if r.conv_id == 1) == sorted((r[2], r[3]) for r in rows[:6])
    learned = sorted(chat.unescaped(r.segment[r.loss_start : r.loss_end]) for r in made if r.loss_start is not None)
    assert learned == sorted(r[3] for r in rows if r[2] == "assistant")
    whole = "".join(r.segment for r in sorted((r for r in made if r.conv_id == 1), key=lambda r: r.turn))
    assert whole.count(chat.OPEN) == whole.count(chat.CLOSE) == 6
    counts = {r.conv_id: r.n_turns for r in chat.digests(chat.formatted(said)).collect()}
    assert counts == {1: 6, 2: 1, 3: 2, None: 1}
    assert chat.digests(chat.formatted(said.limit(0))).collect() == []


RECORDS = [
    {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    {"prompt": "q", "response": "a"},
    {"prompt": "q", "completion": "a"},
    {"question": "q", "answer": "a"},
    {"instruction": "q", "output": "a"},
    {"instruction": "s", "input": "q", "output": "a"},
    {"instruction": "q", "input": "", "output": "a"},
]


def test_layouts_by_fingerprint(spark, tmp_path):
    texts = [json.dumps(r) for r in RECORDS] + [None, "no json", '{"other": 1}', "{}"]
    records = spark.createDataFrame(list(enumerate(texts)), "conv_id bigint, record string")
    got = {}
    for r in chat.json_turns(records).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    two = [("user", "q"), ("assistant", "a")]
    assert got == {**dict.fromkeys(range(6), two), 6: [("system", "s"), *two], 7: [("system", "q"), ("assistant", "a")]}
    names = [r.name for r in records.orderBy("conv_id").select(chat.json_layout().alias("name")).collect()]
    assert names[:7] == [layout.name for layout in chat.LAYOUTS[1:]] and names[8:] == [None] * 4
    for name, record in zip("abcdefg", RECORDS[:7], strict=True):
        (tmp_path / name).write_text(json.dumps({"conv_id": 1, **record}))
        frame = spark.read.json(str(tmp_path / name))
        said = [(r.role, r.text) for r in chat.turns(frame).orderBy("turn").collect()]
        assert said[-2:] == two
    with pytest.raises(ValueError):
        chat.turns(spark.range(3))


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    shape = docs.columns
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "x", 0), (10**6 + 1, None, None, None, None)], docs.schema)
    docs, before = docs.union(odd), docs.count() + 3
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == shape, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert before * 0.5 < docs.count() <= before, name
        before = docs.count()
    assert docs.where("doc_id IS NULL OR doc_id >= 1000000").count() == 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == before


def test_pipeline_query(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_nothing_else_imports_the_operators():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent / "cliploom"
    files = [p for p in root.rglob("*.py") if "llm" not in p.parts]
    assert files and not any(re.search(r"\bllm\b", p.read_text()) for p in files)
