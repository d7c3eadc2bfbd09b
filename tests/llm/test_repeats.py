"""Removal of repeated windows against a dictionary of all windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from cliploom.llm import repeats
from cliploom.llm.common import table
from cliploom.llm.queries import QUERIES

W = repeats.WINDOW


def plain(rows):
    """(doc_id, text) in order of ids: covered bytes of windows that an earlier one equals."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - W + 1):
            window = raw[at : at + W]
            if window in seen:
                gone[at : at + W] = True
            seen.add(window)
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int(np.diff(np.r_[False, gone].astype(int)).clip(0).sum())
        out.append((len(raw), int(gone.sum()), spans, left))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (30, 60, 25, 18, 200)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.integers(0, 40)))]
        for k in rng.integers(0, len(passages), rng.integers(0, 4)):
            cut = rng.integers(0, 40)
            parts += [passages[k][cut:], word()]
        rows.append((i * 3, " ".join(parts)))
    rows += [(500 + i, rows[7][1]) for i in range(20)]
    rows += [(600, "a" * 500), (601, "ab" * 300), (602, "a" * 99), (603, None), (604, ""), (605, "x" * 100), (606, "x" * 100)]
    return rows


def check(got, rows):
    for row, (n, removed, spans, left) in zip(got, plain(rows), strict=True):
        assert (row.n_bytes, sum(s.end - s.start for s in row.removed), len(row.removed), bytes(row.kept)) == (n, removed, spans, left), row.doc_id


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_all_windows(spark, seed):
    rows = corpus(seed)
    order = np.random.default_rng(seed).permutation(len(rows))
    docs = spark.createDataFrame([(*rows[i], 1, "x") for i in order], "doc_id bigint, text string, doc int, spans string")
    got = sorted(repeats.remove_repeats(docs).collect(), key=lambda r: r.doc_id)
    check(got, rows)


def test_common_grams_and_small_blocks(spark, monkeypatch):
    """Every gram counts as frequent in the sample's terms; one passage is in all documents."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    shared = " ".join(words[:40])
    rows = [(i, f"{' '.join(rng.choice(words, 30))} {shared[: 150 + i % 90]} {' '.join(rng.choice(words, 5))}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(sorted(repeats.remove_repeats(docs).collect(), key=lambda r: r.doc_id), rows)


def test_repeated_and_null_ids(spark):
    text = "lorem ipsum " * 3 + "".join(map(str, range(80)))
    rows = [(None, text), (1, text), (1, text), (2, "x" + text), (2, "y" + text), (3, text)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(bytes(r.kept))
    assert by_id[None] == [text.encode()] and by_id[1] == [b"", b""] and by_id[3] == [b""]
    assert sorted(by_id[2]) == [b"x", b"y"]


def test_no_rows(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_registered_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    got = sorted(QUERIES["op10_repeated_windows"](spark, sf_dir).collect(), key=lambda r: r.doc_id)
    want = [(i, n, removed, spans, hashlib.sha256(left).hexdigest()) for (i, _), (n, removed, spans, left) in zip(rows, plain(rows), strict=True)]
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("texts", [["zz"], [""], [None], ["zz", "", None, "x" * 99], ["zz", "a" * 250]])
def test_blocks_of_short_texts(spark, texts):
    """One text per partition: blocks that hold no window at all."""
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(len(rows), "doc_id")
    check(sorted(repeats.remove_repeats(docs).collect(), key=lambda r: r.doc_id), rows)


@pytest.mark.parametrize("limit", ["64k", "256k"])
def test_no_large_table_is_broadcast(spark, tmp_path, monkeypatch, limit):
    """Few texts of many repeats: 2 MB of spans, 0.7 MB of texts and 0.1 MB of opened runs, in files of 0.2 and 0.02 MB."""
    rng = np.random.default_rng(0)
    passages = ["".join(rng.choice(list("abcdefgh "), 300)) for _ in range(40)]
    rows = [(i, " ".join(passages[k] for k in rng.permutation(40))) for i in range(60)]
    docs = [*rows, rows[3]]  # a row that comes twice
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    plan, plans = lambda df: df._jdf.queryExecution().executedPlan().toString(), {}
    monkeypatch.setattr(repeats, "kept", lambda df, tag, kept=repeats.kept: plans.update({tag: plan(df)}) or kept(df, tag))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, limit)
        found = repeats.remove_repeats(spark.read.parquet(str(tmp_path / "docs")))
        plans["found"] = plan(found)
        got = sorted(found.collect(), key=lambda r: r.doc_id)
    finally:
        spark.conf.set(key, before)
    assert len(got) == 61 and got[3] == got[4]
    check([*got[:4], *got[5:]], rows)
    joins = {tag: "Broadcast" in text for tag, text in plans.items() if "Join" in text}
    assert joins == {"numbered": False, "spans": limit == "256k", "found": False}  # of spans: the join with opened runs
