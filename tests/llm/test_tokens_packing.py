"""Token files and packing against the library, a plain best fit and exact round trips."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from cliploom.llm import packing, token_files, tokens
from cliploom.llm.common import table
from cliploom.llm.queries import BYTE_VOCABULARY, QUERIES, WORD_VOCABULARY
from cliploom.llm.tokens import byte_encoder, word_encoder
from cliploom.session import scratch_path

ODD = [
    None, "", " ", "  a  b ", "a\n b\n\nc\t d", "d's we'll, re.", "İß ﬁ é é 　x", "<|endoftext|> a<|endoftext|>b",
    "a | b|c ###", "x\x1cy \x1c z", "漢字 12 3４", "ok... no! #1 ?\n", "same same", "same same", "w " * 3000, "́a ́",
]


def library(path, plain_specials=False):
    tokenizer = Tokenizer.from_file(path)
    if plain_specials:
        tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("plain_specials", [False, True])
@pytest.mark.parametrize("memo", [200_000, 20])
@pytest.mark.parametrize("kind, path", [(word_encoder, WORD_VOCABULARY), (byte_encoder, BYTE_VOCABULARY)])
def test_ids_equal_the_librarys(monkeypatch, kind, path, memo, plain_specials):
    monkeypatch.setattr(tokens, "MEMO", memo)
    rng, letters = np.random.default_rng(0), [*"ab \n\t|'sé.,#1AB", "́", "İ", "ß", "<|endoftext|>", "<|startoftext|>", " <|endoftext|> "]
    texts = ODD + ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(500)]
    texts += ["Word, word. WORD word <|endoftext|>", "x <|endoftext|>y", "\n<|endoftext|>\n", "a<|endoftext|>"]
    want = library(path, plain_specials)
    for some in (texts[:100], texts, texts[::-1]):  # from the memo later
        for text, got in zip(some, kind(path, plain_specials).encode(some), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want(text), text


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, part int, length int")


def test_token_files_hold_every_document_in_order(spark):
    rows = [(i if i % 5 else None, t, "x", 1, 2) for i, t in enumerate(ODD)] + [(3, "again", "x", 1, 2)] * 3
    folder, want = scratch_path(spark, "tokens"), library(WORD_VOCABULARY)
    token_files.write(documents(spark, rows), folder, WORD_VOCABULARY)
    back = sorted(token_files.digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back)])[:-1].tolist()
    assert Counter((r.doc_id, r.ids_crc32) for r in back) == Counter((i, crc([*want(t), 2])) for i, t, *_ in rows)
    one = token_files.read(spark, folder, ids=[7]).collect()
    assert [list(r.ids) for r in one] == [[*want(ODD[7]), 2]]
    assert {r.doc_id for r in token_files.read(spark, folder, between=(2, 4)).collect()} == {2, 3, 4}


def test_token_files_prune_by_metadata(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('word ', id) as text")
    folder = str(tmp_path / "ids")
    token_files.write(docs, folder, WORD_VOCABULARY)
    plan = token_files.read(spark, folder, ids=[123])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(doc_id,123)" in plan
    files = [orc.ORCFile(str(p)) for p in (tmp_path / "ids").glob("*.orc")]
    assert sum(f.nrows for f in files) == 20_000 and all(f.row_index_stride == 1000 for f in files)


def test_token_files_of_no_documents(spark):
    folder = scratch_path(spark, "tokens")
    token_files.write(documents(spark, []), folder, WORD_VOCABULARY)
    assert token_files.digests(spark, folder).collect() == []


def plain_best_fit(counts, size):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, room in enumerate(bins) if room >= length]
            if fits:
                bins[min(fits, key=bins.__getitem__)] -= length
            else:
                bins.append(size - length)
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_bulk_best_fit_equals_one_by_one(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    counts = {int(k): int(rng.integers(1, 30)) for k in rng.integers(1, size + 1, 12)}
    placements, used = packing.best_fit_decreasing(counts, size)
    bins = plain_best_fit(counts, size)
    assert used == len(bins)
    rooms = [size] * used
    for length, n in counts.items():
        own = sorted((p for p in placements if p.length == length), key=lambda p: p.rank)
        for p, end in zip(own, [*(q.rank for q in own[1:]), n], strict=True):
            for k in range(end - p.rank):
                rooms[p.sequence + k // p.each] -= length
    assert sorted(rooms) == sorted(bins)


def check_packing(rows, texts, size):
    want, sequences = library(BYTE_VOCABULARY), defaultdict(list)
    expected = Counter()
    for doc_id, text in texts:
        ids = [*want(text), 2]
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        expected.update((doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter(tuple(r)[:5] for r in rows) == expected
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_packing_covers_every_token_once_without_gaps(spark):
    rows = [(i if i % 5 else None, t, "x", 1, 2) for i, t in enumerate(ODD)] + [(3, "again", "x", 1, 2)] * 40
    got = packing.pack_documents(documents(spark, rows), BYTE_VOCABULARY, size=64).collect()
    n = check_packing(got, [r[:2] for r in rows], 64)
    assert n == len(plain_best_fit(Counter(r.length for r in got), 64))
    assert packing.pack_documents(documents(spark, []), BYTE_VOCABULARY).collect() == []


def test_registered_queries_cover_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = QUERIES["op7_best_fit_packing"](spark, sf_dir).collect()
    n = check_packing(got, docs, 1024)
    assert n <= 1.02 * -(-sum(r.length for r in got) // 1024) + 1
    want, start = library(WORD_VOCABULARY), 0
    rows = {r.doc_id: r for r in QUERIES["op1_token_files"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for doc_id, text in sorted(docs):
        ids = [*want(text), 2]
        assert (rows[doc_id].start, rows[doc_id].n_tokens, rows[doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_are_compressed_with_lz4(spark):
    folder = scratch_path(spark, "tokens")
    token_files.write(documents(spark, [(1, "some words", "x", 0, 0), (2, None, "x", 0, 0)]), folder, WORD_VOCABULARY)
    paths = [f.removeprefix("file:") for f in spark.read.orc(folder).inputFiles()]
    assert {orc.ORCFile("/" + p.lstrip("/")).compression for p in paths} == {"LZ4"}


WIDE = [*"\x85\xa0     　", "«", "”", "—", "é", "か", "́", "\x1c", "\r\n"]


@pytest.mark.parametrize("kind, path", [(word_encoder, WORD_VOCABULARY), (byte_encoder, BYTE_VOCABULARY)])
def test_columns_are_cut_where_the_library_joins_nothing(kind, path):
    rng, letters = np.random.default_rng(1), [*WIDE, *"aZ  \n\n.,'", "<|endoftext|>", "H̱", "≮"]
    texts = [None, "", *("".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(2000)), None, ""]
    texts += [f"{a}{gap}{b}" for a in ("x", *WIDE) for gap in " \n," for b in ("y", *WIDE)]
    column, want, encoder = pa.array(texts), library(path), kind(path)
    for some in (column.slice(1000), column.slice(1, 900), column.slice(0, 2), column.slice(0, 0), column.cast(pa.large_string())):
        ids, at = encoder.encode_column(some, np.array([2], "<u4").tobytes())
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*want(t), 2] for t in some.to_pylist()]


def test_special_tokens_with_spaces_are_not_cut(tmp_path):
    path = str(tmp_path / "vocabulary.json")
    tokenizer = Tokenizer.from_file(BYTE_VOCABULARY)
    tokenizer.add_special_tokens(["<end of text>"])
    tokenizer.save(path)
    texts = ["one <end of text> two", None, "", "one, <end of", "<end of text>"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in byte_encoder(path).encode(texts)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def counted(monkeypatch, encoder, name):
    """Arguments of the calls of a method from now on."""
    calls, method = [], getattr(encoder, name)
    monkeypatch.setattr(encoder, name, lambda piece: (calls.append(piece), method(piece))[1])
    return calls


@pytest.mark.parametrize("spaced, path", [(False, WORD_VOCABULARY), (True, BYTE_VOCABULARY)])
def test_a_word_is_one_piece_with_any_marks_behind_it(monkeypatch, spaced, path):
    words, marks = [f"word{c}{d}" for c in "abcdefg" for d in "abcdefg"], [",", ".", "!", "?", ";", ":", "$$$", "***", ")", '"']
    text = "start " + " ".join(w + m for m in marks for w in words) + " end"
    encoder = tokens.Encoder(path, spaced)
    calls = counted(monkeypatch, encoder, "_piece")
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library(path)(text)
    assert len(calls) <= len(words) + len(marks) + 2  # 493 when words with marks were pieces


def test_words_behind_line_ends_are_remembered(monkeypatch):
    texts = [f"first\n{word} then\n{word}" for word in ("one", "two", "three")] * 2
    encoder, want = tokens.Encoder(BYTE_VOCABULARY, True), library(BYTE_VOCABULARY)
    calls = counted(monkeypatch, encoder, "_word")
    for _ in range(2):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == [want(t) for t in texts]
    assert sorted(calls) == [" then", "first", "one", "three", "two"]  # 32 calls when only words behind spaces were remembered
