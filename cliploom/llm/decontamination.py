"""Benchmark decontamination: find test items inside training texts with a suffix automaton, cut them out.

Words are runs of ASCII letters, digits and bytes above 0x7F, ASCII letters lower-cased. A window
is ``WINDOW`` consecutive words of an item; an item with fewer words (but not none) is one
window. A word of a document is hit when it lies in an occurrence of a window.

The words of all items make a generalised suffix automaton. Streaming a document through it
tracks the longest run of words, ending here, that some item contains. Stretches without two
neighbouring words that are neighbours in an item cannot match and are passed over in NumPy.
Items are taken in shards of bounded size, so the automaton a task holds is bounded too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.llm.common import fresh, kept
from cliploom.llm.textbytes import ALPHANUMERIC, LOWER_ASCII, Substrings, blocks, flat, words

WINDOW = 10
SHARD_BYTES = 1 << 20  # text of items in one automaton


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of word numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)

    def _state(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(steps)
        return len(self.length) - 1

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return self._split(last, word, there)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.next[at][word])
        return new

    def _split(self, at: int, word: int, there: int) -> int:
        """The state of exactly the strings up to length(at) + 1 that reach ``there`` from ``at``."""
        if self.length[there] == self.length[at] + 1:
            return there
        copy = self._state(self.length[at] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """Longest suffix of (what was matched, word) that a sequence contains."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        there = self.next[state].get(word)
        return (0, 0) if there is None else (there, length + 1)


class Matcher:
    """The automaton of a shard of items, and which windows belong to which items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        data, at = flat(pa.array([text or "" for _, text in items], pa.string()))
        data = LOWER_ASCII[data]
        starts, ends, owner = words(data, at, ALPHANUMERIC)
        self.vocabulary, ids = np.unique(Substrings(data).hash(starts, ends), return_inverse=True)
        self.window = window
        self.automaton = SuffixAutomaton()
        sequences = defaultdict(list)
        for item, word in zip(owner.tolist(), ids.tolist(), strict=True):
            sequences[item].append(word)
        for sequence in sequences.values():
            self.automaton.add(sequence)
        self.shortest = min([window, *map(len, sequences.values())]) if sequences else window
        pairs = [p for s in sequences.values() for p in zip(s, s[1:], strict=False)]
        self.pairs = np.unique(np.array([a << 32 | b for a, b in pairs], dtype=np.int64))
        self._whole = self._windows_at()
        self.items: dict[int, set[str]] = defaultdict(set)  # state that covers a window's length: items with it
        self.short: dict[int, list[tuple[int, set[str]]]] = defaultdict(list)  # state: short items, with their lengths
        for item, sequence in sequences.items():
            name, state, length = str(items[item][0]), 0, 0
            for word in sequence:
                state, length = self.automaton.step(state, length, word)
                if length >= window:
                    self.items[self._whole[state]].add(name)
            if length < window:
                same = next((names for k, names in self.short[state] if k == length), None)
                if same is None:
                    self.short[state].append((length, same := set()))
                same.add(name)

    def _windows_at(self) -> list[int]:
        """For each state, the state (itself or up its links) that covers strings of the window's length."""
        a, found = self.automaton, [0] * len(self.automaton.length)
        for state in sorted(range(1, len(found)), key=a.length.__getitem__):
            above = a.link[state]
            found[state] = state if a.length[above] < self.window <= a.length[state] else found[above]
        return found

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that no item has."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def stretches(self, numbers: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
        """Half-open ranges of words, each in one text, outside which nothing can match."""
        if self.shortest == 1:
            on = np.flatnonzero(numbers >= 0)
            together = (np.diff(on) == 1) & (np.diff(owner[on]) == 0)
            least = 1
        else:
            linked = (numbers[:-1] >= 0) & (numbers[1:] >= 0) & (owner[:-1] == owner[1:])
            on = np.flatnonzero(linked)
            on = on[np.isin(numbers[on] << 32 | numbers[on + 1], self.pairs)]
            together = np.diff(on) == 1
            least = self.shortest - 1
        if not len(on):
            return []
        cuts = np.flatnonzero(~together) + 1
        first, last = on[np.r_[0, cuts]], on[np.r_[cuts, len(on)] - 1] + 1
        long = last - first >= least
        return list(zip(first[long].tolist(), (last[long] + (self.shortest > 1)).tolist(), strict=True))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words of a stretch are hit, and the items whose windows occur in it."""
        hit, found = np.zeros(len(numbers), bool), set()
        state = length = 0
        step, whole, window = self.automaton.step, self._whole, self.window
        link, covers = self.automaton.link, self.automaton.length
        for i, word in enumerate(numbers.tolist()):
            state, length = step(state, length, word) if word >= 0 else (0, 0)
            if length >= window:
                hit[i + 1 - window : i + 1] = True
                found |= self.items[whole[state]]
            if self.short and length:
                at, reach = state, length
                while at > 0:
                    for k, names in self.short.get(at, ()):
                        if k <= reach:
                            hit[i + 1 - k : i + 1] = True
                            found |= names
                    at = link[at]
                    reach = covers[at]
        return hit, found

    def scan(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, dict[int, tuple[list[list[int]], set[str]]]]]:
        """For each block of texts: words per text and, of texts with hits, [number, first byte, end]
        of each hit word, and the items."""
        for _, _, data, at in blocks(texts):
            data = LOWER_ASCII[data]
            starts, ends, owner = words(data, at, ALPHANUMERIC)
            numbers = self.numbers(Substrings(data).hash(starts, ends))
            counts = np.bincount(owner, minlength=len(at) - 1)
            before = np.r_[0, np.cumsum(counts)]
            found: dict[int, tuple[list, set]] = {}
            for first, last in self.stretches(numbers, owner):
                hit, names = self.hits(numbers[first:last])
                if names:
                    text = int(owner[first])
                    own = np.flatnonzero(hit) + first
                    spans = np.stack([own - before[text], starts[own] - at[text], ends[own] - at[text]], 1).tolist()
                    others, items = found.get(text, ([], set()))
                    found[text] = others + spans, items | names
            yield counts, found


def matchers(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Matcher]:
    """A matcher per shard of items; one for all items while their texts take ``SHARD_BYTES`` at most."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = -(-size // SHARD_BYTES) or 1
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        yield Matcher([(r.item_id, r.text) for r in part.toLocalIterator()], window)


def find(docs: DataFrame, shards: Sequence[Matcher], names: tuple[str, str, str]) -> DataFrame:
    """docs with three more columns: number of words, hit words as [number, first byte, end], items."""
    count, hits, items = names
    added = T.StructType.fromDDL(f"{count} bigint, {hits} array<array<int>>, {items} array<string>")
    shape = T.StructType([*docs.schema.fields, *added.fields])
    found = docs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in added.fields})
    for i, matcher in enumerate(shards):
        # Each shard adds its hits to those of the shards before.
        found = (kept(found, "hits") if i else found).mapInArrow(_adds(matcher), shape)
    return found


def _adds(matcher: Matcher) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, _, hits, items = batch.columns
            hits, items = hits.to_pylist(), items.to_pylist()
            counts, row = [], 0
            for n, found in matcher.scan(batch.column("text")):
                for text, (spans, names) in found.items():
                    at = row + text
                    hits[at] = sorted({tuple(x) for x in [*(hits[at] or ()), *spans]})
                    items[at] = sorted({*(items[at] or ()), *names})
                counts.append(n)
                row += len(n)
            counts = pa.array(np.concatenate(counts) if counts else [], pa.int64())
            added = [counts, pa.array(hits, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*others, *added], batch.schema.names)

    return add


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs (doc_id, text): number of words, hit words, and the items with occurring windows.

    Null and empty texts have no words. Repeated rows stay. An item without words occurs nowhere;
    a null item_id reads "None". Without items nothing is hit. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return find(rows, list(matchers(benchmark, window)), ("n_words", "hits", "items")).select(
        "doc_id", "n_words", F.coalesce(F.size("hits"), F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array()).alias("items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """Cut hit words, and what stands between two that are neighbours, out of ``text``; drop documents
    of whose words more than the share ``max_coverage`` is hit. Rows without hits stay as they are,
    null and empty texts too. Columns are those of docs.
    """
    names = tuple(fresh(docs, n) for n in ("n_words", "hits", "items"))
    *others, last = matchers(benchmark, window)
    found = find(docs, others, names)
    return (kept(found, "hits") if others else found).mapInArrow(_cuts(last, max_coverage), docs.schema)


def _cuts(matcher: Matcher, max_coverage: float) -> Callable:
    """Adds a shard's hits and applies all in the same pass, so that texts go to Python once."""
    add = _adds(matcher)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in add(batches):
            *own, counts, spans, _ = batch.columns
            place, spans = batch.schema.get_field_index("text"), spans.to_pylist()
            texts = own[place]
            if any(spans):
                own[place] = pa.array([without(t, x) if x else t for t, x in zip(texts.to_pylist(), spans, strict=True)], texts.type)
            keep = [len(x or ()) <= n * max_coverage for x, n in zip(spans, counts.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(own, batch.schema.names[:-3]).filter(pa.array(keep, pa.bool_()))

    return cut


def without(text: str, hit_words: list[list[int]]) -> str:
    """The text without hit words; neighbours go together with what stands between them."""
    raw, kept_parts, at, last = text.encode(), [], 0, -2
    for number, start, end in hit_words:
        if number != last + 1:
            kept_parts.append(raw[at:start])
        at, last = end, number
    return b"".join([*kept_parts, raw[at:]]).decode()
