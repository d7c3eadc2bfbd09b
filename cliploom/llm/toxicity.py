"""Toxicity by a weighted finite-state grammar of clauses.

A clause is what stands between sentence marks and line ends. Its words become symbols: insult terms,
threat words, targets, negations, reporting words, others. Three transducers read them, each changing
the symbols or adding weight, and are composed into one:

* reported speech: what follows a reporting word, or stands in quotes, counts less; quotes may span clauses of a text;
* negation: an insult or threat up to three words after a negation counts for little;
* address: an insult or threat with a target beside it in the clause counts more.

The weight of a clause is the sum along its path, so the same term weighs more in "you are such a ..."
than in "he did not say ...". Insult terms are learned: words and word beginnings that toxic documents
of a bounded sample have significantly more often, in whatever language. A logistic
curve over the clause weights, fitted on the same sample, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.llm.common import fresh
from cliploom.llm.textbytes import ALPHANUMERIC, LOWER_ASCII, Substrings, blocks, byte_class, words

SAMPLE = 10_000  # labelled documents used for fitting, at most
TERMS = 2_000  # learned terms, at most
BEGINNINGS = range(3, 9)  # bytes of a word's beginning that may be a term
LEAST_Z = 6.0  # how many standard deviations more toxic documents than expected have a term

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
# Function words of the grammar, in the four languages of the corpus.
WORDS = {
    THREAT: "kill hurt beat destroy punish shoot stab burn töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself u ur they them he she du dich dir dein ihr euch tu toi te ton vous votre tú te ti vosotros usted",
    NEGATION: "not no never nobody nothing cannot nicht kein keine nie ne pas jamais aucun no nunca jamás ningún",
    REPORT: "said says wrote writes claims claimed reported quoted sagte schrieb behauptet dit écrit affirme dijo escribió afirma",
}
_BREAKS = byte_class((0x0A, 0x0A), (0x0D, 0x0D), (0x21, 0x21), (0x2E, 0x2E), (0x3B, 0x3B), (0x3F, 0x3F))
_QUOTES = byte_class((0x22, 0x22))
_THREAT_WEIGHT = 1.0


@dataclass(frozen=True)
class Transducer:
    """arcs[state, symbol] = (next state, symbol written, weight). Symbols without an arc pass unchanged."""

    states: int
    arcs: Mapping[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads with ``first`` and hands what it writes to ``second``; weights add up."""
    arcs = {}
    for a in range(first.states):
        for b in range(second.states):
            for symbol in range(7):
                to_a, written, wa = first.step(a, symbol)
                to_b, out, wb = second.step(b, written)
                arcs[a * second.states + b, symbol] = (to_a * second.states + to_b, out, wa + wb)
    return Transducer(first.states * second.states, arcs)


def _reported() -> Transducer:
    """State 1: after a reporting word; state 2: inside quotes."""
    arcs = {(s, REPORT): (max(s, 1), OTHER, 0.0) for s in range(3)}
    arcs |= {(0, QUOTE): (2, OTHER, 0.0), (1, QUOTE): (2, OTHER, 0.0), (2, QUOTE): (0, OTHER, 0.0)}
    return Transducer(3, arcs | {(s, symbol): (s, symbol, -1.0) for s in (1, 2) for symbol in (INSULT, THREAT)})


def _negated() -> Transducer:
    """State k: a negation stands at most 4 - k words back."""
    arcs = {(s, NEGATION): (3, OTHER, 0.0) for s in range(4)}
    arcs |= {(s, symbol): (s - 1, symbol, 0.0) for s in (1, 2, 3) for symbol in (OTHER, TARGET)}
    return Transducer(4, arcs | {(s, symbol): (s, symbol, -2.0) for s in (1, 2, 3) for symbol in (INSULT, THREAT)})


def _addressed() -> Transducer:
    """State 1: the clause has named a target; state 2: it has an insult or threat and no target yet."""
    hostile = (INSULT, THREAT)
    arcs = {(0, TARGET): (1, OTHER, 0.0), (2, TARGET): (1, OTHER, 0.5)}
    return Transducer(3, arcs | {(0, s): (2, s, 0.0) for s in hostile} | {(1, s): (1, s, 0.5) for s in hostile})


GRAMMAR = compose(compose(_reported(), _negated()), _addressed())


def clause_weight(symbols: list[int], weights: list[float], grammar: Transducer = GRAMMAR) -> float:
    """Sum of the weights of the hostile words of a clause as the grammar changes them, at least 0 each."""
    state, total = 0, 0.0
    for symbol, weight in zip(symbols, weights, strict=True):
        state, written, change = grammar.step(state, symbol)
        if written in (INSULT, THREAT):
            total += max(0.0, weight + change)
        else:
            total += change
    return total


def _folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 (À to Þ) in lower case."""
    data = LOWER_ASCII[data]
    second = data[1:]
    second[(data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return data


def _hash_words(names: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(names).encode(), np.uint8)
    ends = np.cumsum([len(n.encode()) + 1 for n in names]) - 1
    return Substrings(data).hash(np.r_[0, ends[:-1] + 1], ends)


def _term_hashes(text: Substrings, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes) of whole words and of each length of beginnings. A beginning's hash differs from a word's."""
    yield np.arange(len(starts)), text.hash(starts, ends)
    for length in BEGINNINGS:
        long = np.flatnonzero(ends - starts > length)
        yield long, ~text.hash(starts[long], starts[long] + length)


class Lexicon:
    """Learned terms and the grammar's own words, by hash."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weights = terms[order], weights[order]
        names = [(n, symbol) for symbol, text in WORDS.items() for n in dict.fromkeys(text.split())]
        hashes = _hash_words([n for n, _ in names])
        order = np.argsort(hashes, kind="stable")
        self.function_words, self.symbols = hashes[order], np.array([s for _, s in names])[order]

    def insults(self, text: Substrings, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Weight of the longest term that each word is or begins with, 0 for none."""
        weights = np.zeros(len(starts))
        if len(self.terms):
            whole = None
            for own, hashes in _term_hashes(text, starts, ends):
                at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
                hit = self.terms[at] == hashes
                if whole is None:
                    whole = own[hit], self.weights[at[hit]]
                weights[own[hit]] = self.weights[at[hit]]
            weights[whole[0]] = whole[1]
        return weights

    def function_symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.function_words, hashes), len(self.function_words) - 1)
        return np.where(self.function_words[at] == hashes, self.symbols[at], OTHER)

    def features(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Rows of (sum of clause weights, greatest, hostile clauses, share of insult words) for each block."""
        for _, _, data, at in blocks(texts):
            data = _folded(data)
            starts, ends, owner = words(data, at, ALPHANUMERIC)
            text = Substrings(data)
            weights = self.insults(text, starts, ends)
            symbols = self.function_symbols(text.hash(starts, ends))
            symbols[weights > 0] = INSULT
            weights[symbols == THREAT] = _THREAT_WEIGHT
            clause = np.r_[0, np.cumsum(_BREAKS[data])][starts] + owner  # texts are clauses apart
            out = np.zeros((len(at) - 1, 4))
            hostile = np.unique(clause[(symbols == INSULT) | (symbols == THREAT)])
            first, last = np.searchsorted(clause, hostile), np.searchsorted(clause, hostile, "right")
            quotes = np.flatnonzero(_QUOTES[data])
            marked = np.searchsorted(starts, quotes)  # a quote is a symbol before the word that follows it in its text
            marked = marked[np.append(owner, -1)[marked] == np.searchsorted(at, quotes, "right") - 1]
            begins = np.searchsorted(owner, np.arange(len(at) - 1))  # first word of each text
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                own, own_weights = symbols[a:b].tolist(), weights[a:b].tolist()
                inside = marked[np.searchsorted(marked, a) : np.searchsorted(marked, b)]
                for place in inside[::-1].tolist():
                    own.insert(place - a, QUOTE)
                    own_weights.insert(place - a, 0.0)
                before = np.searchsorted(marked, a) - np.searchsorted(marked, begins[owner[a]])
                if before % 2:  # the clause begins inside quotes
                    own, own_weights = [QUOTE, *own], [0.0, *own_weights]
                weight = clause_weight(own, own_weights)
                if weight > 0:
                    row = out[owner[a]]
                    row[0] += weight
                    row[1] = max(row[1], weight)
                    row[2] += 1
            n = np.bincount(owner, minlength=len(at) - 1)
            out[:, 3] = np.bincount(owner[symbols == INSULT], minlength=len(at) - 1) / np.maximum(n, 1)
            yield out


def _transformed(features: np.ndarray) -> np.ndarray:
    x = np.log1p(features * [1, 1, 1, 100])
    return np.concatenate([np.ones((len(x), 1)), x], 1)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    curve: np.ndarray | None  # coefficients; none without labels of both kinds

    def scores(self, texts: pa.Array) -> np.ndarray:
        """0 to 1 for each text; 0 throughout for a model without labels."""
        found = [self._curve(x) for x in self.lexicon.features(texts)]
        return np.concatenate(found) if found else np.zeros(0)

    def _curve(self, features: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(_transformed(features) @ self.curve, -30, 30)))


def held_out(doc_id: str) -> Column:
    """Rows never used for fitting: crc32 of the id as text divides by 5. So are rows without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most SAMPLE labelled documents that are not held out, chosen by hash of their ids."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & ~held_out("id"))
    chosen = known.orderBy(F.xxhash64("id", F.lit(5)), "id", "toxic").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("text", "toxic")  # SAMPLE rows


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per term and block: documents and occurrences, by label."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for first, _, data, at in blocks(batch.column("text")):
            data = _folded(data)
            starts, ends, owner = words(data, at, ALPHANUMERIC)
            for own, hashes in _term_hashes(Substrings(data), starts, ends):
                order = np.lexsort((owner[own], hashes))
                hashes, text = hashes[order], owner[own][order]
                new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])][: len(hashes)])
                times = np.diff(np.r_[new, len(hashes)])
                bad = toxic[first + text[new]] == 1
                terms, group = np.unique(hashes[new], return_inverse=True)
                sums = [np.bincount(group, w, len(terms)).astype(np.int64) for w in (bad, ~bad, times * bad, times * ~bad)]
                columns = [pa.array(terms.view(np.int64)), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, ["term", "d1", "d0", "n1", "n0"])


def _learn_terms(sample: DataFrame) -> Lexicon:
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    counts = sample.mapInArrow(_count_terms, "term bigint, d1 bigint, d0 bigint, n1 bigint, n0 bigint")
    counts = counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("d1", "d0", "n1", "n0")))
    share = (F.col("d0") + 1) / (good + 2)
    z = (F.col("d1") - bad * share) / F.sqrt(bad * share * (1 - share) + 1)
    weight = F.log((F.col("n1") + 0.5) / bad) - F.log((F.col("n0") + 0.5) / good)
    top = counts.where("d1 >= 3").select("term", z.alias("z"), weight.alias("weight")).where(f"z >= {LEAST_Z} AND weight >= 1")
    rows = top.orderBy(F.desc("z"), "term").limit(TERMS).collect()
    terms = np.array([r.term for r in rows], np.int64).view(np.uint64)
    return Lexicon(terms, np.clip(np.array([r.weight for r in rows], float), 0.5, 5.0))


def _fit_curve(features: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x, beta = _transformed(features), np.zeros(features.shape[1] + 1)
    penalty = ridge * np.eye(len(beta))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (toxic - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn terms and curve from at most SAMPLE labelled rows that are not held out.

    Labels other than 0 and 1 are ignored; of repeated ids each row counts. The driver holds a
    row of four features per sampled document.
    """
    sample = _sample(docs, labels)
    lexicon = _learn_terms(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.concatenate([np.zeros((0, 4)), *lexicon.features(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([pa.array(list(rows)), batch.column("toxic")], ["features", "toxic"])

    rows = sample.mapInArrow(measure, "features array<double>, toxic int").orderBy("toxic", "features").collect()
    toxic = np.array([r.toxic for r in rows], float)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(lexicon, None)
    return Model(lexicon, _fit_curve(np.array([r.features for r in rows]), toxic))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores. Null and empty texts score like a text without hostile clauses."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns, pa.array(model.scores(batch.column("text")), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs. Other columns are ignored; rows that repeat stay."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = score(rows, fit(docs, labels))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted)


def reject(docs: DataFrame, known: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of docs that score below the threshold, with all their columns. Labels belong to texts of ``known``."""
    name = fresh(docs, "score")
    return score(docs, fit(known, labels), name).where(F.col(name) < threshold).drop(name)
