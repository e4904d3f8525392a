"""Operator 8, toxicity by a lexicon that also catches misspelled terms.

The lexicon is learned from labelled rows: words, and beginnings of words, that stand far
more often in toxic texts than in others. It is kept as a trie. Levenshtein automata of all
its terms, intersected with the trie, run as one automaton whose states are made on demand:
a word is read once, whatever the number of terms, and each distinct word once in a worker.
Around each term found, a window of words and signs tells whether it is quoted or reported
rather than used, or aimed at someone. A logistic model turns the sums into a score.

Defined results: a null text counts as empty; texts without any term get the score of their
length alone; equal texts get equal scores; rows with a null id are scored, but never learned
from, nor are null labels; of labels with equal ids the largest counts, of documents with equal ids the smallest text; with no labelled row
of either class all scores are the share of toxic ones, 0 at least; an empty table gives an
empty result; columns other than doc_id and text are left alone."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Memo, Words, map_batches, materialize, resident, slices

THRESHOLD = 0.3
#: Labelled rows learned from at most (chosen by a hash of the id), and terms kept at most.
SAMPLE_ROWS = 12_000
LEXICON_TERMS = 600
#: A term stands in so many toxic texts at least, and its odds are so many times those elsewhere.
MIN_TOXIC = 4
MIN_LOG_ODDS = 2.0
SAME_TEXTS = 0.98
#: Beginnings of words that may be terms, by length; words from these lengths on may have 1 or 2 errors.
STEMS = range(4, 9)
ONE_ERROR, TWO_ERRORS = 5, 9
WINDOW = 4
#: Steps of the automaton that a worker remembers (each is made again on demand).
STEPS_KEPT = 400_000
NEAR_BYTES = 60

#: Words that report speech, and words that address or name someone (fixed values).
REPORTING = frozenset("said says say saying called calls call calling wrote writes quoted quotes quote told word term dit disait appelé sagte nannte dijo llamó".split())
ADDRESSING = frozenset("you your youre are he she they him her them is tu vous es du ihr sie usted eres".split())
_QUOTES = re.compile("[\"“”„«»]".encode())
_OPENERS = [q.encode() for q in "\"“„«"]


class Lexicon:
    """A trie of terms; ``read`` gives the term that a word is, begins with or resembles."""

    def __init__(self, terms: list[tuple[str, bool]]):
        """terms: the text, and whether it is only the beginning of a word."""
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.errors = [0]  # most errors that a term below may have
        for i, (text, stem) in enumerate(terms):
            allowed = 0 if stem else self.allowed(text)
            at = 0
            self.errors[0] = max(self.errors[0], allowed)
            for c in text:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.errors.append(0)
                at = self.child[at][c]
                self.errors[at] = max(self.errors[at], allowed)
            (self.stem if stem else self.whole).setdefault(at, i)
        self._forget()

    def _forget(self) -> None:
        """States have numbers: 0 is the start, and what a state says is kept beside it."""
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.stems: list[int | None] = []
        self.ends: list[tuple[int, int] | None] = []
        self.step: dict[int, int] = {}
        self._state(self._close({(0, 0)}))

    def _state(self, states: frozenset) -> int:
        n = self.number.get(states)
        if n is None:
            n = self.number[states] = len(self.states)
            self.states.append(states)
            self.stems.append(next((self.stem[node] for node, e in states if not e and node in self.stem), None))
            ends = [(e, self.whole[node]) for node, e in states if node in self.whole and e <= self.allowed(self.terms[self.whole[node]][0])]
            self.ends.append(min(ends) if ends else None)
        return n

    @staticmethod
    def allowed(text: str) -> int:
        return (len(text) >= ONE_ERROR) + (len(text) >= TWO_ERRORS)

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        """With what a letter missing from the word leads to; fewer errors win."""
        best: dict[int, int] = {}
        todo = sorted(states, key=lambda s: s[1])
        for node, e in todo:
            if e < best.get(node, 99) and e <= self.errors[node]:
                best[node] = e
                todo.extend((c, e + 1) for c in self.child[node].values() if e + 1 <= self.errors[c])
        return frozenset(best.items())

    def _next(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in states:
            if c in self.child[node]:
                out.add((self.child[node][c], e))
            if e < self.errors[node]:
                out.add((node, e + 1))
                out.update((n, e + 1) for x, n in self.child[node].items() if x != c)
        # zero-error paths go on below nodes without a budget of errors
        exact = {(n, 0) for n, e in out if e == 0}
        return self._close(out) | frozenset(exact)

    def read(self, word: str) -> tuple[int, int] | None:
        """(number of the term, errors), the fewest errors first; whole words before stems."""
        if len(self.step) > STEPS_KEPT:
            self._forget()
        at, stem, step, stems = 0, None, self.step, self.stems
        for c in word:
            key = at << 21 | ord(c)
            nxt = step.get(key)
            if nxt is None:
                nxt = step[key] = self._state(self._next(self.states[at], c))
            at = nxt
            if stems[at] is not None:
                stem = stems[at]
            elif not self.states[at]:
                break
        end = self.ends[at]
        if end and not end[0]:
            return end[1], 0
        if stem is not None:
            return stem, 0
        return (end[1], end[0]) if end else None


@dataclass
class Model:
    """What is learned; ``weights`` has the terms' log odds, ``beta`` the logistic model."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    beta: list[float] = field(default_factory=list)
    share: float = 0.0


FEATURES = ("used", "misspelled", "quoted", "aimed", "strongest", "density", "log_words")


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lexicon = model, Lexicon(model.terms)
        self.memo = Memo(self._compute, (np.int32,))

    def _compute(self, runs: list[bytes]) -> tuple[list]:
        out = []
        for run in runs:
            found = self.lexicon.read(run.decode())
            out.append([0] if found is None else [found[0] + 1 if not found[1] else -found[0] - 1])
        return (out,)

    def spans(self, col: pa.Array) -> tuple[Words, list[list[tuple[int, int, bool, bool]]]]:
        """Of each text the terms found: word, term (negative: misspelled; from 1 on), whether
        quoted or reported, whether aimed at someone."""
        words = Words(col, latin=True)
        raw = b"".join((t or "").encode() for t in col.to_pylist())
        entries = self.memo.entries(words.data, words.starts, words.lengths)
        codes = self.memo.pools[0].flat[entries]
        out: list[list] = [[] for _ in range(len(words.first) - 1)]
        hits = np.flatnonzero(codes)
        texts = np.searchsorted(words.first, hits, side="right") - 1
        for i, d in zip(hits.tolist(), texts.tolist(), strict=True):
            begin, end = int(words.first[d]), int(words.first[d + 1])
            around = {words.word(j).decode() for j in range(max(begin, i - WINDOW), min(end, i + WINDOW + 1)) if j != i}
            before = {words.word(j).decode() for j in range(max(begin, i - WINDOW), i)}
            at = int(words.starts[i])
            stop = at + int(words.lengths[i])
            ahead = raw[max(int(words.off[d]), at - NEAR_BYTES) : at].rpartition(b"\n")[2]
            behind = raw[stop : min(int(words.off[d + 1]), stop + NEAR_BYTES)].partition(b"\n")[0]
            opened = sum(1 for _ in _QUOTES.finditer(ahead)) % 2 == 1 or ahead.endswith(tuple(_OPENERS))
            quoted = opened and _QUOTES.search(behind) is not None or bool(before & REPORTING)
            out[d].append((i - begin, int(codes[i]), quoted, bool(around & ADDRESSING)))
        return words, out

    def features(self, col: pa.Array) -> np.ndarray:
        words, spans = self.spans(col)
        sizes = np.diff(words.first)
        x = np.zeros((len(sizes), len(FEATURES)))
        for d, found in enumerate(spans):
            for _, code, quoted, aimed in found:
                w = self.model.weights[abs(code) - 1]
                x[d, 2 if quoted else 1 if code < 0 else 0] += w
                x[d, 3] += aimed and not quoted
                x[d, 4] = max(x[d, 4], 0.0 if quoted else w * (1.0 if code > 0 else 0.5))
            x[d, 5] = x[d, 0] / max(1, sizes[d]) * 10
        x[:, :4] = np.log1p(x[:, :4])
        x[:, 6] = np.log1p(sizes)
        return x

    def scores(self, col: pa.Array) -> np.ndarray:
        if not self.model.beta:
            return np.full(len(col), self.model.share)
        beta = np.array(self.model.beta)
        return 1 / (1 + np.exp(-np.clip(beta[0] + self.features(col) @ beta[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Coefficients, the constant first, by Newton's method with a ridge on the others."""
    a = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def is_held_out(doc_id=None):
    """True for the rows that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(doc_id or "doc_id").cast("string"), F.lit(""))) % 4 == 2


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition, in how many toxic and other texts its terms stand."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            words = Words(part.column(0), latin=True)
            toxic = part.column(1).to_pylist()
            text = words.data.tobytes()
            for d, y in enumerate(toxic):
                own = {w.decode() for w in text[words.off[d] : words.off[d + 1]].split()}
                terms = {f"{w[:n]}*" for w in own for n in STEMS if len(w) > n}
                counts[bool(y)].update(own | terms)
    terms = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(terms), 100_000):
        some = terms[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([counts[y][t] for t in some], pa.int64()) for y in (1, 0))], names=["term", "toxic", "other"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most ``sample_rows`` labelled rows that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out())
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # the chosen ids are sample_rows at most, so they are broadcast; of rows with equal ids one is learned from
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialize(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxic-sample")
    n = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    share = n.get(True, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return Model(share=share)
    counted = map_batches(sample, _term_counts, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (n[True] + 1)) - F.log((F.col("other") + 0.5) / (n[False] + 1))
    found = counted.where(F.col("toxic") >= MIN_TOXIC).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(LEXICON_TERMS).collect()
    # a beginning says nothing more than a longer term that stands in nearly the same texts
    toxic = {r["term"]: r["toxic"] for r in found}
    spare = {f"{t[:n]}*" for t, k in toxic.items() for n in STEMS if n < len(t.rstrip("*")) and k >= SAME_TEXTS * toxic.get(f"{t[:n]}*", 1e18)}
    best = [r for r in found if r["term"] not in spare]
    model = Model([(r["term"].rstrip("*"), r["term"].endswith("*")) for r in best], [float(r["odds"]) for r in best], share=share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x = scorer.features(part.column(0))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = map_batches(sample, features, "toxic int, x array<double>").collect()
    model.beta = logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] > 0 for r in rows], float)).tolist()
    return model


def scorer_of(model: Model) -> Scorer:
    """One scorer a worker and model."""
    return resident(("toxicity", repr(model)), lambda: Scorer(model))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.scores(part.column(1)))], names=["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows whose score reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                scores = scorer.scores(part.column(part.schema.get_field_index("text")))
                yield part.filter(pa.array(scores < threshold))

    return map_batches(docs, run, docs.schema)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
