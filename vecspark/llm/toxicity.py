"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads word forms into the classes insult, threat, target, negation, report and other. Its insult
entries are whole words or word beginnings, weighted by their log-odds among labelled texts; an entry must hold in either
half of the rows that are learned from, so that accidental ones fall. Its threats are a fixed list with weights of their
own, moved by the labels. Over a clause's classes run three composed transducers: negation takes an insult or
threat in the three words after it as denied, report takes what follows in the clause as quoted, and target marks the
clause as aimed at someone. What scores is a matched clause: its summed weights by reading (plain, aimed, denied,
quoted, threat, aimed threat). A text's score is the logistic of its strongest clause in each reading, with coefficients
drawn towards fixed ones and kept in order: what is denied or quoted counts at most MOST_DENIED or MOST_QUOTED of what is
said plainly, and what is aimed at someone at least as much. A denied insult alone makes no text toxic.

Labels of rows whose crc32(doc_id as text) mod 5 is not 0 are learned from, FIT_ROWS of them at most, taken in the order
of a hash of doc_id. Nothing but the text goes into a score.

Defined cases: a null or empty text has no clause and gets the score of its absence; without usable labels of both kinds
there are no insult entries and the fixed threats and coefficients stand alone; several labels of a document count as toxic if one does; repeated rows are
scored alike, and of rows with the same doc_id one is learned from; other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import read, table

FIT_ROWS = 12_000
#: Rows whose words, or copies of whose texts, a Python worker holds at once.
SLICE_ROWS = 128
#: Word beginnings of these many characters are tried as entries.
BEGINNINGS = range(3, 8)
#: An entry's log-odds less 1.64 standard errors must reach this.
LEAST_WEIGHT = 2.0
#: In either half of the rows learned from, an entry must be in so many toxic texts and have log-odds of so much.
LEAST_HALF, HALF_WEIGHT = 2, 1.5
PRIOR_COUNT = 3.0
THREATS = {"kill": 3.5, "murder": 3.5, "exterminate": 3.5, "strangle": 3.5, "stab": 3.0, "shoot": 2.5, "destroy": 2.0, "hurt": 2.0}
TARGETS = "you your yours yourself u he she they him her them these those people tu toi vous du dich dir sie ihr euch usted ustedes tú ella ellos".split()
NEGATIONS = "not no never nor neither cannot isn aren wasn don doesn without nicht kein keine keinen nie pas jamais ni nunca jamás sin".split()
REPORTS = "said says say called calls wrote writes quote quoted quoting claimed claims reported reports told according sagte sagt nannte schrieb dit disait écrit dijo dice llamó escribió".split()
SCOPE = 3
READINGS = ("plain", "aimed", "denied", "quoted", "threat", "aimed threat")
#: The coefficients that the fitted ones are drawn to: of READINGS, then of the logarithm of matched clauses, then the constant.
CENTRE = np.array([1.2, 1.5, 0.1, 0.3, 0.8, 1.4, 0.2, -3.0])
#: The constant stays below this, so a text without a matched clause is never toxic, however few the labels.
MOST_CONSTANT = -0.5
#: Of the coefficient of the plain reading, the most that the denied and the quoted one may have.
MOST_DENIED, MOST_QUOTED = 0.1, 0.3
#: The most that an entry weighs.
MOST_WEIGHT = 6.0
SEPARATORS = ".!?;\n"
CLAUSE_END = re.compile(r"[.!?;\n]")
WORD = re.compile(r"\w+")


class Transducer:
    """Finite states; moves: (state, symbol) -> (state, symbol out). A symbol without a move passes unchanged."""

    def __init__(self, moves: dict[tuple, tuple], start=0):
        self.moves, self.start = moves, start

    def step(self, state, symbol):
        return self.moves.get((state, symbol), (state, symbol))

    def then(self, other: Transducer, alphabet: str) -> Transducer:
        """The composition: other reads what self writes; only states that can be reached are built."""
        start = (self.start, other.start)
        moves, todo, seen = {}, [start], {start}
        while todo:
            at = todo.pop()
            for symbol in alphabet:
                a, middle = self.step(at[0], symbol)
                b, out = other.step(at[1], middle)
                moves[at, symbol] = ((a, b), out)
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Transducer(moves, start)


#: Classes: O other, I insult, T threat, G target, N negation, R report. Lower case: denied. J and U: quoted insult, threat.
ALPHABET = "OITGNR"


def _negation() -> Transducer:
    moves = {}
    for k in range(SCOPE + 1):
        for symbol in ALPHABET:
            moves[k, symbol] = (max(k - 1, 0), symbol.lower() if k and symbol in "IT" else symbol)
        moves[k, "N"] = (SCOPE, "N")
    return Transducer(moves)


def _report() -> Transducer:
    quoted = {"I": "J", "T": "U", "i": "i", "t": "t"}
    return Transducer({(0, "R"): (1, "R")} | {(1, x): (1, y) for x, y in quoted.items()})


def _target() -> Transducer:
    return Transducer({(0, "G"): (1, "G")})


def grammar() -> Transducer:
    return _negation().then(_report(), ALPHABET).then(_target(), ALPHABET)


GRAMMAR = grammar()


class Lexicon:
    """Weighted entries: whole words, or beginnings that end in '*'."""

    def __init__(self, insults: dict[str, float], threats: dict[str, float]):
        self.insults, self.threats = insults, threats

    def __getstate__(self):
        return (self.insults, self.threats)

    def __setstate__(self, state):
        self.insults, self.threats = state

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry in [*self.insults, *self.threats]:
            found.add_word(entry.removesuffix("*"), True)
        found.make_automaton()
        return found

    @cached_property
    def _classes(self) -> dict[str, str]:
        return {w: c for words, c in ((REPORTS, "R"), (NEGATIONS, "N"), (TARGETS, "G")) for w in words}

    def _entry(self, entries: dict[str, float], word: str) -> float:
        whole = entries.get(word)
        if whole is not None:
            return whole
        return max((entries.get(f"{word[:k]}*", 0.0) for k in BEGINNINGS if k <= len(word)), default=0.0)

    def read(self, word: str) -> tuple[str, float]:
        """Class and weight of a word."""
        if w := self._entry(self.insults, word):
            return "I", w
        if w := self._entry(self.threats, word):
            return "T", w
        return self._classes.get(word, "O"), 0.0

    def features(self, text: str) -> list[float]:
        """The strongest clause of each reading, and the logarithm of 1 + matched clauses; every clause is read once."""
        text = text.lower()
        best, matched, upto = [0.0] * len(READINGS), 0, -1
        for last, _ in self.automaton.iter(text):
            if last < upto:
                continue
            start = max(text.rfind(x, max(upto, 0), last + 1) for x in SEPARATORS) + 1
            end = CLAUSE_END.search(text, last)
            upto = end.start() if end else len(text)
            sums, state = [0.0] * len(READINGS), GRAMMAR.start
            for m in WORD.finditer(text, max(start, 0), upto):
                symbol, weight = self.read(m[0])
                state, out = GRAMMAR.step(state, symbol)
                if weight:
                    sums[{"I": 0, "T": 4, "i": 2, "t": 2}.get(out, 3)] += weight
            if state[1]:
                sums[1], sums[5] = sums[0], sums[4]
                sums[0] = sums[4] = 0.0
            if any(sums):
                matched += 1
                best = [max(a, b) for a, b in zip(best, sums, strict=True)]
        return [*best, float(np.log1p(matched))]


class Model:
    def __init__(self, lexicon: Lexicon, coefficients: np.ndarray):
        self.lexicon, self.coefficients = lexicon, coefficients

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.coefficients, [*self.lexicon.features(text or ""), 1.0]))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def forms(word: str) -> Iterator[str]:
    """What entry could stand for a word: itself, or one of its beginnings."""
    yield word
    for k in BEGINNINGS:
        if k <= len(word):
            yield f"{word[:k]}*"


#: (form, half) and the number of texts of that half that hold it; the empty form is in every text.
Counts = dict[tuple[str, int], int]


def learned(pos: Counts, clean: Callable[[set[str]], Counts], covering: Callable[[set[str]], list[set[str]]]) -> Lexicon:
    """Entries that cover the toxic texts, by number of texts times certainty.

    pos: counts in toxic texts, of the threats and of the forms that LEAST_HALF texts of either half hold; clean: given
    forms, their counts in clean texts; covering: given forms, which of them each toxic text has that has any.
    """
    both = {x for x, _ in pos if x} | {*THREATS}
    neg = clean(both)
    size, none = ([n.get(("", k), 0) for k in (0, 1)] for n in (pos, neg))

    def odds(x: str, halves: tuple[int, ...]) -> tuple[float, float]:
        a, b = sum(pos.get((x, k), 0) for k in halves) + 0.5, sum(neg.get((x, k), 0) for k in halves) + 0.5
        w = float(np.log(a / (sum(size[k] for k in halves) + 1)) - np.log(b / (sum(none[k] for k in halves) + 1)))
        return w, w - 1.64 * float(np.sqrt(1 / a + 1 / b))

    known = bool(sum(size) and sum(none))
    threats = {}
    for x, prior in THREATS.items():  # the prior weight, as if seen in PRIOR_COUNT texts, moved by what the labels say
        n = sum(pos.get((x, k), 0) + neg.get((x, k), 0) for k in (0, 1))
        told = odds(x, (0, 1))[0] if known and n else prior
        threats[x] = min((PRIOR_COUNT * prior + n * told) / (PRIOR_COUNT + n), MOST_WEIGHT)
    threats = {x: w for x, w in threats.items() if w > 0.5}
    strong: dict[str, float] = {}
    for x in both - {*THREATS} if known else ():
        whole = odds(x, (0, 1))
        if whole[1] >= LEAST_WEIGHT and min(odds(x, (k,))[0] for k in (0, 1)) >= HALF_WEIGHT:
            strong[x] = whole[0]
    insults: dict[str, float] = {}
    uncovered = covering({*strong}) if strong else []
    cover = Counter(f for own in uncovered for f in own)
    while cover:
        x, n = max(cover.items(), key=lambda p: (p[1] * strong[p[0]], p[0]))
        if n < 1:
            break
        insults[x] = min(strong[x], MOST_WEIGHT)
        for own in uncovered:
            if x in own:
                cover.subtract(own)
        uncovered = [own for own in uncovered if x not in own]
    return Lexicon(insults, threats)


def ordered(b: np.ndarray) -> np.ndarray:
    """The nearest coefficients that keep the readings in order."""
    b = np.maximum(b[:-1], 0.0).tolist() + [min(b[-1], MOST_CONSTANT)]
    b[0] = max(b[0], CENTRE[0] / 2)
    b[1], b[2], b[3] = max(b[1], b[0]), min(b[2], MOST_DENIED * b[0]), min(b[3], MOST_QUOTED * b[0])
    b[5] = max(b[5], b[4])
    return np.array(b)


def fitted(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic coefficients by Newton steps, drawn to CENTRE by a ridge, each step followed by a return to their order."""
    x, b = np.column_stack([features, np.ones(len(features))]), ordered(CENTRE)
    pull = np.diag([1.0] * (len(CENTRE) - 1) + [0.01])
    if len({*labels.tolist()}) < 2:
        return b
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (labels - p) - pull @ (b - CENTRE))
        new = ordered(b + step / max(1.0, np.abs(step).max() / 2))
        if np.abs(new - b).max() < 1e-6:
            break
        b = new
    return b


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The driver is sent counts of forms in the fit rows, the entries in the toxic ones, and clause features."""
    spark = documents.sparkSession
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    found = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    rows = table(spark, one.select("text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")), "fit")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(a, SLICE_ROWS)
                own = [sorted({*WORD.findall((t.as_py() or "").lower())}) for t in some.column(0)]
                yield pa.RecordBatch.from_arrays([some.column(2), pa.array(own, pa.list_(pa.string()))], ["half", "words"])

    def counted(where: str, wanted: set[str] | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in words(batches):
                n: Counter[tuple[str, int]] = Counter()
                for half, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    n.update((f, half) for f in {f for w in own.as_py() for f in forms(w) if wanted is None or f in wanted} | {""})
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in n], pa.string()), pa.array([h for _, h in n], pa.int32()), pa.array([*n.values()], pa.int64())], ["form", "half", "n"])

        halves = [F.sum(F.when(F.col("half") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)]
        return rows.where(where).mapInArrow(run, "form string, half int, n bigint").groupBy("form").agg(*halves)

    def gathered(counts: DataFrame) -> Counts:
        return {(r[0], k): r[1 + k] for r in counts.select("form", "n0", "n1").toLocalIterator() for k in (0, 1)}

    def covering(strong: set[str]) -> list[set[str]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in words(batches):
                found = [sorted({f for w in own.as_py() for f in forms(w) if f in strong}) for own in batch.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x in found if x], pa.list_(pa.string()))], ["forms"])

        return [{*r[0]} for r in rows.where("toxic > 0").mapInArrow(run, "forms array<string>").toLocalIterator()]

    common = (F.col("n0") >= LEAST_HALF) & (F.col("n1") >= LEAST_HALF) | F.col("form").isin("", *THREATS)
    lexicon = learned(gathered(counted("toxic > 0", None).where(common)), lambda wanted: gathered(counted("toxic <= 0", wanted)), covering)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.features(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    got = rows.select("text", "toxic").mapInArrow(features, "toxic int, x array<double>").collect()
    return Model(lexicon, fitted(np.array([r[1] for r in got]).reshape(-1, len(CENTRE) - 1), np.array([float(r[0] > 0) for r in got])))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    doc = F.col("doc_id").cast("bigint")
    return documents.select(doc.alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out(doc), F.lit(False)).alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def reject(documents: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below 0.5, unchanged."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(a, SLICE_ROWS)
                yield some.filter(pa.array([model.score(t.as_py()) < 0.5 for t in some.column(at)], pa.bool_()))
        pa.default_memory_pool().release_unused()

    return documents.mapInArrow(run, documents.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity."""
    documents = read(spark, sf_dir, "documents")
    return scored(documents, train(documents, read(spark, sf_dir, "labels")))
