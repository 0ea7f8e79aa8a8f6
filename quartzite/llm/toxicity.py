"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, report, quote). Five transducers read them in a cascade, each reading what
the one before it has written: the target machine marks harms with a target within four symbols (its look-ahead half reads from the
right), the negation and reported-speech machines mark those in their scope, the insult and the threat machine turn marked harms into
factors. All that read from the left are composed into one machine. A clause's score is the weight of its harms times their factors, and
documents are judged by their matched clauses.

Target, negation, report and threat words are listed below. Insults and their weights, and those of threats seen often enough, are learned
from labelled rows: log odds of words and of word beginnings. A logistic model over clause scores gives the probability; while it is fitted, each row's own
counts are left out of the odds, so that the lexicon can't vouch for the rows it was read from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# The closed word classes, English, German, French, Spanish.
TARGETS = "you your yours u he she they him her them his their du dich dir dein deine ihr euch sie er ihn tu te toi ton ta vous votre il elle ils elles lui usted ustedes ti él ella ellos ellas"
NEGATIONS = "not no never nobody neither nor none without isn aren wasn don doesn didn nicht kein keine keinen nie niemals niemand ohne ne pas jamais aucun aucune sans non nunca jamás ningún ninguna nadie sin"
REPORTS = "said says say wrote writes reported reports claimed claims quoted quotes called according alleged sagte sagt schrieb berichtete laut behauptete dit disait écrit rapporte selon affirme dijo dice escribió según afirma"
THREATS = "kill murder hurt stab shoot strangle destroy töten umbringen erschießen tuer assassiner égorger matar asesinar apuñalar"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
SYMBOLS = 7
THREAT_WEIGHT = 3.0
SURE = 2.0  # standard errors by which a word's log odds are lowered, so that few sightings weigh little
TOKEN = regex.compile(r"[\p{L}\p{M}]+|[.!?;:\n]|[\"“”„«»]")
BREAKS, QUOTES = frozenset(".!?;:\n"), frozenset("\"“”„«»")
HARM = (INSULT, THREAT)
#: A letter is a symbol with marks: ``symbol + SYMBOLS * marks``.
AIMED, NEGATED, REPORTED = 1, 2, 4
LETTERS = SYMBOLS * 8
NEAR, SCOPE = 4, 3


def marked(letter: int, mark: int) -> int:
    return letter if letter // SYMBOLS & mark else letter + SYMBOLS * mark


class Machine:
    """A deterministic transducer: ``move[state][letter]`` and the letter ``out[state][letter]`` that it writes."""

    def __init__(self, move: list[list[int]], out: list[list[int]]):
        self.move, self.out = move, out

    def __or__(self, other: Machine) -> Machine:
        """Composition: ``other`` reads what this one writes."""
        n = len(other.move)
        pairs = [(a, b) for a in range(len(self.move)) for b in range(n)]
        return Machine(
            [[self.move[a][x] * n + other.move[b][self.out[a][x]] for x in range(LETTERS)] for a, b in pairs],
            [[other.out[b][self.out[a][x]] for x in range(LETTERS)] for a, b in pairs],
        )


def scope(opens: int, length: int, mark: int) -> Machine:
    """Marks the harms among the ``length`` symbols after ``opens``."""
    kinds = [x % SYMBOLS for x in range(LETTERS)]
    move = [[length if s == opens else max(0, left - 1) for s in kinds] for left in range(length + 1)]
    return Machine(move, [[marked(x, mark) if left and s in HARM else x for x, s in enumerate(kinds)] for left in range(length + 1)])


def speech() -> Machine:
    """Marks harms between quotes, and after a reporting word up to the quote that ends its quotation, else to the clause's end."""
    plain, quoted, told = range(3)
    turn = {plain: {QUOTE: quoted, REPORT: told}, quoted: {QUOTE: plain}, told: {QUOTE: quoted}}
    kinds = [x % SYMBOLS for x in range(LETTERS)]
    return Machine([[turn[q].get(s, q) for s in kinds] for q in range(3)], [[marked(x, REPORTED) if q and s in HARM else x for x, s in enumerate(kinds)] for q in range(3)])


def factors(symbol: int, aimed: float, alone: float, negated: float, reported: float) -> list[float | None]:
    """One-state machine from the marked letters of ``symbol`` to numbers."""
    found: list[float | None] = [None] * LETTERS
    for marks in range(8):
        found[symbol + SYMBOLS * marks] = (aimed if marks & AIMED else alone) * (negated if marks & NEGATED else 1.0) * (reported if marks & REPORTED else 1.0)
    return found


AHEAD = scope(TARGET, NEAR, AIMED)  # reads from the right
GRAMMAR = scope(TARGET, NEAR, AIMED) | scope(NEGATION, SCOPE, NEGATED) | speech()
INSULTED = factors(INSULT, 1.5, 1.0, 0.3, 0.5)
THREATENED = factors(THREAT, 1.5, 0.5, 0.2, 0.4)
GAIN = [a if a is not None else b if b is not None else 0.0 for a, b in zip(INSULTED, THREATENED, strict=True)]


class Lexicon(dict):
    """word -> (symbol, weight), filled as words are met. ``own``: the label of the row being read, whose counts are left out."""

    CLOSED = {w: (kind, 0.0) for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words.split()}

    def __init__(self, model: dict, own: int | None = None):
        self.words, self.heads, self.n, self.own, self.least = model["words"], model["heads"], model["n"], own, model["least"]
        self.threats = frozenset(THREATS.split())

    def weight(self, counts: tuple[int, int]) -> float:
        pos, neg, n1, n0 = *counts, *self.n
        if self.own is not None:
            pos, neg, n1, n0 = pos - self.own, neg - 1 + self.own, n1 - self.own, n0 - 1 + self.own
        pos, neg = max(pos, 0) + 0.5, max(neg, 0) + 0.5
        w = math.log(pos / (max(n1, 0) + 1)) - math.log(neg / (max(n0, 0) + 1)) - SURE * math.sqrt(1 / pos + 1 / neg)
        return w if w >= self.least else 0.0

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.CLOSED.get(word)
        if found is None:
            w = self.weight(self.words[word]) if word in self.words else max((self.weight(self.heads[word[:k]]) for k in range(HEAD[0], min(HEAD[1], len(word) - 1) + 1) if word[:k] in self.heads), default=0.0)
            found = (THREAT, w or THREAT_WEIGHT) if word in self.threats else (INSULT, w) if w else (OTHER, 0.0)
        if len(self) > 400_000:
            self.clear()
        self[word] = found
        return found


HEAD = (3, 9)


def clauses(text: str, lexicon: Lexicon) -> tuple[list[float], int]:
    """(scores of the clauses that the grammar matches, number of words)."""
    scores: list[float] = []
    n, clause, harm, quoted = 0, [], False, False
    for t in TOKEN.findall(text.lower()):
        if t in BREAKS:
            if harm:
                scores.append(_walk(clause))
            quoted = quoted and t != "\n"
            clause, harm = [(QUOTE, 0.0)] if quoted else [], False  # a quotation goes on after a full stop, but not on a new line
        elif t in QUOTES:
            clause.append((QUOTE, 0.0))
            quoted = not quoted
        else:
            n += 1
            x = lexicon[t]
            clause.append(x)
            harm = harm or x[0] in HARM
    if harm:
        scores.append(_walk(clause))
    return scores, n


def _walk(clause: list[tuple[int, float]]) -> float:
    letters, state = [symbol for symbol, _ in clause], 0
    for i in range(len(letters) - 1, -1, -1):
        state, letters[i] = AHEAD.move[state][letters[i]], AHEAD.out[state][letters[i]]
    state, total = 0, 0.0
    for x, (_, weight) in zip(letters, clause, strict=True):
        total += weight * GAIN[GRAMMAR.out[state][x]]
        state = GRAMMAR.move[state][x]
    return total


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    scores, n = clauses(text, lexicon) if text else ([], 0)
    s = sum(scores)
    return [math.log1p(s), max(scores, default=0.0), math.log1p(len(scores)), math.log1p(100 * s / (n + 20)), float(bool(scores))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of words and word beginnings by label, summed up within a task."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        terms = list(seen[0].keys() | seen[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])
        seen[0].clear()
        seen[1].clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {t for t in TOKEN.findall((text or "").lower()) if t not in BREAKS and t not in QUOTES}
            seen[label].update(words)
            seen[label].update({f"{w[:k]}*" for w in words for k in range(HEAD[0], min(HEAD[1], len(w) - 1) + 1)})
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield flush()
    yield flush()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the free intercept."""
    beta, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


#: Coefficients where there are no labels of both kinds to fit: intercept, then as in :func:`features`.
UNTAUGHT = [-5.0, 0.5, 0.5, 0.0, 0.5, 1.0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 20_000, min_pos: int = 3, least_odds: float = 1.0) -> dict:
    """The model from ``docs`` and ``labels`` (doc_id, label 0/1): at most ``max_docs`` labelled ids, those of smallest hash, a row of each.

    Rows with a null label are left out. Of several texts of one id the first in their order is read. Without rows of both labels only
    the listed threats count.
    """
    known = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("label") >= 1, 1).otherwise(0)).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # so few ids may be sent to every task
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stored(texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label"), "toxic-sample")
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    model = {"words": {}, "heads": {}, "n": (n.get(1, 0), n.get(0, 0)), "least": least_odds, "beta": UNTAUGHT}
    if len(n) < 2:
        return model
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(a / (n[1] + 1)) - F.log(b / (n[0] + 1)) - SURE * F.sqrt(1 / a + 1 / b)
    terms = rows.mapInArrow(_count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    terms = stored(terms.filter("pos >= 1").withColumn("odds", odds), "toxic-terms")
    strong = terms.filter((F.col("pos") >= min_pos) & (F.col("odds") >= least_odds))
    # A word with evidence of its own against it doesn't fall back on its beginning.
    heads = strong.filter(F.col("term").endswith("*")).select("term")
    weak = terms.filter((F.col("odds") < least_odds) & (F.col("pos") + F.col("neg") >= 5) & ~F.col("term").endswith("*"))
    starts = F.array(*[F.concat(F.substring("term", 1, k), F.lit("*")) for k in range(HEAD[0], HEAD[1] + 1)])
    weak = weak.select("term", "pos", "neg", F.explode(starts).alias("start")).join(heads.withColumnRenamed("term", "start"), "start", "left_semi").select("term", "pos", "neg").distinct()
    for r in strong.select("term", "pos", "neg").union(weak).collect():  # of the words of max_docs texts those that matter
        model["heads" if r.term.endswith("*") else "words"][r.term.rstrip("*")] = (r.pos, r.neg)
    base = {k: v for k, v in model.items() if k != "beta"}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(base, own) for own in (0, 1)]
        for batch in batches:
            found = [[float(y), *features(t, lexicons[y])] for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], names=["x"])

    x = np.array([r.x for r in rows.mapInArrow(measure, "x array<double>").collect()])  # max_docs rows at most
    y, x = x[:, 0].copy(), x
    x[:, 0] = 1.0
    model["beta"] = logistic(x, y).tolist()
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), clauses (number that the grammar matches) of every whole text; null counts as empty.

    Repeated rows each give a row; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, beta = Lexicon(model), np.array(model["beta"])
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = np.array([[1.0, *features(t, lexicon)] for t in part.column(1).to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(np.rint(np.expm1(x[:, 3])).astype(np.int64))], names=["doc_id", "score", "clauses"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, score double, clauses long")


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns and repeated rows kept; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, beta = Lexicon(model), np.array(model["beta"])
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = np.array([[1.0, *features(t, lexicon)] for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)
