"""Toxicity by a weighted finite-state pattern grammar.

A word transducer reads words and emits symbols: insult, weak insult, threat, target, negation,
reported speech, quotation mark, other. Its insults and threats come from a short fixed list and
from whole words and word beginnings that a bounded sample of labelled rows ties to toxic rows,
nearly always (insults) or more often than chance (weak insults). Three
further transducers read symbols and mark what they find: negation marks insults and threats
up to three words after it, reported speech those up to the end of the clause, a target those
after it. They are composed into one machine, which runs over the clauses that hold an insult or
threat; the target transducer then reads its output from the end, for targets that follow.
Matched clauses are counted by their kind, and a logistic model, fitted on the same sample, weighs
the counts and the text's length (as a power of two).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .tokens import text_slices

#: Labelled rows used for fitting at most; all else of the fit is bounded by them.
FIT_ROWS = 8000
THRESHOLD = 0.3
_PREFIXES = range(4, 8)

# Words by symbol (English, German, French, Spanish).
INSULTS = "idiot idiots stupid moron morons loser losers scum trash clown clowns pathetic worthless disgusting imbecile dumb jerk bastard vermin dumm idioten trottel abschaum versager wertlos dreckig imbécile crétin abruti ordure minable débile idiota imbécil basura escoria payaso inútil asqueroso estúpido estúpida".split()
THREATS = "kill murder destroy hurt beat strangle töten umbringen verprügeln tuer frapper matar golpear".split()
TARGETS = "you your yours yourself u they them people everyone du dich dir dein deine ihr euch tu te toi vous ton ta tú ti usted ustedes tus".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't nobody nicht kein keine nie niemals ne pas jamais aucun ni nunca jamás".split()
REPORTS = "said says wrote writes called calls reported claimed claims quoted according sagte schrieb nannte behauptete dit disait écrit appelé dijo escribió llamó según".split()

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„]|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")
_END = re.compile(r"[.!?;:\n]")
_QUOTES = frozenset('"“”«»„')
_LETTERS = re.compile(r"[^\W\d_]+")

Symbol = str  # o other, i insult, w weak insult, h threat, t target, n negation, r report, q quotation mark
#: A deterministic transducer: (state, symbol read) -> (state, symbol emitted); state 0 first.
Transducer = dict[tuple, tuple]
_MARKS = tuple(a + b for a in "ihw" for b in ("", "n", "r", "nr", "t", "nt", "rt", "nrt"))
_SYMBOLS = ("o", "t", "n", "r", "q", *_MARKS)


def negation() -> Transducer:
    """States count the words for which a negation still holds."""
    out = {}
    for left in range(4):
        for s in _SYMBOLS:
            to = 3 if s == "n" else max(0, left - 1)
            out[left, s] = (to, s + "n" if s in "ihw" and left else s)
    return out


def report() -> Transducer:
    """State 1 inside reported speech or a quotation."""
    out = {}
    for inside in range(2):
        for s in _SYMBOLS:
            to = 1 if s == "r" else 1 - inside if s == "q" else inside
            out[inside, s] = (to, s + "r" if s in ("i", "h", "w", "in", "hn", "wn") and inside else s)
    return out


def target() -> Transducer:
    """State 1 once a target was read in the clause."""
    return {(seen, s): (1 if s == "t" else seen, s + "t" if s[0] in "ihw" and "t" not in s and seen else s) for seen in range(2) for s in _SYMBOLS}


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what first emits to second; its states are numbered from 0."""
    names: dict[tuple, int] = {(0, 0): 0}
    todo, out = [(0, 0)], {}
    reads = {s for _, s in first}
    while todo:
        a, b = pair = todo.pop()
        for s in reads:
            a2, middle = first[a, s]
            b2, emitted = second[b, middle]
            if (a2, b2) not in names:
                names[a2, b2] = len(names)
                todo.append((a2, b2))
            out[names[pair], s] = (names[a2, b2], emitted)
    return out


#: Reads a clause forwards; what it emits is read backwards by the target transducer, for a target may follow.
GRAMMAR, BACKWARDS = compose(compose(negation(), report()), target()), target()
#: Kinds of matched clauses that the model weighs.
KINDS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "aimed threat", "weak insult")
#: Bits of a count's or a length's magnitude in a code.
_BITS = 6


def kind_of(mark: str) -> int | None:
    """The kind of an emitted insult or threat; None where it counts for nothing."""
    what, rest = mark[0], mark[1:]
    if what == "w":
        return None if "n" in rest or "r" in rest else 6
    if what == "h":
        return None if "n" in rest or "r" in rest else 5 if "t" in rest else 4
    return 2 if "n" in rest else 3 if "r" in rest else 1 if "t" in rest else 0


@dataclass
class Lexicon:
    """The symbols of insult and threat words, and of beginnings of words; in lower case."""

    words: dict[str, str] = field(default_factory=dict)
    beginnings: dict[str, str] = field(default_factory=dict)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry in {*self.words, *self.beginnings}:
            found.add_word(entry, entry)
        if len(found):
            found.make_automaton()
        return found

    def symbol(self, word: str) -> Symbol:
        found = {self.words.get(word), *(self.beginnings.get(word[:n]) for n in _PREFIXES if len(word) > n)}
        return next((s for s in "ihw" if s in found), _OTHERS.get(word, "o"))


_OTHERS = {**{w: "t" for w in TARGETS}, **{w: "n" for w in NEGATIONS}, **{w: "r" for w in REPORTS}, **{q: "q" for q in _QUOTES}}
FIXED = {**{w: "i" for w in INSULTS}, **{w: "h" for w in THREATS}}


def clauses(text: str, lexicon: Lexicon, automaton: ahocorasick.Automaton) -> np.ndarray:
    """Number of matched clauses of each kind in a whole text."""
    counts = np.zeros(len(KINDS), np.int64)
    low = text.lower()
    if not len(automaton):
        return counts
    done = -1
    for end, entry in automaton.iter(low):
        start = end - len(entry) + 1
        if start <= done or (start and low[start - 1].isalpha()):
            continue
        if entry not in lexicon.beginnings and end + 1 < len(low) and low[end + 1].isalpha():
            continue
        left = max(done, *(low.rfind(mark, max(done, 0), start) for mark in _ENDS)) + 1
        right = m.start() if (m := _END.search(low, end + 1)) else len(low)
        done = right
        state, kinds = 0, set()
        # A clause without marks can be as long as the text: the grammar reads it once.
        emitted = []
        for word in _WORD.findall(low[left:right]):
            state, symbol = GRAMMAR[state, lexicon.symbol(word)]
            emitted.append(symbol)
        state = 0
        for symbol in reversed(emitted):  # targets after the insult
            state, symbol = BACKWARDS[state, symbol]
            if symbol[0] in "ihw":
                kinds.add(kind_of(symbol))
        for k in kinds - {None}:
            counts[k] += 1
    return counts


def features(text: str) -> set[tuple[str, int]]:
    """What the word transducer can learn from: words, and beginnings of longer words (with *),
    each with a hash of the word before it."""
    out, before = set(), 0
    for word in _LETTERS.findall(text.lower()):
        if word not in FIXED:
            out.add((word, before))
            out.update((word[:n] + "*", before) for n in _PREFIXES if len(word) > n)
        before = zlib.crc32(word.encode())
    return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, counts: np.ndarray, length: int) -> float:
        return 1 / (1 + math.exp(-float(np.clip(inputs(counts, length) @ self.weights, -30, 30))))

    def scorer(self):
        """A function from a text to its score."""
        automaton = self.lexicon.automaton()
        return lambda text: self.score(clauses(text or "", self.lexicon, automaton), length_of(text or ""))


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most so many labelled rows, chosen by a hash of their ids, none of
    them held out. Written. Only their ids are broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "fit-ids")
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "fit-rows")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each feature, word before it and text."""
    for batch in batches:
        for text in batch.column(0).to_pylist():
            own = list(features(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in own], pa.string()), pa.array([c for _, c in own], pa.int64()), pa.array([zlib.crc32((text or "").encode())] * len(own), pa.int64())], names=["feature", "before", "text"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each feature occurs."""
    for batch in batches:
        for rows in text_slices(batch, 0):
            found: Counter[str] = Counter()
            for text in rows.column(0).to_pylist():
                found.update({f for f, _ in features(text or "")})
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["feature", "n"])


def learn_lexicon(rows: DataFrame, least: int = 4) -> Lexicon:
    """Entries whose tie to toxic rows could not be chance among so many: a likelihood-ratio
    statistic beyond 2 ln(entries) + 6. Those with a share of toxic rows of 0.9 or more are
    insults, those with at least three times the share of all rows weak insults. An entry's
    toxic rows count only as far as they are different texts and have different words before
    it, so that copies of a text, and a word that one text repeats, don't speak for themselves."""
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}  # two rows
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    words = dict(FIXED)
    if not n_toxic or not n_clean:
        return Lexicon(words)
    seen = rows.filter("toxic = 1").select("text").mapInArrow(_occurrences, "feature string, before long, text long")
    toxic = seen.groupBy("feature").agg(F.least(F.countDistinct("before"), F.countDistinct("text")).alias("hits"))
    toxic = cut(toxic.filter(F.col("hits") >= least), "fit-toxic")
    tried = toxic.count()
    if not tried:
        return Lexicon(words)
    clean = rows.filter("toxic = 0").select("text").mapInArrow(_counts, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    both = toxic.join(cut(clean.join(small(toxic.select("feature")), "feature", "left_semi"), "fit-clean"), "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    a, b, base = F.col("hits"), F.col("n"), n_toxic / (n_toxic + n_clean)
    share = a / (a + b)
    g2 = 2 * (a * F.log(share / base) + F.when(b > 0, b * F.log((1 - share) / (1 - base))).otherwise(F.lit(0.0)))
    good = both.select("feature", share.alias("share"), g2.alias("g2")).filter((F.col("share") >= min(0.8, 3 * base)) & (F.col("g2") > 2 * math.log(tried) + 6))
    # As many rows as entries of a bounded sample pass the bar.
    kept = sorted((-r["g2"], r["feature"], "i" if r["share"] >= 0.9 else "w") for r in good.collect())
    beginnings = {e[:-1]: symbol for _, e, symbol in kept if e.endswith("*")}
    for _, e, symbol in kept:
        if not e.endswith("*"):
            words.setdefault(e, symbol)
    return Lexicon(words, beginnings)


def inputs(counts: np.ndarray, length: float) -> np.ndarray:
    """What the logistic model weighs: 1, for each kind whether it occurs, for each kind the
    magnitude of its count (0 for one, 1 for two or three and so on), and that of the text's length."""
    size = magnitudes(counts)
    return np.concatenate([[1.0], np.minimum(size, 1), np.maximum(size - 1, 0), [length]])


def magnitudes(counts: np.ndarray) -> np.ndarray:
    """The bits of each count: logarithms without a ceiling."""
    return np.array([int(c).bit_length() for c in counts], np.int64)


def length_of(text: str) -> int:
    return len(text).bit_length()


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The lexicon and the weights, from at most so many labelled rows. Without rows of both
    labels the fixed words and fixed weights are used."""
    chosen = sample(docs, labels, rows)
    lexicon = learn_lexicon(chosen)
    prior = np.array([-3.0, *(4.0, 5.0, 0.5, 0.5, 0.5, 4.0, 1.0), *(1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0), 0.0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            codes = []
            for text in batch.column(0).to_pylist():
                code = length_of(text or "")
                for c in magnitudes(clauses(text or "", lexicon, automaton)).tolist():
                    code = (code << _BITS) + c
                codes.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), batch.column(1)], names=["code", "toxic"])

    patterns = chosen.mapInArrow(count, "code long, toxic int").groupBy("code", "toxic").count().collect()  # at most `rows` rows
    if len({r[1] for r in patterns}) < 2:
        return Model(lexicon, prior)
    x = []
    for code, _, _ in patterns:
        places = [code >> _BITS * i & (1 << _BITS) - 1 for i in range(len(KINDS))][::-1]
        x.append(inputs(np.array([(1 << p) - 1 for p in places]), code >> _BITS * len(KINDS)))
    x, y, n = np.array(x), np.array([r[1] for r in patterns], float), np.array([r[2] for r in patterns], float)
    prior[0] = math.log((n @ y + 1) / (n @ (1 - y) + 1))
    ridge = np.array([0.01, *[0.5] * (len(prior) - 1)])
    w = prior.copy()
    for _ in range(60):  # Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * (w - prior))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return Model(lexicon, w)


SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _scores(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = model.scorer()
        for rows in (rows for batch in batches for rows in text_slices(batch, 1)):
            scores = [scored(t) for t in rows.column(1).to_pylist()]
            held = [d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(held), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text; other columns
    are ignored). Null and empty texts get the score of a text without matches. A null doc_id
    is not held out. Repeated rows are scored each for itself; an empty table gives an empty result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scores(model, threshold), SCORE_SCHEMA)


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = model.scorer()
        for rows in (rows for batch in batches for rows in text_slices(batch, at)):
            yield rows.filter(pa.array([scored(t) < threshold for t in rows.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
