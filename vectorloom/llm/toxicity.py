"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text and normalised by length.

Folding lower-cases, composes compatibility forms, maps look-alike letters of other scripts to Latin ones, maps digits
and signs inside words to the letters they stand for, and leaves words between single spaces. Lexicon entries are whole
words and beginnings of words; their weights are log odds of the share of toxic and of clean labelled documents that
have them. A word counts once, with its heaviest entry; words inside an exception phrase don't count. The score is a
logistic function of the heaviest entry and of the sum of weights by the root of the length. Weights, exception phrases
and the logistic function are fitted on at most FIT_ROWS labelled documents, taken in the order of a hash of the id.

Defined results: a null or wordless text has no matches and the score of such a text. Labels that are null are ignored;
of several labels of a document the largest counts. Without toxic or without clean training documents every score is 0.
Repeated rows are scored each. Other columns of the input are not read. Every text is matched whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.bpe import slices
from vectorloom.llm.shared import materialize, small_batches
from vectorloom.llm.workers import lean

FIT_ROWS = 20_000
LEAST_DOCUMENTS = 3
LEAST_SHARE = 0.004
STEMS = range(3, 9)
Z = 1.3
LEAST_LOG_ODDS = 2.0
THRESHOLD = 0.3

# Look-alikes of Latin letters, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l", "օ": "o", "ս": "u",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
# Phrases in which a word of abuse is none.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "pond scum", "soap scum", "loser bracket", "white trash bag", "stupid simple")

_HOMOGLYPHS = str.maketrans(HOMOGLYPHS)
_DIGITS = str.maketrans(DIGITS)
_LIKE = re.compile(r"(?<=[^\W\d_])[0134578@$!|]+(?=[^\W\d_])|(?<!\S)[0134578@$|]+(?=[^\W\d_]\S*[^\W\d_])")
_ZERO_WIDTH = re.compile("[­​-‏⁠﻿]")
_APART = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The folded words, each between single spaces; a single space if there are none."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _ZERO_WIDTH.sub("", text)).translate(_HOMOGLYPHS)
    text = _LIKE.sub(lambda m: m[0].translate(_DIGITS), text)
    return " " + _APART.sub(" ", text).strip() + " "


def _entries(folded: str) -> set[str]:
    found = set()
    for w in set(folded.split()):
        if not w.isdigit():
            found.add(f" {w} ")
            found.update(f" {w[:k]}" for k in STEMS if k <= len(w))
    return found


@dataclass(frozen=True)
class Lexicon:
    """Weights of entries, exception phrases, and the logistic function over (heaviest, normalised sum)."""

    weights: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS
    logistic: tuple[float, float, float] | None = None
    rows: tuple[int, int] = field(default=(0, 0))


@lru_cache(maxsize=4)
def _automaton(lexicon: Lexicon):
    import ahocorasick

    found: dict[str, float] = dict(lexicon.weights)
    a = ahocorasick.Automaton()
    for e, w in found.items():
        a.add_word(e, (len(e), w, e))
    for phrase in lexicon.exceptions:
        p = fold(phrase)
        a.add_word(p, (len(p), None, p) if p not in found else (len(p), found[p], p))
    if len(a):
        a.make_automaton()
    return a


def matches(lexicon: Lexicon, folded: str) -> dict[int, tuple[float, str]]:
    """The heaviest entry at each matched word's start, outside exception phrases."""
    return _matched(_automaton(lexicon), folded)


def _matched(a, folded: str) -> dict[int, tuple[float, str]]:
    best, spared = {}, []
    if not len(a):
        return best
    for end, (size, weight, entry) in a.iter(folded):
        at = end - size + 1
        if weight is None:
            spared.append((at, end))
        elif at not in best or best[at][0] < weight:
            best[at] = (weight, entry)
    for low, high in spared:
        for at in [x for x in best if low <= x < high]:
            del best[at]
    return best


def features(hits: dict[int, tuple[float, str]], folded: str) -> tuple[float, float, int]:
    """(heaviest weight, sum of weights by the root of the length, number of words) of a text and its matches."""
    weights = [w for w, _ in hits.values()]
    words = len(folded.split())
    return max(weights, default=0.0), sum(weights) / math.sqrt(20 + words), words


def probability(lexicon: Lexicon, heaviest: float, normalised: float) -> float:
    if lexicon.logistic is None:
        return 0.0
    b, w1, w2 = lexicon.logistic
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, b + w1 * heaviest + w2 * normalised))))


def _counted(frame: DataFrame, count) -> DataFrame:
    """(entry, n): count(folded) gives the entries of a document; each task adds up its own first."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(count(fold(text)))
                held[""] += 1
            if len(held) > 1_000_000:
                yield _counts(held)
                held = Counter()
        if held:
            yield _counts(held)

    small_batches(frame)
    return frame.select("text").mapInArrow(lean(run), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["entry", "n"])


def _log_odds(a: int, of_a: int, b: int, of_b: int) -> tuple[float, float]:
    """The log odds ratio and its standard error, with half a document added to each count."""
    w = math.log((a + 0.5) / (of_a - a + 0.5)) - math.log((b + 0.5) / (of_b - b + 0.5))
    return w, math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weakly regularised logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3), x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """docs (doc_id, text), labels (doc_id, toxic): the lexicon. Only the rows of labels that are given are learned from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic"))  # at most fit_rows ids
    rows = materialize(rows, "toxicity-sample")
    toxic, clean = rows.where("toxic"), rows.where("not toxic")

    spare = re.compile("|".join(re.escape(fold(p)) for p in exceptions) or "(?!)")

    def entries(folded: str) -> set[str]:
        return _entries(spare.sub(" ", folded))

    # Entries of at least this share of the toxic documents: their number does not grow with the input.
    counted = _counted(toxic, entries)
    total = counted.where("entry = ''").select("n").first()
    if total is None:
        return Lexicon(exceptions=exceptions)
    least = max(LEAST_DOCUMENTS, math.ceil(LEAST_SHARE * total[0]))
    in_toxic = {r["entry"]: r["n"] for r in counted.where(F.col("n") >= least).collect() if r["entry"]}
    candidates = frozenset(in_toxic)

    def known_entries(folded: str) -> set[str]:
        return entries(folded) & candidates

    in_clean = {r["entry"]: r["n"] for r in _counted(clean, known_entries).collect()}
    n_toxic, n_clean = total[0], in_clean.get("", 0)
    if not n_clean:
        return Lexicon(exceptions=exceptions)
    weights = []
    for e, a in sorted(in_toxic.items()):
        w, se = _log_odds(a, n_toxic, in_clean.get(e, 0), n_clean)
        if w - Z * se >= LEAST_LOG_ODDS:
            weights.append((e, w))
    lexicon = Lexicon(tuple(weights), exceptions, None, (n_toxic, n_clean))

    # Exception phrases: a word of the lexicon with a neighbour, in clean documents again and again and never in toxic ones.
    def phrases(folded: str) -> set[str]:
        out = set()
        for at in matches(lexicon, folded):
            end = folded.find(" ", at + 1)
            before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
            if before >= 0:
                out.add(folded[before : end + 1])
            if after >= 0:
                out.add(folded[at : after + 1])
        return out

    spared = {r["entry"] for r in _counted(clean, phrases).where(F.col("n") >= max(5, math.ceil(5e-4 * n_clean))).collect() if r["entry"]}
    if spared:
        spared -= {r["entry"] for r in _counted(toxic, phrases).where(F.col("entry").isin(sorted(spared))).collect()}
        lexicon = Lexicon(lexicon.weights, (*exceptions, *sorted(p.strip() for p in spared)), None, lexicon.rows)

    seen = _featured(rows.select("toxic", "text"), lexicon, "toxic").select("toxic", "heaviest", "normalised").toPandas()
    logistic = _fit_logistic(seen[["heaviest", "normalised"]].to_numpy(float), seen["toxic"].to_numpy(float))
    return Lexicon(lexicon.weights, lexicon.exceptions, logistic, lexicon.rows)


def _featured(frame: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    """key, score, heaviest, normalised, n_words, matched (the entries that matched) of every row of frame (key, text)."""

    def run(batches):
        automaton = _automaton(lexicon)
        for batch in batches:
            for part in slices(batch):
                folded = [fold(t) for t in part.column(1).to_pylist()]
                hits = [_matched(automaton, x) for x in folded]
                f = [features(h, x) for h, x in zip(hits, folded, strict=True)]
                matched = [sorted({e.strip() for _, e in h.values()}) for h in hits]
                columns = [part.column(0), pa.array([probability(lexicon, x, y) for x, y, _ in f], pa.float64()), *(pa.array([x[k] for x in f], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.int64())))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(matched, pa.list_(pa.string()))], names=["key", "score", "heaviest", "normalised", "n_words", "matched"])

    small_batches(frame)
    kind = frame.schema[key].dataType.simpleString()
    source = frame.select(F.col(key).alias("key"), "text")
    out = source.mapInArrow(lean(run), f"key {kind}, score double, heaviest double, normalised double, n_words long, matched array<string>")
    return out.withColumnRenamed("key", key)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, heaviest, normalised, n_words, matched of every row of docs. Narrow: no shuffle."""
    return _featured(docs.select(F.col(id_col), F.col(text_col).alias("text")), lexicon, id_col)


def accept(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns. Narrow: no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        automaton = _automaton(lexicon)
        for batch in batches:
            for part in slices(batch):
                folded = [fold(t) for t in part.column(at).to_pylist()]
                scores = [probability(lexicon, *features(_matched(automaton, x), x)[:2]) for x in folded]
                yield part.filter(pa.array([x < threshold for x in scores], pa.bool_()))

    small_batches(docs)
    return docs.mapInArrow(lean(run), docs.schema)
