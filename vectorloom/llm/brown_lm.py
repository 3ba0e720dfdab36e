"""Language-model scores by a Brown class-based bigram model.

Tokens are the words (without ASCII white space, A-Z lower-cased), then one end. Every training document is counted, word
by word, into a written table. Words whose share of the training tokens is at least RATE are clustered: a number that the
rate bounds, whatever the input, and nearly all tokens. Clusters start from the exchange algorithm, which moves the most
frequent words (seeds) one by one between classes while the likelihood of the training bigrams rises. Then, in sweeps over
the corpus, every clustered word's neighbours are counted by class, and the owner of a range of words moves each word to
the class that raises the likelihood most against the classes as they were before the sweep. All other words, seen or
not, are one class, RARE. A text's score is the sum over its tokens of

    log10 P(class | previous class) + log10 P(word | class)

with transitions smoothed towards the classes' shares, emissions by ALPHA for each word of a class, and the share of RARE
that unseen words get being that of words seen once. Where words seen once are clustered, they count for RARE's
transitions too, as unseen words turn up where they do. Clustered words' counts travel to the scoring workers; the few
other tokens meet the table of counts in a join, one row for each document and word.

Defined results: a null text counts as empty: one end. Without training documents counts are 0, and so is the base
score. Null ids are carried. Repeated rows count, and are scored, each. An empty table gives no rows. Other columns of the
input are not read. Every text is read whole. At a tie a word takes the lowest class; a word that follows itself counts
as next to its class as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.shared import materialize, small_batches
from vectorloom.llm.varints import pack_gaps, unpack_gaps

CLASSES = 32
#: Words are clustered from this share of the training tokens on: at most 1 / RATE words, fewer than a tenth of that in texts.
RATE = 1e-7
SEEDS = 1000
SWEEPS = 12
WORD_SWEEPS = 2
ALPHA = 0.1
BETA = 10.0
#: Tokens that are counted together before their counts leave a worker (words, neighbours), and words of one owner.
FLUSH_TOKENS = 4_000_000
FLUSH_NEIGHBOURS = 1_500_000
GROUP_BYTES = 4 << 20
SPAN = 4096
SEED_SPAN = 64


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of every unit but the last (the end, whose class is its own: `classes`), by the exchange algorithm.

    bigrams[u, v]: how often v follows u. Units start dealt to classes by falling frequency, and are visited so; a unit
    moves to the class that raises sum N(j, k) log N(j, k) - sum over both sides of N(k) log N(k) most."""
    n = len(bigrams) - 1
    count = bigrams.astype(np.float64)
    order = np.argsort(-count[:n].sum(axis=1), kind="stable")
    label = np.full(n + 1, classes)
    label[order] = np.arange(n) % classes
    f = lambda x: x * np.log(np.maximum(x, 1))
    one = np.zeros((n + 1, classes + 1))
    one[np.arange(n + 1), label] = 1
    table = one.T @ count @ one
    right, left = count @ one, count.T @ one  # of every unit: by the class that follows, that goes before
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            a, own = label[u], count[u, u]
            r, m = right[u].copy(), left[u].copy()
            if r.sum() + m.sum() == 0:
                continue
            table[a] -= r
            table[:, a] -= m
            table[a, a] += own
            r[a] -= own
            m[a] -= own
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            gain = (f(table + r) - f(table)).sum(axis=1) + (f(table + m[:, None]) - f(table)).sum(axis=0)
            d = np.diagonal(table)
            gain += f(d + r + m + own) - f(d + r) - f(d + m) + f(d)
            gain -= f(rows + r.sum() + own) - f(rows) + f(columns + m.sum() + own) - f(columns)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += m
            table[b, b] += own
            if b != a:
                moved += 1
                label[u] = b
                right[:, a] -= count[:, u]
                right[:, b] += count[:, u]
                left[:, a] -= count[u]
                left[:, b] += count[u]
        if not moved:
            break
    return label[:n]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, one after the other; how many each has)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    real = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty word
    if real.all():
        return flat, sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)[real]
    return flat.filter(pa.array(real)), np.bincount(doc, minlength=len(sizes))


def _word_counts(rows: DataFrame) -> DataFrame:
    """word, n of all training texts (column text)."""

    def run(batches):
        held, size = [], 0
        for batch in _with_end(batches):
            if batch is not None:
                held.append(split(batch.column(0))[0])
                size += len(held[-1])
            if size and (batch is None or size >= FLUSH_TOKENS):
                found = pa.chunked_array(held).value_counts()
                for at in range(0, len(found), 20_000):
                    yield pa.RecordBatch.from_arrays([x.cast(k) for x, k in zip(found[at : at + 20_000].flatten(), (pa.string(), pa.int64()), strict=True)], names=["word", "n"])
                held, size = [], 0

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _with_end(batches):
    yield from batches
    yield None


@dataclass(frozen=True)
class Vocabulary:
    """The clustered words by falling count, with their counts."""

    words: pa.Array
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """(the number of each word of all texts, len(self) if it is not clustered; how many words each text has; the words)."""
        flat, sizes = split(texts)
        found = flat.dictionary_encode()
        of = pc.index_in(found.dictionary, value_set=self.words).fill_null(len(self)).to_numpy()
        return of[found.indices.to_numpy()], sizes, found


def _grouped(batches):
    """Batches put together up to GROUP_BYTES: looking words up has a cost for each call."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    rest = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    yield from rest


def _line(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """All texts in one line, with the end before, between and after them."""
    return np.concatenate([[end], np.insert(ids, np.cumsum(sizes), end)])


NEAR = "slice long, keys binary, counts binary, cell long, n long"


def _neighbours(rows: DataFrame, v: Vocabulary, code: np.ndarray, k: int, words: int, span: int, pairs: bool) -> DataFrame:
    """Counts of what stands before and after the first so many words, by the neighbours' codes: rows of a slice of span words,
    with word * 2k + code for what stands before and word * 2k + k + code for what stands after. If asked for: rows of a cell
    a * k + b with how often code b follows code a. code: of every word, of all other words, and of the end; below k.

    Words that occur once count in the cells a second time, as other words."""
    once = np.append(v.counts == 1, [False, False])
    other = code[len(v)]

    def flush(keys: list):
        found, n = np.unique(np.concatenate(keys), return_counts=True)
        part = found // (2 * k * span)
        bounds = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = int(part[a])
            yield (own, pack_gaps(found[a:b] - own * 2 * k * span), pack_gaps(np.cumsum(n[a:b])), None, None)

    def run(batches):
        held, size, cells = [], 0, np.zeros(k * k if pairs else 0, np.int64)
        for batch in _with_end(_grouped(batches)):
            rows = []
            if batch is not None:
                ids, sizes, _ = v.ids(batch.column(0))
                line = _line(ids, sizes, len(v) + 1)
                codes = code[line]
                if pairs:
                    cells += np.bincount(codes[:-1] * k + codes[1:], minlength=k * k)
                    at = np.flatnonzero(once[line])
                    cells += np.bincount(codes[at - 1] * k + other, minlength=k * k) + np.bincount(other * k + codes[at + 1], minlength=k * k)
                at = np.flatnonzero(line < words)
                first = line[at].astype(np.int64) * (2 * k)
                held += [first + codes[at - 1], first + k + codes[at + 1]]
                size += len(at)
            if size and (batch is None or size >= FLUSH_NEIGHBOURS):
                rows += flush(held)
                held, size = [], 0
            if batch is None:
                rows += [(None, None, None, int(c), int(cells[c])) for c in np.flatnonzero(cells)]
            for at in range(0, len(rows), 64):
                columns = list(zip(*rows[at : at + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["slice", "keys", "counts", "cell", "n"])

    return rows.mapInArrow(run, NEAR)


def _cells(near: DataFrame, k: int) -> np.ndarray:
    found = near.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most k * k rows
    table = np.zeros(k * k)
    for r in found:
        table[r["cell"]] = r["n"]
    return table.reshape(k, k)


def _merged(table: pa.Table, k: int, span: int) -> np.ndarray:
    """(span, 2k): the counts of all rows of one slice."""
    dense = np.zeros(span * 2 * k)
    for keys, counts in zip(table["keys"], table["counts"], strict=True):
        dense[unpack_gaps(keys.as_py()).astype(np.int64)] += np.diff(unpack_gaps(counts.as_py()).astype(np.int64), prepend=0)
    return dense.reshape(span, 2 * k)


def _seed_bigrams(rows: DataFrame, v: Vocabulary, seeds: int) -> np.ndarray:
    """(seeds + 1, seeds + 1): how often one seed follows another; the last is the end."""
    k = seeds + 2
    code = np.full(len(v) + 2, seeds + 1)
    code[:seeds], code[-1] = np.arange(seeds), seeds

    def add(table: pa.Table) -> pa.Table:
        dense = _merged(table, k, SEED_SPAN).ravel()
        at = np.flatnonzero(dense)
        return pa.table({"slice": table["slice"][:1], "keys": pa.array([pack_gaps(at)], pa.binary()), "counts": pa.array([pack_gaps(np.cumsum(dense[at]))], pa.binary())})

    near = _neighbours(rows, v, code, k, seeds, SEED_SPAN, False).drop("cell", "n")
    found = near.groupBy("slice").applyInArrow(add, "slice long, keys binary, counts binary").toArrow()  # at most seeds * 2k counts
    out = np.zeros((seeds + 1, seeds + 1))
    for r in range(found.num_rows):
        part, first = found.slice(r, 1), found["slice"][r].as_py() * SEED_SPAN
        dense = _merged(part, k, SEED_SPAN)[: max(0, seeds - first)]
        out[first : first + len(dense), : seeds + 1] = dense[:, k : k + seeds + 1]
        out[seeds, first : first + len(dense)] = dense[:, seeds]
    return out


def best_classes(right: np.ndarray, left: np.ndarray, own: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word that raises the likelihood most, all others staying as they are.

    right, left: each word's counts by the class after and before it. own: its present class; classes + 1: none.
    table: how often a class follows another. A word stays if no class is better than its own."""
    f = lambda x: x * np.log(np.maximum(x, 1))
    after, before = table.sum(axis=1), table.sum(axis=0)
    out = own.copy()
    for at in range(0, len(own), 256):
        r, m, a = right[at : at + 256], left[at : at + 256], own[at : at + 256]
        rs, ms = r.sum(axis=1)[:, None], m.sum(axis=1)[:, None]
        to, of = table[:classes], table.T[:classes]
        gain = (f(to + r[:, None]) - f(to)).sum(axis=2) + (f(of + m[:, None]) - f(of)).sum(axis=2)
        gain -= f(after[:classes] + rs) - f(after[:classes]) + f(before[:classes] + ms) - f(before[:classes])
        has = np.flatnonzero(a < classes)
        if len(has):
            k = a[has]
            less = lambda x, y: f(x) - f(np.maximum(x - y, 0))
            gain[has, k] = less(table[k], r[has]).sum(axis=1) + less(table.T[k], m[has]).sum(axis=1) - less(after[k], rs[has, 0]) - less(before[k], ms[has, 0])
        best = gain.argmax(axis=1)
        stays = np.zeros(len(a), bool)
        stays[has] = gain[has, best[has]] <= gain[has, a[has]] + 1e-9
        out[at : at + 256] = np.where(stays, a, best)
    return out


def _sweep(rows: DataFrame, v: Vocabulary, label: np.ndarray, classes: int) -> np.ndarray:
    """The class of every clustered word after all have been moved against the present classes."""
    k = classes + 2
    near = materialize(_neighbours(rows, v, np.append(label, [classes + 1, classes]), k, len(v), SPAN, True), "brown-neighbours")
    table = _cells(near, k)

    def move(rows_of: pa.Table) -> pa.Table:
        first = rows_of["slice"][0].as_py() * SPAN
        own = label[first : first + SPAN]
        dense = _merged(rows_of, k, SPAN)[: len(own)]
        new = best_classes(dense[:, k:], dense[:, :k], own, table, classes)
        return pa.table({"slice": rows_of["slice"][:1], "label": pa.array([new.astype("<i4").tobytes()], pa.binary())})

    out = label.copy()
    moved = near.where("slice is not null").select("slice", "keys", "counts").groupBy("slice").applyInArrow(move, "slice long, label binary")
    for r in moved.toLocalIterator():  # four bytes a clustered word
        new = np.frombuffer(r["label"], "<i4")
        out[r["slice"] * SPAN : r["slice"] * SPAN + len(new)] = new
    return out


@dataclass(frozen=True)
class Model:
    """tokens, types: of the training documents, ends included; ends: training documents. label: of every clustered word.
    transition: log10, by class, then the end, then RARE. size, types_of: tokens and words of each class. rare: tokens of
    words that aren't clustered; once: words seen once."""

    vocabulary: Vocabulary
    tokens: int
    types: int
    ends: int
    label: np.ndarray
    transition: np.ndarray
    size: np.ndarray
    types_of: np.ndarray
    rare: int
    once: int

    @property
    def classes(self) -> int:
        return len(self.size)

    @property
    def unseen(self) -> float:
        """The share of RARE that words never seen have together; each has it over once + 1."""
        return (self.once + 1) / (self.rare + self.once + 1)

    def emission(self) -> np.ndarray:
        """log10 P(word | class) of every clustered word."""
        return np.log10((self.vocabulary.counts + ALPHA) / (self.size[self.label] + ALPHA * self.types_of[self.label]))

    def base(self, counts) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def learn(rows: DataFrame, words: DataFrame, classes: int, rate: float = RATE, seeds: int = SEEDS, sweeps: int = WORD_SWEEPS) -> Model:
    """The model of the training rows (columns train, text) with their counted words."""
    total = words.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.sum((F.col("n") == 1).cast("long")).alias("once")).first()
    text, ends = rows.where("train").select("text"), rows.where("train").count()
    tokens, types = (total["tokens"] or 0) + ends, total["types"] + (ends > 0)
    own = words.where(F.col("n") >= rate * tokens).orderBy(F.desc("n"), "word").toArrow()  # at most 1 / rate rows
    counts = own["n"].to_numpy().astype(np.int64)
    v = Vocabulary(own["word"].combine_chunks().cast(pa.string()), counts)

    label = np.full(len(v), classes + 1)
    if len(v):
        seeds = min(seeds, len(v))
        label[:seeds] = exchange(_seed_bigrams(text, v, seeds), classes)
        for _ in range(sweeps):
            label = _sweep(text, v, label, classes)
        label[label > classes] = 0  # without a sweep: not in reach of a seed
    k = classes + 2
    pairs = _cells(_neighbours(text, v, np.append(label, [classes + 1, classes]), k, 0, SPAN, True), k)
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + k)
    transition = np.log10((pairs + BETA * share) / (pairs.sum(axis=1, keepdims=True) + BETA))
    size, types_of = np.bincount(label, counts, minlength=classes), np.bincount(label, minlength=classes)
    return Model(v, tokens, types, ends, label, transition, size, types_of, int(tokens - ends - counts.sum()), total["once"] or 0)


def scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, rate: float = RATE) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs. train: which rows to learn from."""
    small_batches(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    words = materialize(_word_counts(rows.where("train").select("text")), "brown-words")
    model = learn(rows, words, classes, rate)
    v, end = model.vocabulary, classes
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:string,times:long>>"
    rare_type = pa.struct([("word", pa.string()), ("times", pa.int64())])

    def run(batches):
        code = np.append(model.label, [classes + 1, end])
        emission, base = np.append(model.emission(), 0.0), np.append(model.base(v.counts), 0.0)
        end_base, end_known = float(model.base(np.float64(model.ends))), int(model.ends > 0)
        for batch in _grouped(batches):
            ids, sizes, found = v.ids(batch.column(3))
            n = len(sizes)
            codes = code[_line(ids, sizes, len(v) + 1)]
            first = np.cumsum(sizes + 1) - sizes - 1
            steps = np.add.reduceat(model.transition[codes[:-1], codes[1:]], first)
            doc = np.repeat(np.arange(n), sizes)
            sums = [np.bincount(doc, x[ids], minlength=n) for x in (emission, base)]
            known = np.bincount(doc[ids < len(v)], minlength=n)
            # The words that aren't clustered, once for each document.
            at = np.flatnonzero(ids == len(v))
            which, times = np.unique(doc[at] * len(found.dictionary) + found.indices.to_numpy()[at], return_counts=True)
            word = found.dictionary.take(pa.array(which % max(1, len(found.dictionary))))
            offsets = np.searchsorted(which, np.arange(n + 1) * len(found.dictionary))
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([word.cast(pa.string()), pa.array(times, pa.int64())], fields=list(rare_type)))
            columns = [batch.column(0), batch.column(1), pc.invert(batch.column(2)), pa.array(sizes + 1, pa.int64()), pa.array(known + end_known, pa.int64()), pa.array(sums[1] + end_base), pa.array(steps + sums[0]), rare]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "train", "text")
    part = materialize(numbered.mapInArrow(run, ddl), "brown-scores")
    rest = part.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times").join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    unseen = model.unseen
    base = F.log10((F.col("n") + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
    emission = F.when(F.col("n") > 0, F.log10(F.col("n") * (1 - unseen) / max(1, model.rare))).otherwise(float(np.log10(unseen / (model.once + 1))))
    more = rest.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(base * F.col("times")).alias("more_base"), F.sum(emission * F.col("times")).alias("more"))
    done = part.drop("rare").join(more, "row", "left").fillna(0, ["more_known", "more_base", "more"])
    done = done.select("id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("more_base")).alias("base_score"), (F.col("score") + F.col("more")).alias("score"))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return done.withColumn("perplexity", perplexity).withColumnRenamed("id", id_col)
