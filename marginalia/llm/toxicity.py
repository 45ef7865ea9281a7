"""Toxicity by class-conditional Kneser-Ney models over the spelling of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stash, unstash
from .common import map_arrow, slices, tidy
from .samples import first_rows, labelled, share
from .suffix import Hashed

#: Labelled documents of each class whose words are counted, and that calibrate, at most; and the most
#: bytes of their texts.
MOST_COUNTED, MOST_CALIBRATED, MOST_BYTES = 1500, 1000, 6 << 20
#: Bytes in a gram: the predicted one and what it depends on, at most.
ORDER = 8
DISCOUNT = 0.75
#: Counts that each class takes over from both classes' shared distribution of a context: choices.
SHARED = (3.0, 30.0)
#: A toxic document draws a word from the toxic model with this probability, else from the ordinary one:
#: choices. Most words of toxic documents are ordinary ones; without this share, the mix of languages and
#: subjects in the samples, which shifts all words a little, would drown the few telling ones.
MIXED = (0.03, 0.01, 0.003, 0.001)
ROWS = 1024
CACHED_WORDS = 500_000
#: Signs around a word that do not belong to it.
SIGNS = ".,;:!?\"'()[]{}*#$%&|<>-_+=/\\`~^@…«»“”„"
#: Marks of a word's start and end in the buffer.
START, END = b"\x02", b"\x03"


def bare(word: str) -> str:
    return word.strip(SIGNS)


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Bounds of the texts' tokens, the distinct tokens (lower case, without signs around), and each
    token's place among them."""
    lowered = pa.compute.utf8_lower(pa.compute.fill_null(texts, ""))
    for space in "\n\t\r":
        lowered = pa.compute.replace_substring(lowered, space, " ")
    found = pa.compute.split_pattern(lowered, " ")
    bounds = found.offsets.to_numpy() - found.offsets[0].as_py()
    coded = found.flatten().dictionary_encode()
    return bounds, [bare(x) for x in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64)


def spelling(words: list[str]) -> tuple[Hashed, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in a buffer: its fingerprints, the start of each predicted byte's word, its
    place, and its word. The end mark is predicted too, the start mark is not."""
    coded = [START + w.encode() + END for w in words]
    raw = np.frombuffer(b"".join(coded), np.uint8)
    sizes = np.array(list(map(len, coded)), np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes - 1)
    place = np.delete(np.arange(len(raw)), begin)
    return Hashed(raw), begin[owner], place, owner


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def totals(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, weights, len(distinct))


@dataclass
class Model:
    """Log ratios of the two classes' probabilities by gram, and by context for grams that neither
    class has; where neither has the context both back off alike and the ratio is 0."""

    grams: np.ndarray
    gram_ratios: np.ndarray
    contexts: np.ndarray
    context_ratios: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0
    mixed: float = MIXED[1]
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def learn(self, words: list[str]) -> None:
        hashed, begin, place, owner = spelling(words)
        start = np.maximum(begin, place - (ORDER - 1))
        gram, context = hashed.of(start, place + 1), hashed.of(start, place)
        ratio = lookup(self.grams, self.gram_ratios, gram, np.nan)
        ratio = np.where(np.isnan(ratio), lookup(self.contexts, self.context_ratios, context), ratio)
        ratio = np.bincount(owner, ratio, len(words))
        self.cache.update(zip(words, ratio.tolist()))

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """log P(word) of the toxic model less that of the ordinary one; 0 for no word."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        self.cache[""] = 0.0
        new = list({w for w in words if w not in self.cache})
        if new:
            self.learn(new)
        return np.array([self.cache[w] for w in words] or [0.0])

    def ratios(self, texts: pa.Array, choices: tuple[float, ...] = ()) -> np.ndarray:
        """log P(text | toxic) less log P(text | ordinary), divided by the number of words; 0 without
        words. A toxic text's words come from the ordinary model but for a share mixed; choices gives
        several such shares, and a column for each."""
        bounds, words, which = split_words(texts)
        likelihoods = np.expm1(np.clip(self.word_ratios(words), -50, 50))
        counts = np.r_[0, np.cumsum(np.array([bool(w) for w in words] or [False])[which])]
        n = np.maximum(counts[bounds[1:]] - counts[bounds[:-1]], 1)
        out = []
        for share in choices or (self.mixed,):
            sums = np.r_[0.0, np.cumsum(np.log1p(share * likelihoods)[which])]
            out.append((sums[bounds[1:]] - sums[bounds[:-1]]) / n)
        return np.stack(out, axis=1) if choices else out[0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.ratios(texts) + self.intercept, -30, 30)))


def shared_backoff(hashed: Hashed, begin: np.ndarray, place: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Kneser-Ney probabilities of the chosen places' bytes after the longest context but one, from
    the words of both classes together: a gram counts as often as different bytes stand before it."""
    depth = place - begin
    value = np.full(len(chosen), 1 / 256)
    for size in range(1, ORDER):
        # grams of size bytes that have a byte before them inside their word
        can = np.flatnonzero(depth >= size)
        longer = hashed.of(place[can] - size, place[can] + 1)
        first = can[np.unique(longer, return_index=True)[1]]
        gram = hashed.of(place[first] - size + 1, place[first] + 1)
        context = hashed.of(place[first] - size + 1, place[first])
        grams, counts = totals(gram, np.ones(len(gram)))
        contexts, sums = totals(context, np.ones(len(context)))
        kinds, at = np.unique(gram, return_index=True)
        follow_keys, follows = totals(context[at], np.ones(len(kinds)))
        own = np.flatnonzero(sizes[chosen] > size)
        spot = place[chosen[own]]
        own_context = hashed.of(spot - size + 1, spot)
        seen = lookup(contexts, sums, own_context)
        count = lookup(grams, counts, hashed.of(spot - size + 1, spot + 1))
        kept = np.maximum(count - DISCOUNT, 0) + DISCOUNT * lookup(follow_keys, follows, own_context) * value[own]
        value[own] = np.where(seen > 0, kept / np.maximum(seen, 1), value[own])
    return value


def interpolated(
    gram: np.ndarray, context: np.ndarray, weight: np.ndarray, chosen: np.ndarray, backoff: np.ndarray, shared: float
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Probabilities at the chosen places from discounted counts and backoff; and by context, the
    weight that is left for backoff."""
    some = weight > 0
    keys, sums = totals(context[some], weight[some])
    own, counts = totals(gram[some], weight[some])
    kinds = np.unique(gram[some], return_index=True)[1]
    follow_keys, follows = totals(context[some][kinds], np.ones(len(kinds)))
    left = (DISCOUNT * lookup(follow_keys, follows, keys) + shared) / (sums + shared)
    seen, rest = lookup(keys, sums, context[chosen]), lookup(keys, left, context[chosen], 1.0)
    kept = np.maximum(lookup(own, counts, gram[chosen]) - DISCOUNT, 0) / np.maximum(seen + shared, 1e-9)
    return np.where(seen > 0, kept, 0) + rest * backoff, (keys, left)


def train(words: list[str], toxic: np.ndarray, ordinary: np.ndarray, shared: float = SHARED[-1]) -> Model:
    """words: distinct; the others: how often documents of each class have them."""
    if not words:
        empty = np.zeros(0, np.uint64)
        return Model(empty, np.zeros(0), empty, np.zeros(0))
    hashed, begin, place, owner = spelling(words)
    start = np.maximum(begin, place - (ORDER - 1))
    gram, context = hashed.of(start, place + 1), hashed.of(start, place)
    grams, chosen = np.unique(gram, return_index=True)
    backoff = shared_backoff(hashed, begin, place, place + 1 - start, chosen)
    # first the whole gram counted in both classes together, then each class on top of that
    pooled, _ = interpolated(gram, context, (toxic + ordinary)[owner], chosen, backoff, 0.0)
    logs, spreads = [], []
    for weight in (toxic, ordinary):
        value, spread = interpolated(gram, context, weight[owner], chosen, pooled, shared)
        logs.append(np.log(value))
        spreads.append(spread)
    contexts = np.union1d(spreads[0][0], spreads[1][0])
    left = [np.log(lookup(*spread, contexts, 1.0)) for spread in spreads]
    ratios = [(x[0] - x[1]).astype(np.float32) for x in (logs, left)]
    del logs, left, spreads, hashed, gram, context, backoff, pooled
    tidy()
    return Model(grams, ratios[0], contexts, ratios[1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-4 * a, (weight * (p - y)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1e-4, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -50, 50)), b - float(np.clip(step[1], -5, 5))
    return a, b


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, ROWS):
        label = batch.column(0).to_numpy()
        bounds, words, which = split_words(batch.column(1))
        doc = np.repeat(np.arange(len(label)), np.diff(bounds))
        counts = [np.bincount(which[label[doc] == k], minlength=len(words)) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array(x.astype(np.int64)) for x in counts)], names=["word", "ordinary", "toxic"]
        )


def counted_words(sample: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of (label, text), and how often documents of label 1 and of label 0 have them."""
    rows = map_arrow(sample.select("label", "text"), word_counts, "word string, ordinary long, toxic long").where("word <> ''")
    table = rows.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow().sort_by("word")
    return table.column("word").to_pylist(), table.column("toxic").to_numpy(), table.column("ordinary").to_numpy()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    most: int = MOST_COUNTED,
    calibrated: int = MOST_CALIBRATED,
    most_bytes: int = MOST_BYTES,
    folds=(0, 1),
    last_fold: int = 3,
) -> Model:
    """Counts words of at most 2 * most labelled documents in folds, and calibrates on at most
    2 * calibrated in last_fold the score of each choice of SHARED and MIXED. The best choice then
    counts in all these folds, at most 2 * most documents again; no class's texts have more than
    most_bytes together. These are documented bounds, so that words and ratios may be collected."""
    halves = {0: list(folds), 1: [last_fold]}
    sample = stash(labelled(docs, labels, label, max(most, calibrated), halves), "toxicity-sample")
    counts = counted_words(first_rows(sample.where("part = 0"), most, most_bytes))
    models = [train(*counts, shared) for shared in SHARED]
    del counts

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            table = np.hstack([model.ratios(batch.column(1), MIXED) for model in models])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(table))], names=["label", "ratios"])

    last = first_rows(sample.where("part = 1"), calibrated, most_bytes).select("label", "text")
    found = map_arrow(last, rated, "label int, ratios array<double>").toArrow()
    del models
    y = found.column("label").to_numpy().astype(np.float64)
    base = share(labels, label, [*folds, last_fold])
    best, shared, mixed, slope, intercept = np.inf, SHARED[-1], MIXED[1], 1.0, float(np.log((base + 1e-6) / (1 - base + 1e-6)))
    if len(y) and 0 < y.sum() < len(y):
        weight = np.where(y > 0, base / y.mean(), (1 - base) / (1 - y.mean()))
        table = np.array(found.column("ratios").to_pylist())
        for k, x in enumerate(table.T):
            scale = float(np.std(x)) or 1.0
            a, b = logistic(x / scale, y, weight)
            p = np.clip(1 / (1 + np.exp(-np.clip(a * x / scale + b, -30, 30))), 1e-6, 1 - 1e-6)
            loss = -float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())
            # a model that takes toxic words for ordinary ones has learned noise
            if loss < best and a > 0:
                best, slope, intercept = loss, a / scale, b
                shared, mixed = SHARED[k // len(MIXED)], MIXED[k % len(MIXED)]
    model = train(*counted_words(first_rows(sample, most, most_bytes)), shared)
    unstash(sample)
    model.mixed, model.slope, model.intercept = mixed, slope, intercept
    return model


def toxicity_scores(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry (all of docs by default) and score: 0 to 1, higher for label 1.

    Two interpolated Kneser-Ney models spell each word of the whole text, one counted in toxic and
    one in ordinary documents, with one backoff counted in both. An ordinary text's words come from
    the second, a toxic text's from both, mixed with a fixed share of the first; the difference of
    the text's two log-likelihoods, divided by the number of words, is calibrated to a probability. Distinct words
    are spelled once for each worker. Documents are scored in place, without a shuffle. A null or
    empty text has difference 0. Rows come back as often as they came; a column of docs named score
    is replaced.
    """
    names = [c for c in (carry or docs.columns) if c != "score"]
    # a text that is carried anyway goes to the workers once
    at = names.index(text_col) if text_col in names else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            scores = model.scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores)], names=[*names, "score"])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())])
    rows = docs.select(*names) if at < len(names) else docs.select(*names, F.col(text_col).cast("string").alias("_text"))
    return map_arrow(rows, run, schema)
