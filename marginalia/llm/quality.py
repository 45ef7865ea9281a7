"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import text_buffer
from .common import map_arrow, slices
from .samples import labelled
from .shingles import lower_ascii, words
from .suffix import Hashed, chunks

#: Labelled documents of each class that are fitted on, at most.
MOST_LABELLED = 2048
DIMENSIONS, NEIGHBOURS = 48, 15
#: Neighbours' similarities count with this power.
SHARPNESS = 8
#: Documents in one block of products.
ROWS = 256
#: Terms: trigrams of byte classes over runs, a tail for repeats and lengths, and words by their hash.
N_CLASSES, N_TAIL, N_HASHED = 16, 32, 2048


def byte_classes() -> np.ndarray:
    kinds = np.full(256, 9, np.uint8)
    kinds[:33] = 1
    kinds[10] = 0
    kinds[97:123], kinds[65:91], kinds[48:58] = 2, 3, 4
    for k, signs in enumerate((b".", b",", b"!?", b"|", b"#$%&*@^~", b"-_=+/\\<>", b"'\"()[]{}", b":;`")):
        kinds[list(signs)] = 5 + k if k < 4 else 6 + k
    kinds[0xC0:] = 2
    # the second byte of Latin letters tells capitals from small ones
    kinds[0x80:0xA0], kinds[0xA0:0xC0] = 14, 15
    return kinds


CLASSES = byte_classes()
N_SHAPES = N_CLASSES**3
N_TERMS = N_SHAPES + N_TAIL + N_HASHED


def term_counts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row for each text: shares of the class trigrams, of repeated words and word lengths, and of the
    words with A-Z lowered, by hash."""
    n = len(bounds) - 1
    out = np.zeros((n, N_TERMS), np.float32)
    for first, last in chunks(bounds):
        base = bounds[first]
        part, edges = raw[base : bounds[last]], bounds[first : last + 1] - base
        if not len(part):
            continue
        rows = last - first
        kinds = CLASSES[part]
        doc = np.repeat(np.arange(rows), np.diff(edges))
        new = np.r_[True, (kinds[1:] != kinds[:-1]) | (doc[1:] != doc[:-1])]
        runs, owner = kinds[new].astype(np.int64), doc[new]
        same = owner[2:] == owner[:-2]
        code = (runs[:-2] * N_CLASSES + runs[1:-1]) * N_CLASSES + runs[2:]
        shapes = np.bincount((owner[2:] * N_SHAPES + code)[same], minlength=rows * N_SHAPES).reshape(rows, N_SHAPES)
        table = out[first:last]
        table[:, :N_SHAPES] = shapes / np.maximum(shapes.sum(axis=1, keepdims=True), 1)
        starts, stops, of = words(part, edges)
        if len(starts):
            hashes = Hashed(lower_ascii(part)).of(starts, stops)
            again = np.r_[False, (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])]
            total = np.maximum(np.bincount(of, minlength=rows), 1)
            repeats = np.bincount(of[again], minlength=rows) / total
            long = np.minimum(stops - starts, 23)
            lengths = np.bincount(of * 24 + long, minlength=rows * 24).reshape(rows, 24) / total[:, None]
            table[:, N_SHAPES] = repeats
            table[:, N_SHAPES + 1 : N_SHAPES + 25] = lengths * 0.25
            place = of * N_HASHED + (hashes % np.uint64(N_HASHED)).astype(np.int64)
            table[:, N_SHAPES + N_TAIL :] = np.bincount(place, minlength=rows * N_HASHED).reshape(rows, N_HASHED) / total[:, None]
    return np.sqrt(out, out=out)


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


@dataclass
class Model:
    """Projection, and the labelled vectors of unit length."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        return unit((terms * self.weights) @ self.basis)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled documents; 0 for texts without terms."""
        if not len(self.labels):
            return np.where(terms.any(axis=1), 0.5, 0.0)
        near = self.project(terms) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        which = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.clip(np.take_along_axis(near, which, axis=1), 1e-6, 1).astype(np.float64) ** SHARPNESS
        found = (votes * self.labels[which]).sum(axis=1) / votes.sum(axis=1)
        return np.where(terms.any(axis=1), found, 0.0)


def singular_basis(terms: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors, by randomised subspace iteration from a fixed seed."""
    start = np.random.default_rng(7).standard_normal((terms.shape[1], dimensions + 16)).astype(np.float32)
    base = np.linalg.qr(terms @ start)[0]
    for _ in range(4):
        base = np.linalg.qr(terms @ np.linalg.qr(terms.T @ base)[0])[0]
    return np.linalg.svd(base.T @ terms, full_matrices=False)[2][:dimensions].T.astype(np.float32)


def term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, terms) of (label, text): the nonzero terms as packed places and values."""
    for batch in slices(batches, ROWS):
        table = term_counts(*text_buffer(batch.column(1)))
        packed = [np.flatnonzero(row).astype("<u2").tobytes() + row[row > 0].astype("<f4").tobytes() for row in table]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED, folds=(0, 1, 3)) -> Model:
    """Fits on at most 2 * most labelled documents, a documented bound: their terms are collected."""
    sample = map_arrow(labelled(docs, labels, label, most, {0: list(folds)}).select("label", "text"), term_rows, "label int, terms binary")
    rows = sorted(sample.collect())
    terms, marks = np.zeros((len(rows), N_TERMS), np.float32), np.array([r["label"] for r in rows], np.float64)
    for k, row in enumerate(rows):
        n = len(row["terms"]) // 6
        terms[k, np.frombuffer(row["terms"], "<u2", n)] = np.frombuffer(row["terms"], "<f4", n, 2 * n)
    if not len(rows):
        return Model(np.ones(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), marks)
    # terms that every document has weigh little
    weights = np.log(1 + len(rows) / (1 + (terms > 0).sum(axis=0))).astype(np.float32)
    terms *= weights
    basis = singular_basis(terms, min(DIMENSIONS, len(rows)))
    model = Model(weights, basis, np.zeros((0, 0), np.float32), marks)
    model.vectors = unit(terms @ basis).astype(np.float32)
    return model


def quality_scores(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry (all of docs by default) and score: 0 to 1, higher for label 1.

    Each whole text becomes shares of its words, of byte-class trigrams, of repeated words and of word
    lengths, projected on latent dimensions; in blocks of documents, exact cosines with all labelled vectors
    choose the nearest, which vote by similarity. The model is of bounded size and goes to every
    task; documents are scored in place, without a shuffle. A null, empty or one-sign text scores 0.
    Rows come back as often as they came; a column of docs named score is replaced.
    """
    names = [c for c in (carry or docs.columns) if c != "score"]
    # a text that is carried anyway goes to the workers once
    at = names.index(text_col) if text_col in names else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            scores = model.scores(term_counts(*text_buffer(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], names=[*names, "score"])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())])
    rows = docs.select(*names) if at < len(names) else docs.select(*names, F.col(text_col).cast("string").alias("_text"))
    return map_arrow(rows, run, schema)
