"""Byte-level BPE encoding and decoding by a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, text_or_empty

#: Longer texts are encoded in segments of about so many characters.
SEGMENT_CHARS = 1 << 16
#: No match of the pattern spans these: a visible ASCII character, digit or letter and then a
#: blank or line feed. Only the first part of a match can be white space before other signs.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}!-~])(?=[ \n])")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The tiktoken encoding of a rank file, without special tokens; one for each worker."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, chars: int = SEGMENT_CHARS) -> Iterator[str]:
    """Parts of a text that encode independently; a stretch without a safe boundary stays whole."""
    start = 0
    while len(text) - start > chars:
        cut = SAFE.search(text, start + chars)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, coder: tiktoken.Encoding, chars: int = SEGMENT_CHARS) -> np.ndarray:
    if len(text) <= chars:
        return np.array(coder.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(coder.encode_ordinary(part), "<u4") for part in segments(text, chars)])


def bpe_round_trip(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """Encodes every whole text and decodes the ids again, row by row in place: no shuffle.

    Returns id_col, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (raw
    bytes). A null text counts as empty: no ids, no bytes. Repeated rows and null ids come back
    as often as they came. Other columns are not read. An empty table gives an empty result.
    """
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in slices(batches):
            ids = [encode(text, coder, segment_chars) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([coder.decode_bytes(x.tolist()) for x in ids], pa.binary()),
                ],
                names=["id", "n_tokens", "ids", "decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    out = map_arrow(rows, run, f"id {kind}, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)
