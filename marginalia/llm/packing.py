"""Order-preserving packing of tokenised documents into bounded sequences."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_arrow, slices, text_or_empty

CAPACITY = 4096
END_ID = 2
#: What a cut inside a document costs, in tokens of padding: after a sentence, or elsewhere.
SENTENCE_COST, HARD_COST = 4, 24
#: Stretches without the end of a sentence may be cut at multiples of so many tokens.
HARD_STEP = 64
#: A stretch of the stream is cut up at once when it has so many tokens; it ends with a document.
SHARD_TOKENS = 1 << 20
#: Documents that are encoded together.
ROWS = 1024
#: Words whose ids a worker keeps.
CACHED_WORDS = 200_000
#: Fixed: the tokenizer's mark of a word's end, and signs that end a sentence.
WORD_END, STOP = "</w>", re.compile(r"[.!?…。！？]")
#: Signs that often follow a word; words are kept without them.
TAIL = ".,;:!?"
#: Letters that normalise to a letter and a mark keep the signs after them: one before BEYOND does, and
#: words that end beyond it (Latin, Greek and Cyrillic lie before) are not split.
DOTTED, BEYOND = "\u0130", "\u0530"
#: Fixed: the normaliser and the first split of the tokenizer whose texts may be encoded word by word.
BY_WORD = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)


def by_word(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer lowers case, drops white space and joins nothing across it, in the way that
    WordEncoder takes advantage of."""
    said = json.loads(tokenizer.to_str())
    splits = (said["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    found = ((said["normalizer"] or {}).get("normalizers"), splits[0].get("pattern", {}).get("Regex"))
    return found == BY_WORD and said["post_processor"] is None and said["model"].get("end_of_word_suffix") == WORD_END


class WordEncoder(dict):
    """Ids by words, for a tokenizer that lowers case, drops white space and joins nothing across it: a
    text's ids are its words' ids in a row, and each distinct word needs the tokenizer once. Texts of any
    other tokenizer are encoded as they are."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.by_word = by_word(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.stops = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends = self.stops.copy()
        for token, at in vocabulary.items():
            sign = token.removesuffix(WORD_END)
            self.ends[at] = token != sign
            self.stops[at] = (token != sign or not self.by_word) and bool(STOP.search(sign)) and not any(map(str.isalnum, sign))
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.hits = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def shrink(self, most: int) -> None:
        """Forgets all but the `most` words that were met most often, and of these the ones met once."""
        order = np.argsort(-self.hits, kind="stable")[:most]
        order = np.sort(order[self.hits[order] > 1])
        words = list(self)
        lengths = self.lengths[order]
        ends = np.cumsum(lengths)
        self.flat = self.flat[np.repeat(self.starts[order] - (ends - lengths), lengths) + np.arange(lengths.sum())]
        self.starts, self.lengths, self.hits = ends - lengths, lengths, self.hits[order] // 2
        self.clear()
        self.update((words[k], at) for at, k in enumerate(order.tolist()))

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words in a row, and how many each has. Words of letters alone go to the
        tokenizer as one text, cut again where ids end words."""
        if all(map(str.isalpha, words)):
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(words):
                return ids, np.diff(np.r_[0, stops])
        parts = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([x for part in parts for x in part], np.uint32), np.array(list(map(len, parts)), np.int64)

    def learn(self) -> None:
        new, lengths, pieces = self.new, np.zeros(len(self.new), np.int64), []
        plain = np.array(list(map(str.isalpha, new)), bool)
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        edge = int(plain.sum())
        for start in [*range(0, edge, 256), *range(edge, len(new), 4096)]:
            some = order[start : min(start + 256, edge) if start < edge else start + 4096]
            ids, lengths[some] = self.fresh([new[k] for k in some])
            pieces.append(ids)
        starts = np.empty(len(new), np.int64)
        starts[order] = len(self.flat) + np.cumsum(lengths[order]) - lengths[order]
        self.starts, self.lengths = np.r_[self.starts, starts], np.r_[self.lengths, lengths]
        self.hits = np.r_[self.hits, np.zeros(len(new), np.int32)]
        self.flat, self.new = np.concatenate([self.flat, *pieces]), []

    def places(self, words: pa.Array) -> np.ndarray:
        """Each word's place; a new word is noted and gets the next one."""
        coded = words.dictionary_encode()
        found = np.fromiter(map(self.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        return found[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, end_id after each, and the number of ids of each text."""
        if not self.by_word:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([x for ids in found for x in [*ids, end_id]], np.uint32), np.array([len(ids) + 1 for ids in found], np.int64)
        if len(self) > CACHED_WORDS:
            self.shrink(CACHED_WORDS // 2)
        lowered = pa.compute.replace_substring(pa.compute.ascii_lower(texts), "\n", " ")
        found = pa.compute.split_pattern(lowered, " ")
        ends = found.offsets.to_numpy()[1:] - found.offsets[0].as_py()
        coded = found.flatten().dictionary_encode()
        distinct = coded.dictionary
        # the tokenizer splits signs from the letters before them, so words are kept without them
        base = pa.compute.utf8_rtrim(distinct, TAIL)
        last = pa.compute.utf8_slice_codeunits(base, -1)
        simple = pa.compute.and_(pa.compute.less(last, BEYOND), pa.compute.not_equal(last, DOTTED))
        split = pa.compute.and_(pa.compute.utf8_is_alpha(last), simple)
        signs = pa.compute.struct_field(pa.compute.extract_regex(distinct, f"(?P<signs>[{TAIL}]*)$"), [0])
        head = self.places(pa.compute.if_else(split, base, distinct))
        tail = self.places(pa.compute.if_else(split, signs, ""))
        self.learn()
        index = coded.indices.to_numpy()
        which = np.stack([head[index], tail[index]], axis=1).ravel()
        self.hits += np.bincount(head[index], minlength=len(self)).astype(np.int32)
        lengths = self.lengths[which]
        sums = np.cumsum(lengths)
        sizes = np.diff(np.r_[0, sums[2 * ends - 1]]) if len(texts) else np.zeros(0, np.int64)
        ids = self.flat[np.repeat(self.starts[which] - (sums - lengths), lengths) + np.arange(lengths.sum())]
        return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def candidates(stops: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending, and what a cut there costs. stops: whether a
    sentence ends with this token."""
    ends = np.cumsum(sizes)
    places = np.flatnonzero(stops) + 1
    soft = np.union1d(places, ends)
    gaps = np.diff(np.r_[0, soft])
    long = np.flatnonzero(gaps > HARD_STEP)
    more = [np.arange(soft[k] - gaps[k] + HARD_STEP, soft[k], HARD_STEP) for k in long]
    every = np.union1d(soft, np.concatenate(more)) if more else soft
    cost = np.full(len(every), HARD_COST, np.int64)
    cost[np.searchsorted(every, places)] = SENTENCE_COST
    cost[np.searchsorted(every, ends)] = 0
    return every, cost


def padding(n: int, capacity: int) -> int:
    """A power of two goes as it is; other windows are filled up."""
    return 0 if n & (n - 1) == 0 else capacity - n


def tail(n: int, capacity: int) -> tuple[int, list[int]]:
    """The cost and sizes of the last n tokens' windows: one, or one for each power of two."""
    powers = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    split = HARD_COST * (len(powers) - 1)
    return (split, powers) if split < padding(n, capacity) else (padding(n, capacity), [n])


def cuts(places: np.ndarray, cost: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Ends of windows over a stream that ends at places[-1], with the least padding plus cost.

    best(j) = cost(j) + capacity - place(j) + the least best(i) + place(i) over places i at most
    capacity before j: the window's minimum stands at the head of a monotone queue. The last
    windows may also split into powers of two, which need no padding.
    """
    if not len(places):
        return []
    total = int(places[-1])
    at, add = [0, *places.tolist()], [0, *cost.tolist()]
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - capacity:
            queue.popleft()
        value, i = queue[0]
        best[j] = value + add[j] + capacity - here
        back[j] = i
        key = best[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    least, last, sizes = None, 0, []
    for i in range(len(at) - 2, -1, -1):
        if total - at[i] > capacity:
            break
        price, parts = tail(total - at[i], capacity)
        if least is None or best[i] + price < least:
            least, last, sizes = best[i] + price, i, parts
    ends = []
    while last:
        ends.append(at[last])
        last = back[last]
    ends.reverse()
    for n in sizes:
        ends.append((ends[-1] if ends else 0) + n)
    return ends


class Packer:
    """Collects a partition's documents in their order and emits the pieces of full shards."""

    def __init__(self, stops: np.ndarray, capacity: int, first_sequence: int):
        self.stops, self.capacity, self.sequence = stops, capacity, first_sequence
        self.clear()

    def clear(self) -> None:
        self.owners: list[pa.Array] = []
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.held = 0

    def add(self, owners: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.owners.append(owners)
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.held += len(ids)

    def pieces(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        owners, ids, sizes = pa.concat_arrays(self.owners), np.concatenate(self.ids), np.concatenate(self.sizes)
        ends = np.array(cuts(*candidates(self.stops[ids], sizes), self.capacity), np.int64)
        doc_ends = np.cumsum(sizes)
        edges = np.union1d(ends, doc_ends)
        starts = np.r_[0, edges[:-1]]
        doc, window = np.searchsorted(doc_ends, edges), np.searchsorted(ends, edges)
        raw, bounds = ids.astype("<u4").tobytes(), np.r_[0, edges * 4]
        binary = pa.Array.from_buffers(pa.large_binary(), len(edges), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
        columns = [
            owners.take(pa.array(doc)),
            pa.array(starts - (doc_ends - sizes)[doc]),
            pa.array(edges - starts),
            pa.array(sizes[doc]),
            pa.array(self.sequence + window),
            pa.array(starts - np.r_[0, ends][window]),
        ]
        self.sequence += len(ends)
        self.clear()
        for k in range(0, len(edges), 2048):
            part = binary.slice(k, 2048)
            yield pa.RecordBatch.from_arrays(
                [*(x.slice(k, 2048) for x in columns), part.cast(pa.binary())],
                names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Packs whole documents into sequences of at most capacity tokens, in the order in which
    each input partition holds them; no shuffle, so it needs memory for one shard only.

    Dynamic programming over each shard chooses windows that end with a document or a sentence
    (elsewhere only in long stretches without one), minimising padding plus the cost of cuts. No
    sequence spans two shards. Returns one row for each piece of a document in a sequence: id_col,
    start (the document's ids before it), length, doc_tokens, sequence_id, offset (in the
    sequence, gapless from 0) and ids (little-endian unsigned 32-bit integers).

    A null or empty text is the end id alone. Null or repeated ids are separate documents. An
    empty table gives no pieces. The input must not depend on an unordered shuffle if reruns of
    lost tasks are to give the same sequences: read it from files.
    """
    # tokenizer: the path of a tokenizer's JSON file that executors reach too
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        stops = np.pad(words.stops, (0, max(0, end_id + 1 - len(words.stops))))
        packer = Packer(stops, capacity, TaskContext.get().partitionId() << 33)
        for batch in slices(batches, ROWS):
            ids, sizes = words.encode(batch.column(1), end_id)
            packer.add(batch.column(0), ids, sizes)
            if packer.held >= shard_tokens:
                yield from packer.pieces()
        yield from packer.pieces()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)
