"""Removal of long byte strings that an earlier document holds too, by sparse suffix sorting.

Suffixes are taken at anchors only: of the grams inside each window of LENGTH bytes, the one with
the least hash. Equal windows choose the same anchor at the same offset, so they are found among
suffixes that begin with the same gram. A first exchange of gram hashes drops the suffixes whose
leading gram stands in one document only. The others are records of real bytes: the suffix up to
the end of the last window that chose its anchor, and the bytes before it down to the start of the
first. Sampled splitters range-partition the records by their leading bytes; each bucket sorts its
own by multikey quicksort over words of eight bytes and compares neighbours: records that are equal
as a whole, and, among those with the same leading gram, each window. A splitter never cuts between
equal leading grams, so nothing is left to compare across boundaries.

A gram with very many surroundings would fill one bucket. Its windows become suffixes of their own.
All occurrences of a window share its anchor, so these meet only each other, and only where they
are equal in all their bytes: they are dealt by a hash of the whole window, so that windows that begin
alike do not meet in one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, tidy
from ..session import stash, unstash
from .blocks import answers, blocks, from_bytes, ids_of, multikey_sort, text_buffer

LENGTH = 50
GRAM = 18
#: Bytes of text that are hashed at once; longer documents go in overlapping segments.
CHUNK_BYTES = 1 << 18
#: Bytes of text in a block: smaller than elsewhere, as a block's suffixes take many times its bytes, and
#: its compressed row should stay well below a megabyte in the executor's heap.
BLOCK_BYTES = 1 << 20
#: Grams, and records, in a bucket, about.
BUCKET_GRAMS, BUCKET_ENTRIES = 1 << 20, 1 << 17
#: Ranges of leading bytes, at most, and sampled keys in all, about: they bound what the driver and
#: each task hold of splitters. Larger inputs split each range by the hash of the leading gram.
MOST_RANGES, MOST_SAMPLED = 4096, 1 << 17
#: A gram with more surroundings than this, as blocks count them, is split by its windows.
MOST_AROUND = 1 << 14
#: Bytes of gram hashes in a partition, about.
PARTITION_BYTES = 1 << 23
#: Records whose prefix sums are computed at once.
SUMMED_ROWS = 1 << 13
#: Low bits of a sort key that hold a place in a segment.
PLACE_BITS = 28
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, x)], dtype=np.uint64) for x in (BASE, INVERSE))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Hashed:
    """Fingerprints of any stretch of a buffer, by polynomial prefix sums modulo 2 ** 64."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        size = max(CHUNK_BYTES * 2, 1 << n.bit_length())
        self.up, self.down = powers(size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def grams(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def of(self, starts: np.ndarray, stops: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.down[starts])


def chunks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about CHUNK_BYTES together."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def segments(bounds: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first document, last, start, stop, first window, last window) of what is hashed at once: runs of
    documents, or a part of a long one with all that its windows' surroundings reach. Windows count from
    start; the last one is left out."""
    side = length - gram
    for first, last in chunks(bounds):
        low, high = int(bounds[first]), int(bounds[last])
        if high - low <= 2 * CHUNK_BYTES:
            yield first, last, low, high, 0, high - low
            continue
        for at in range(low, high, CHUNK_BYTES):
            start = max(low, at - side)
            yield first, last, start, min(high, at + CHUNK_BYTES + 2 * length), at - start, at - start + CHUNK_BYTES


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int, windows: tuple[int, int] | None = None) -> tuple[np.ndarray, ...]:
    """Of each anchor of the windows from windows[0] to windows[1] (all by default): its gram's hash,
    mixed once more, as the hashes of anchors are small ones and would fill the first of any equal ranges;
    its surroundings' hash, its document (a place in bounds), its place in raw, and the first and last
    window that chose it."""
    n, wide = len(raw), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, np.uint64 if k < 2 else np.int64) for k in range(6))
    hashed = Hashed(raw)
    codes = hashed.grams(gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (codes & ~low) | (low - np.arange(len(codes), dtype=np.uint64))
    width = 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    chosen = (low - (least & low)).astype(np.int64)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(chosen)]
    at = np.arange(len(chosen))
    valid = at + length <= bounds[1:][owner]
    if windows is not None:
        valid &= (at >= windows[0]) & (at < windows[1])
    new = chosen[1:] != chosen[:-1]
    first = valid & np.r_[True, ~valid[:-1] | new]
    last = valid & np.r_[~valid[1:] | new, True]
    lows, highs = np.flatnonzero(first), np.flatnonzero(last)
    place, doc = chosen[lows], owner[lows]
    left = np.maximum(bounds[:-1][doc], place - (wide - 1))
    right = np.minimum(bounds[1:][doc], place + length)
    cut = ((place - left) * 64 + (right - place)).astype(np.uint64)
    # a run that a segment cuts is told apart from the whole one
    run = ((place - lows) * 64 + (place - highs)).astype(np.uint64)
    around = mix(hashed.of(left, right) ^ mix(cut * np.uint64(4096) + run))
    return mix(codes[place]), around, doc, place, lows, highs


class Block:
    """A block's documents, their anchors in the order of gram and surroundings, and the distinct grams."""

    def __init__(self, body: bytes, id_col: str, text_col: str, length: int, gram: int):
        self.table = from_bytes(body)
        self.raw, self.bounds = text_buffer(self.table.column(text_col))
        self.ids = ids_of(self.table, id_col)
        self.length, self.gram = length, gram
        parts = [anchors(self.raw[:0], self.bounds[:1], length, gram)]
        for first, last, start, stop, low, high in segments(self.bounds, length, gram):
            own = np.clip(self.bounds[first : last + 1], start, stop) - start
            found = anchors(self.raw[start:stop], own, length, gram, (low, high))
            parts.append((*found[:2], found[2] + first, *(x + start for x in found[3:])))
        code, around, *rest = map(np.concatenate, zip(*parts))
        order = multikey_sort(code, around)
        self.code, self.around = code[order], around[order]
        self.doc, self.place, self.low, self.high = (x[order] for x in rest)
        self.id = self.ids[self.doc]

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct grams, ascending; 128 for those that two documents have, plus their surroundings up
        to 127; and each anchor's gram."""
        if not len(self.code):
            return self.code, np.zeros(0, np.uint8), self.doc
        new = np.r_[True, self.code[1:] != self.code[:-1]]
        starts, which = np.flatnonzero(new), np.cumsum(new) - 1
        kinds = np.add.reduceat((new | np.r_[True, self.around[1:] != self.around[:-1]]).astype(np.int64), starts)
        several = np.minimum.reduceat(self.id, starts) != np.maximum.reduceat(self.id, starts)
        return self.code[starts], (np.minimum(kinds, 127) + 128 * several).astype(np.uint8), which


def n_words(length: int, gram: int) -> int:
    return -(-(2 * length - gram + 5) // 8)


def records(
    raw: np.ndarray, bounds: np.ndarray, doc: np.ndarray, place: np.ndarray, early: np.ndarray, late: np.ndarray, split: np.ndarray, length: int, gram: int
) -> np.ndarray:
    """A row of big-endian words for each suffix: its bytes from place as far as the windows reach, then
    those before it, then how many of each there are, the first and last window (bytes before place),
    and whether it is a window of its own. What lies outside of the document, or of all windows, is
    zero."""
    side = length - gram
    out = np.zeros((len(place), 8 * n_words(length, gram)), np.uint8)
    padded = np.r_[np.zeros(side, np.uint8), raw, np.zeros(length, np.uint8)]
    seen = np.lib.stride_tricks.sliding_window_view(padded, side + length)[place]
    before = np.minimum(early, place - bounds[:-1][doc])
    after = np.minimum(length - late, bounds[1:][doc] - place)
    out[:, :length], out[:, length : length + side] = seen[:, side:], seen[:, :side]
    for k in np.flatnonzero(after < length) if (after < length).mean() < 0.02 else []:
        out[k, after[k] : length] = 0
    if (after < length).mean() >= 0.02:
        out[:, :length] *= np.arange(length) < after[:, None]
    out[:, length : length + side] *= np.arange(side) >= side - before[:, None]
    for k, column in enumerate((before, after, early, late, split)):
        out[:, length + side + k] = column
    return out


def window_prints(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the windows of length bytes at starts, a slice of them at once."""
    out = np.zeros(len(starts), np.uint64)
    up, _ = powers(CHUNK_BYTES * 2)
    for at in range(0, len(starts), SUMMED_ROWS):
        seen = np.lib.stride_tricks.sliding_window_view(raw, length)[starts[at : at + SUMMED_ROWS]].astype(np.uint64)
        out[at : at + SUMMED_ROWS] = ((seen + np.uint64(1)) * up[:length]).sum(axis=1)
    return mix(out)


def words_of(rows: np.ndarray) -> list[np.ndarray]:
    return list(np.ascontiguousarray(rows).view(">u8").astype(np.uint64).T)


def leading(rows: np.ndarray) -> np.ndarray:
    """The first 16 bytes as sortable strings."""
    return np.ascontiguousarray(rows[:, :16]).view("S16").ravel()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of a fixed kind, each compressed."""
    out = []
    for x in arrays:
        raw = np.ascontiguousarray(x).tobytes()
        body = pa.compress(raw, "zstd", asbytes=True) if raw else b""
        out.append(np.array([len(raw), len(body)], "<i8").tobytes() + body)
    return b"".join(out)


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size, packed = np.frombuffer(body, "<i8", 2, at).tolist()
        at += 16
        raw = pa.decompress(body[at : at + packed], size, "zstd", asbytes=True) if size else b""
        out.append(np.frombuffer(raw, kind))
        at += packed
    return out


SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])


def sent(block: int, owner: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket in owner, which ascends: the arrays' parts that it owns."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    stops = np.r_[starts[1:], len(owner)]
    bodies = [pack(*(x[a:b] for x in arrays)) for a, b in zip(starts, stops)]
    return pa.RecordBatch.from_arrays([pa.array(owner[starts], pa.int64()), pa.array([block] * len(starts), pa.int64()), pa.array(bodies, pa.binary())], schema=SENT)


def replied(table: pa.Table, bodies: list[bytes | None]) -> pa.Table:
    """A bucket's answers to its blocks, in the order of table; None is no answer."""
    some = [k for k, x in enumerate(bodies) if x is not None]
    blocks_ = table.column("block").to_pylist()
    columns = [[table.column("bucket")[0].as_py()] * len(some), [blocks_[k] for k in some], [bodies[k] for k in some]]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, SENT)], schema=SENT)


def tidied(f, table: pa.Table, *how) -> pa.Table:
    """f of a bucket; what it took is given back before the next bucket."""
    out = f(table, *how)
    tidy()
    return out


def shared_grams(table: pa.Table, most_around: int) -> pa.Table:
    """A bucket of gram hashes: answers each block with a byte for each gram that it sent: 1 where another
    document has the gram, 2 where it also has too many surroundings for one bucket."""
    parts = [unpack(x.as_py(), "<u4", "u1") for x in table.column("body")]
    sizes = [len(x[0]) for x in parts]
    key, kinds = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    counts = np.diff(np.r_[starts, len(key)])
    several = (counts > 1) | np.logical_or.reduceat(kinds[order] > 127, starts)
    hot = np.add.reduceat((kinds[order] & 127).astype(np.int64), starts) > most_around
    answer = np.empty(len(key), np.uint8)
    answer[order] = np.repeat(several * (1 + hot.astype(np.uint8)), counts)
    edges = np.r_[0, np.cumsum(sizes)]
    own = [answer[a:b] for a, b in zip(edges, edges[1:])]
    return replied(table, [pack(x) if x.any() else None for x in own])


def window_masks(rows: np.ndarray, group: np.ndarray, ids: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For distinct records in groups of one leading gram: the windows (as bits, by the bytes before
    place) that a record of the same group with a smaller id holds too."""
    side = length - gram
    early, late = rows[:, length + side + 2].astype(np.int64), rows[:, length + side + 3].astype(np.int64)
    # in the order of the text, as prefix sums of a polynomial
    up, _ = powers(CHUNK_BYTES * 2)
    sums = np.zeros((len(rows), side + length + 1), np.uint64)
    for at in range(0, len(rows), SUMMED_ROWS):
        part = rows[at : at + SUMMED_ROWS]
        flat = np.concatenate([part[:, length : length + side], part[:, :length]], axis=1).astype(np.uint64)
        np.cumsum((flat + np.uint64(1)) * up[: side + length], axis=1, out=sums[at : at + SUMMED_ROWS, 1:])
    masks = np.zeros(len(rows), np.uint64)
    own = mix(group.astype(np.uint64))
    for back in range(side + 1):
        some = np.flatnonzero((late <= back) & (back <= early))
        if len(some) < 2:
            continue
        start = side - back
        print_ = mix((sums[some, start + length] - sums[some, start]) ^ own[some])
        order = np.argsort(print_, kind="stable")
        starts = np.flatnonzero(np.r_[True, print_[order][1:] != print_[order][:-1]])
        sizes = np.diff(np.r_[starts, len(some)])
        least = np.repeat(np.minimum.reduceat(ids[some][order], starts), sizes)
        late_ones = some[order[ids[some][order] > least]]
        masks[late_ones] |= np.uint64(1 << back)
    return masks


def earlier(table: pa.Table, length: int, gram: int) -> pa.Table:
    """A bucket of records: answers each block with the windows of its entries that an earlier document
    has too, as places of entries and bits."""
    wide = 8 * n_words(length, gram)
    parts = [unpack(x.as_py(), "u1", "<i8") for x in table.column("body")]
    ids = np.concatenate([x[1] for x in parts])
    edges = np.r_[0, np.cumsum([len(x[1]) for x in parts])]
    rows = np.concatenate([x[0] for x in parts]).reshape(-1, wide)
    del parts
    words = words_of(rows)
    order = multikey_sort(*words)
    new = np.zeros(len(rows), bool)
    new[0] = True
    for word in words:
        own = word[order]
        new[1:] |= own[1:] != own[:-1]
    del words
    firsts, kind = np.flatnonzero(new), np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], firsts)
    # of records that are equal as a whole, all but the earliest document's go whole
    late = rows[order[firsts]][:, 2 * length - gram + 2 : 2 * length - gram + 4].astype(np.uint64)
    whole = ((np.uint64(2) << late[:, 0]) - np.uint64(1)) & ~((np.uint64(1) << late[:, 1]) - np.uint64(1))
    # neighbours with the same leading gram are compared window by window
    head = rows[order[firsts]][:, :gram]
    fresh = np.r_[True, (head[1:] != head[:-1]).any(axis=1)]
    group = np.cumsum(fresh) - 1
    several = np.flatnonzero((np.bincount(group)[group] > 1) & (rows[order[firsts], 2 * length - gram + 4] == 0))
    masks = np.zeros(len(firsts), np.uint64)
    # whole groups at a time, as prefix sums take many times a record's bytes
    heads = np.flatnonzero(np.r_[True, np.diff(group[several]) > 0]) if len(several) else several
    start = 0
    while start < len(several):
        next_head = int(np.searchsorted(heads, start + SUMMED_ROWS))
        stop = int(heads[next_head]) if next_head < len(heads) else len(several)
        some = several[start:stop]
        masks[some] = window_masks(rows[order[firsts[some]]], group[some], least[some], length, gram)
        start = stop
    answer = np.empty(len(rows), np.uint64)
    answer[order] = np.where(ids[order] > least[kind], whole[kind], masks[kind])
    bodies = []
    for a, b in zip(edges, edges[1:]):
        at = np.flatnonzero(answer[a:b])
        bodies.append(pack(at.astype("<u4"), answer[a:b][at]) if len(at) else None)
    return replied(table, bodies)


def hashed_bytes(rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(257) + rows[:, k])
    return out


def buckets_of(rows: np.ndarray, splitters: np.ndarray, n_ranges: int, n_parts: int, n_buckets: int, length: int, gram: int) -> np.ndarray:
    """The bucket of each of some sorted records: its range of leading bytes, which the hash of its leading
    gram splits further. Windows of their own have n_buckets more, dealt by all their bytes."""
    place = np.searchsorted(leading(rows), splitters, "left")
    owner = np.searchsorted(place, np.arange(len(rows)), "right").astype(np.int64)
    if n_parts > 1:
        owner = owner * n_parts + (hashed_bytes(rows, gram) % np.uint64(n_parts)).astype(np.int64)
    alone = np.flatnonzero(rows[:, 2 * length - gram + 4])
    owner[alone] = n_ranges * n_parts + (hashed_bytes(rows[alone], length) % np.uint64(n_buckets)).astype(np.int64)
    return owner


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    cut_text: bool = False,
    most_around: int = MOST_AROUND,
) -> DataFrame:
    """docs with n_bytes, spans (array of start and stop, in bytes) and kept (the other bytes).

    A byte goes if a string of length bytes that covers it also starts in a document with a smaller
    id; matches are judged on the input, overlaps count and none crosses documents. Texts are UTF-8;
    a null text is empty and comes back null, with no spans. Ids are integers; rows with equal ids
    are never earlier than each other, and a null id is later than every other. Texts are read whole,
    long ones hashed in segments. Columns of docs named n_bytes, spans or kept are replaced. With
    cut_text the result is docs with the bytes taken out of text_col instead; where a cut leaves a part
    of a character, that part goes too, and an emptied text is empty. An empty table gives an
    empty result.

    Texts move twice in compressed blocks. Hashes of grams, and records of the suffixes that may repeat,
    move as packed arrays: each distinct one once for each block, so that a string in many documents is
    never gathered in one place. Records are compared by their bytes; only the windows of records that
    differ are compared by 64-bit fingerprints, and only within one leading gram, so that a false match
    has the chance of one in 2 ** 64 for each pair of such windows.
    """
    if not 0 < length - gram < 64:
        raise ValueError("between 1 and 63 bytes of a window may lie outside of the gram")
    if not cut_text:
        docs = docs.drop("n_bytes", "spans", "kept")
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    names = docs.columns
    packed = blocks(docs, text_col, "suffix-blocks", BLOCK_BYTES)
    total, n_blocks = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    n_gram_buckets = np.uint64(max(1, total * 2 // (length - gram + 2) // BUCKET_GRAMS))

    def gram_bucket(code: np.ndarray) -> np.ndarray:
        return ((code >> np.uint64(32)) * n_gram_buckets >> np.uint64(32)).astype(np.int64)

    def gram_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                code, kinds, _ = Block(body.as_py(), id_col, text_col, length, gram).grams()
                yield sent(number, gram_bucket(code), code.astype(np.uint32), kinds)

    SHARED = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("held", pa.binary()), ("n", pa.int64()), ("sample", pa.list_(pa.binary()))])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with the suffixes whose gram another document has: of each its place, windows, document
        and record, and of each distinct record the first suffix, in sorted order."""
        each = -(-MOST_SAMPLED // max(1, n_blocks))
        for batch in batches:
            for number, body, reply in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                block = Block(body.as_py(), id_col, text_col, length, gram)
                code, _, which = block.grams()
                owner, flag = gram_bucket(code), np.zeros(len(code), np.uint8)
                for x in reply.as_py() or []:
                    (own,) = unpack(x["body"], "u1")
                    base = np.searchsorted(owner, x["bucket"])
                    flag[base : base + len(own)] = own
                flag = flag[which]
                one, many = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
                # the windows of a gram with too many surroundings are suffixes of their own
                sizes = block.high[many] - block.low[many] + 1
                start = np.repeat(block.low[many] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                place, doc = np.r_[block.place[one], start], np.r_[block.doc[one], np.repeat(block.doc[many], sizes)]
                early = np.r_[block.place[one] - block.low[one], np.zeros(len(start), np.int64)]
                late = np.r_[block.place[one] - block.high[one], np.zeros(len(start), np.int64)]
                split = np.r_[np.zeros(len(one), np.uint8), np.ones(len(start), np.uint8)]
                # first the suffixes that are alike by hash, then the records by their bytes
                label = np.r_[block.around[one], window_prints(block.raw, start, length)]
                _, first, alike = np.unique(label, return_index=True, return_inverse=True)
                rows = records(block.raw, block.bounds, doc[first], place[first], early[first], late[first], split[first], length, gram)
                order = multikey_sort(*words_of(rows))
                entry = np.empty(len(order), np.int64)
                entry[order] = np.arange(len(order))
                keys = leading(rows[order][rows[order, 2 * length - gram + 4] == 0])
                step = max(1, len(keys) // each)
                sample = [x.ljust(16, b"\0") for x in keys[number % step :: step][:each].tolist()] if each > 1 or number % max(1, n_blocks // MOST_SAMPLED) == 0 else []
                held = pack(place.astype("<i4"), early.astype("u1"), late.astype("u1"), doc.astype("<i4"), entry[alike].astype("<i4"), first[order].astype("<i4"), split)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, body.as_py(), held, len(order), sample), SHARED)], schema=SHARED)

    def opened(body: bytes, held: bytes) -> tuple:
        """table, raw, bounds, ids, and of each suffix place, early, late, split, doc, entry; the first of
        each entry; and the least id of each entry."""
        table = from_bytes(body)
        raw, bounds = text_buffer(table.column(text_col))
        place, early, late, doc, entry, first, split = (x.astype(np.int64) for x in unpack(held, "<i4", "u1", "u1", "<i4", "<i4", "<i4", "u1"))
        ids = ids_of(table, id_col)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, entry, ids[doc])
        return table, raw, bounds, ids, place, early, late, split, doc, entry, first, least

    def cover(n: int, low: np.ndarray, stop: np.ndarray) -> np.ndarray:
        steps = np.bincount(low, minlength=n + 1)
        steps -= np.bincount(stop, minlength=n + 1)
        return np.cumsum(steps[:-1], out=steps[:-1]) > 0

    def results(table: pa.Table, raw: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> dict[str, pa.Array]:
        step = np.diff(np.r_[np.int8(0), gone.view(np.int8), np.int8(0)])
        # a document's start and end also end a span
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(gone))]
        joined = inner[gone[inner] & gone[inner - 1]] if len(inner) else inner
        starts = np.sort(np.r_[np.flatnonzero(step == 1), np.unique(joined)])
        stops = np.sort(np.r_[np.flatnonzero(step == -1), np.unique(joined)])
        owner = np.searchsorted(bounds[1:], starts, "right")
        counts = np.bincount(owner, minlength=len(bounds) - 1)
        pairs = pa.StructArray.from_arrays([pa.array(starts - bounds[owner]), pa.array(stops - bounds[owner])], ["start", "stop"])
        spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pairs)
        left = np.r_[0, np.cumsum(~gone)]
        kept = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(left[bounds].astype(np.int64)), pa.py_buffer(raw[~gone].tobytes())])
        return {"n_bytes": pa.array(np.diff(bounds)), "spans": spans, "kept": kept.cast(pa.binary())}

    def finished(table: pa.Table, raw: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> pa.Table:
        more = results(table, raw, bounds, gone)
        if cut_text:
            at, old = names.index(text_col), table.column(text_col).to_pylist()
            cut = [None if x is None else y.decode("utf-8", "ignore") for x, y in zip(old, more["kept"].to_pylist())]
            return table.set_column(at, text_col, pa.array(cut, pa.string()))
        for name, column in more.items():
            table = table.append_column(name, column)
        return table

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, held, reply in zip(*(batch.column(k) for k in range(3))):
                table, raw, bounds, ids, place, early, late, split, doc, entry, first, least = opened(body.as_py(), held.as_py())
                masks = np.zeros(len(first), np.uint64)
                if reply.is_valid:
                    rows = records(raw, bounds, doc[first], place[first], early[first], late[first], split[first], length, gram)
                    owner, order = bucket_of(rows)
                    for x in reply.as_py():
                        at, bits = unpack(x["body"], "<u4", "<u8")
                        masks[order[np.searchsorted(owner[order], x["bucket"]) + at]] = bits
                # another document of this block with the same record may be earlier
                whole = ids[doc] > least[entry]
                low, stop = [place[whole] - early[whole]], [place[whole] - late[whole] + length]
                rest = np.flatnonzero(~whole & (masks[entry] > 0))
                own = masks[entry[rest]]
                for back in range(length - gram + 1):
                    hit = place[rest[(own >> np.uint64(back)) & np.uint64(1) > 0]] - back
                    low.append(hit)
                    stop.append(hit + length)
                gone = cover(len(raw), np.concatenate(low), np.concatenate(stop))
                yield from finished(table, raw, bounds, gone).to_batches(max_chunksize=512)

    sent_schema = "bucket long, block long, body binary"
    # partitions by what is sent, whatever the session's number
    n_sent = max(1, -(-total * 10 // ((length - gram + 2) * PARTITION_BYTES)))
    first = map_arrow(packed.select("block", "docs"), gram_hashes, sent_schema).repartition(n_sent, "bucket")
    replies = answers(first.groupBy("bucket").applyInArrow(lambda table: tidied(shared_grams, table, most_around), sent_schema))
    with_replies = packed.join(replies, "block", "left").select("block", "docs", "answers")
    marked = stash(map_arrow(with_replies, shared, "block long, docs binary, held binary, n long, sample array<binary>"), "suffix-shared")
    unstash(packed)

    n_entries = marked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = max(1, -(-n_entries // BUCKET_ENTRIES))
    n_ranges = min(MOST_RANGES, n_buckets)
    n_parts = np.uint64(-(-n_buckets // n_ranges))
    keys = np.sort(np.array([bytes(r[0]) for r in marked.select(F.explode("sample")).collect()], "S16")) if n_ranges > 1 else np.zeros(0, "S16")
    splitters = np.unique(keys[(np.arange(1, n_ranges) * len(keys)) // n_ranges]) if len(keys) else keys

    def bucket_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = buckets_of(rows, splitters, n_ranges, int(n_parts), n_buckets, length, gram)
        return owner, np.argsort(owner, kind="stable")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                _, raw, bounds, _, place, early, late, split, doc, _, first, least = opened(body.as_py(), held.as_py())
                rows = records(raw, bounds, doc[first], place[first], early[first], late[first], split[first], length, gram)
                owner, order = bucket_of(rows)
                yield sent(number, owner[order], rows[order], least[order])

    second = map_arrow(marked.select("block", "docs", "held"), suffixes, sent_schema).repartition(n_buckets, "bucket")
    replies = answers(second.groupBy("bucket").applyInArrow(lambda table: tidied(earlier, table, length, gram), sent_schema))
    waiting = marked.select("block", "docs", "held").join(replies, "block", "left").select("docs", "held", "answers")
    more = T._parse_datatype_string("n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    schema = T.StructType([*docs.schema.fields, *([] if cut_text else more.fields)])
    return map_arrow(waiting, decide, schema)
