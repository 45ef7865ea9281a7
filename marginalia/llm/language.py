"""Language-model scores of whole documents: corpus counts, and a gated recurrent model on top."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash, unstash
from .blocks import answers, blocks, from_bytes, receive, send, text_buffer
from .common import map_arrow, remainder, text_or_empty
from .recurrent import CLASS_WORDS, MOST_CLASSES, Gru, n_words_for, score, train
from .shingles import lower_ascii, words
from .suffix import Hashed, chunks

#: The end's fingerprint among those of words.
END = np.uint64(0x5851F42D4C957F2D)
#: Distinct words in a bucket, about.
BUCKET_WORDS = 1 << 18
#: Training documents are dealt into so many rounds, each into one: all of them train the recurrent
#: weights once. Tasks' weights are averaged after each round.
ROUNDS = 3
#: Tasks' weights are averaged in a tree; so many meet in one task.
FAN = 32
#: Words that a bucket proposes for rows of their own.
MOST_WORDS = CLASS_WORDS * MOST_CLASSES


def token_codes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each text's words with A-Z lowered, END after each text; n + 1 bounds."""
    parts, counts = [], []
    for first, last in chunks(bounds):
        base = bounds[first]
        part, edges = lower_ascii(raw[base : bounds[last]]), bounds[first : last + 1] - base
        starts, stops, doc = words(part, edges)
        n = np.bincount(doc, minlength=last - first)
        codes = Hashed(part).of(starts, stops) if len(starts) else np.zeros(0, np.uint64)
        parts.append(np.insert(codes, np.cumsum(n), END))
        counts.append(n + 1)
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return codes, np.r_[0, np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64))]


def short_ids(codes: np.ndarray, top: np.ndarray, n_words: int) -> np.ndarray:
    """Places among the top words, n_words for the rest."""
    if not len(top):
        return np.full(len(codes), n_words, np.int64)
    order = np.argsort(top)
    at = np.minimum(np.searchsorted(top[order], codes), len(top) - 1)
    return np.where(top[order][at] == codes, order[at], n_words)


def counted(table: pa.Table) -> pa.Table:
    """A bucket of words: rows reply (a block's counts), total (distinct words and tokens) and top
    (the most frequent words)."""
    bucket = table.column("bucket")[0].as_py()
    froms, source, (count, key) = receive(table, "<u8")
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(count[order], starts)
    each = np.empty(len(order), np.int64)
    each[order] = sums[np.cumsum(new) - 1]
    edges = np.searchsorted(source, np.arange(len(froms) + 1))
    bodies = [each[a:b].astype("<u4" if sums.max() < 1 << 32 else "<i8") for a, b in zip(edges, edges[1:])]
    keys = key[order][starts]
    best = np.lexsort((keys, -sums))[:MOST_WORDS]
    best = best[sums[best] > 0]
    n = len(froms)
    kinds = ["reply"] * n + ["total"] + ["top"] * len(best)
    packed = [len(x).to_bytes(8, "little") + bytes([x.itemsize]) + pa.compress(x.tobytes(), "zstd", asbytes=True) for x in bodies]
    return pa.table(
        {
            "kind": kinds,
            "block": pa.array([*froms, *[-1] * (1 + len(best))], pa.int64()),
            "bucket": pa.array([bucket] * len(kinds), pa.int64()),
            "body": pa.array([*packed, *[None] * (1 + len(best))], pa.binary()),
            "key": pa.array([*[0] * n, int((sums > 0).sum()), *keys[best].view(np.int64).tolist()], pa.int64()),
            "count": pa.array([*[0] * n, int(sums.sum()), *sums[best].tolist()], pa.int64()),
        }
    )


def replied(reply: list[dict] | None, n: int) -> np.ndarray:
    """A block's counts in the order of its distinct words: buckets ascend with the words."""
    parts = []
    for x in sorted(reply or [], key=lambda x: x["bucket"]):
        size, wide = int.from_bytes(x["body"][:8], "little"), x["body"][8]
        parts.append(np.frombuffer(pa.decompress(x["body"][9:], size * wide, "zstd", asbytes=True), f"<u{wide}").astype(np.int64))
    out = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(out) != n:
        raise ValueError("a block's words and answers differ")
    return out


def averaged(trained: DataFrame, tasks: int) -> DataFrame:
    """One row of (task, n, body): the weights of all tasks, weighed by their tokens. They meet FAN at a
    time, level by level, so no task holds more than FAN of them."""

    def mean(table: pa.Table) -> pa.Table:
        ns = table.column("n").to_pylist()
        total = np.zeros(len(table.column("body")[0].as_py()) // 4)
        for n, body in zip(ns, table.column("body")):
            total += np.frombuffer(body.as_py(), np.float32) * (n / sum(ns))
        return pa.table({"task": [table.column("task")[0].as_py()], "n": [sum(ns)], "body": [total.astype(np.float32).tobytes()]})

    while tasks > 1:
        up = trained.select(F.floor(F.col("task") / FAN).alias("task"), "n", "body")
        trained, tasks = up.groupBy("task").applyInArrow(mean, "task long, n long, body binary"), -(-tasks // FAN)
    return trained


def weights(model: Gru, lessons: DataFrame, rounds: int) -> Gru:
    """Each round every task trains a copy on its documents of that round; the average, by tokens, starts
    the next. The average depends on how the lessons lie in files, which are written once."""
    for k in range(rounds):
        now = model

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = (np.frombuffer(x.as_py(), "<u2") for batch in batches for x in batch.column(0))
            found, n = train(now, texts)
            if n:
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_pydict({"task": [task], "n": [n], "body": [found.flat().tobytes()]})

        some = lessons.where(F.col("round") == k).select("tokens")
        trained = map_arrow(some, learn, "task long, n long, body binary")
        found = averaged(trained, some.rdd.getNumPartitions()).collect()
        if not found:
            continue
        model = model.filled(np.frombuffer(found[0]["body"], np.float32))
    return model


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Tokens are words between white space with A-Z lowered, and one end. Rows whose crc32 of the id as
    text leaves another remainder than held_out are trained on. base_score: add-one unigram log10
    probability from the counts of all training tokens. score: log10 probability by a gated
    recurrent network over the whole text, its state zero where a text starts and carried to its end.
    It gives each of the frequent words (more in a larger corpus, within a bound) in classes by
    frequency; one more class holds all other words, which it gives by add-one shares within it.
    Every training document trains the network in one of the rounds.

    A null or empty text is the end alone. A null id counts as the empty text. Rows come back as often as
    they came. An empty table gives an empty result; without training tokens all words are unseen.

    Words are counted by packed exchanges: each distinct word goes once from each block of documents
    to its bucket and its count comes back, so frequent words are not gathered and no vocabulary is
    broadcast. The network is of bounded size. Its weights are averages over tasks, so score depends a
    little on how the table lies in files; the other columns do not.
    """
    spark = docs.sparkSession
    held = remainder(modulus, id_col) == held_out
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), text_or_empty(text_col).alias("text"))
    packed = blocks(rows, "text", "words-blocks")
    total = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_buckets = np.uint64(max(1, total // 24 // BUCKET_WORDS))

    def tokens_of(body: bytes) -> tuple:
        table = from_bytes(body)
        codes, bounds = token_codes(*text_buffer(table.column("text")))
        key, which = np.unique(codes, return_inverse=True)
        learned = ~np.repeat(table.column("held").to_numpy(), np.diff(bounds))
        return table, codes, bounds, key, which, learned

    def bucket_of(key: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(32)) * n_buckets >> np.uint64(32)).astype(np.int64)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, _, _, key, which, learned = tokens_of(body.as_py())
                count = np.bincount(which, learned, len(key)).astype(np.int64)
                yield pa.RecordBatch.from_pylist(list(send(number, bucket_of(key), count, key)), SENT)

    SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])
    sent = map_arrow(packed.select("block", "docs"), requests, "bucket long, block long, body binary")
    schema = "kind string, block long, bucket long, body binary, key long, count long"
    found = stash(sent.groupBy("bucket").applyInArrow(counted, schema), "words-counts")
    distinct, tokens = found.where("kind = 'total'").agg(F.coalesce(F.sum("key"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    best = found.where("kind = 'top'").orderBy(F.desc("count"), "key").limit(MOST_WORDS).select("key", "count").collect()
    shares = np.array([row["count"] for row in best], np.float64)
    n_words = n_words_for(shares)
    top, shares = np.array([row["key"] for row in best[:n_words]], np.int64).view(np.uint64), shares[:n_words]
    rest_tokens, rest_words = tokens - int(shares.sum()), distinct - len(top)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bounds = token_codes(*text_buffer(batch.column(1)))
            ids = short_ids(codes, top, n_words).astype("<u2")
            texts = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["round", "tokens"])

    chosen = rows.where(~F.col("held")).select(F.pmod(F.xxhash64("id"), F.lit(rounds)).alias("round"), "text")
    lessons = stash(map_arrow(chosen, coded, "round long, tokens binary"), "words-lessons")
    model = weights(Gru.start(shares, rest_tokens, n_words), lessons, rounds)
    unlearned = np.log10(tokens + distinct + 1)
    within_rest = np.log10(max(rest_tokens, 0) + max(rest_words, 0) + 1)
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, reply in zip(batch.column(0), batch.column(1)):
                table, codes, bounds, key, which, _ = tokens_of(body.as_py())
                count = replied(reply.as_py(), len(key))
                word_logs = np.log10(count + 1.0)
                short = short_ids(key, top, n_words)
                # the rest: its share within its class, on top of the class
                inner = np.where(short == n_words, word_logs - within_rest, 0.0)
                starts = bounds[:-1]
                sums = lambda x: np.add.reduceat(x[which], starts) if len(starts) else np.zeros(0)
                ids = short[which]
                texts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        table.column("id").combine_chunks(),
                        table.column("held").combine_chunks(),
                        pa.array(n),
                        pa.array(sums((count > 0).astype(np.int64))),
                        pa.array(np.full(len(n), tokens, np.int64)),
                        pa.array(sums(word_logs) - n * unlearned),
                        pa.array(score(model, texts) / np.log(10) + sums(inner)),
                    ],
                    names=names,
                )

    replies = answers(found.where("kind = 'reply'").select("block", "bucket", "body"))
    joined = packed.join(replies, "block", "left").select("docs", "answers")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    unstash(lessons)
    return map_arrow(joined, rate, schema).withColumnRenamed("id", id_col)
