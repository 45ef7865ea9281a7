"""Every operator and stage over awkward and empty tables, held against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from conftest_texts import BRUTE_WINDOW, crc, words_of
from pyspark.sql import functions as F
from test_brute import after_exact, after_near, after_suffix, normal

from marginalia.llm import exact, language, media, near, packing, quality, recurrent, suffix, tokens, toxicity


def rows_of(df):
    return [row.asDict() for row in df.collect()]


def texts(df):
    return [(row["doc_id"], row["text"]) for row in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def labels(spark, awkward):
    marks = [(1, 1, 0), (5, 1, 0), (6, 0, 1), (8, 0, 1), (9, 1, None), (12, None, 0), (None, 1, 1), (1, 0, 1)]
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_packing(awkward, nothing):
    pieces = rows_of(packing.pack_documents(awkward, capacity=256))
    coder = packing.WordEncoder(packing.public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = Counter((k, tuple(coder.encode(t or "", add_special_tokens=False).ids) + (2,)) for k, t in texts(awkward))
    sequences, found = defaultdict(list), Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == sum(x["length"] for x in sequences[p["sequence_id"]])
        sequences[p["sequence_id"]].append(p)
    # within an input partition pieces of a document follow each other
    held = []
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and p["start"] == len(held)
        held += ids
        if len(held) == p["doc_tokens"]:
            found[p["doc_id"], tuple(held)] += 1
            held = []
    assert found == want and not held
    assert all(sum(x["length"] for x in s) <= 256 for s in sequences.values())
    assert packing.pack_documents(nothing).count() == 0


def test_tokens(awkward, nothing):
    coder = tokens.encoding(tokens.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokens.public_tokenizers.PATTERN)
    got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"]), r["n_tokens"]) for r in rows_of(tokens.bpe_round_trip(awkward, segment_chars=1000)))
    want = Counter()
    for k, t in texts(awkward):
        ids = np.array(coder.encode_ordinary(t or ""), "<u4")
        want[k, ids.tobytes(), (t or "").encode(), len(ids)] += 1
    assert got == want
    assert tokens.bpe_round_trip(nothing).count() == 0


def test_media(awkward, nothing):
    got = rows_of(media.media_columns(awkward))
    for r in got:
        payload = bytes(r["payload"])
        assert media.read_png(bytes(r["media"])).tobytes() == payload and len(r["hash"]) == 8
    want = Counter((k, len((t or "").encode()), (t or "").encode().ljust(max(1, -(-len((t or "").encode()) // 192)) * 192)) for k, t in texts(awkward))
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["payload"])) for r in got) == want
    assert media.media_columns(nothing).count() == 0


def brute_exact(pairs):
    same = defaultdict(list)
    for k, t in pairs:
        same[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(k)
    return same


@pytest.mark.parametrize("digests", [True, False])
def test_exact(awkward, nothing, digests):
    same = brute_exact(texts(awkward))
    want = Counter()
    for text, ids in same.items():
        keep = min((k for k in ids if k is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for k in ids:
            want[k, keep, len(ids), k == keep, sha if digests or len(ids) > 1 else None] += 1
    got = rows_of(exact.exact_groups(awkward, digests=digests))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    assert exact.exact_groups(nothing, digests=digests).count() == 0


def test_exact_dedup_keeps_one_of_each(awkward, nothing):
    kept = exact.exact_dedup(awkward)
    assert kept.columns == awkward.columns
    want = {(text, min((k for k in ids if k is not None), default=None)) for text, ids in brute_exact(texts(awkward)).items()}
    got = [(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), k) for k, t in texts(kept)]
    assert len(got) == len(want) and set(got) == want
    assert exact.exact_dedup(nothing).count() == 0


@pytest.mark.parametrize("n_words", [4, 5])
def test_near(awkward, nothing, n_words):
    pairs = texts(awkward)
    sets = []
    for k, t in pairs:
        w = words_of(t)
        sets.append(frozenset(tuple(w[i : i + n_words]) for i in range(max(1, len(w) - n_words + 1))) if w else frozenset())
    reach = {k: {k} for k, _ in pairs if k is not None}
    for (k, _), s in zip(pairs, sets):
        for (m, _), u in zip(pairs, sets):
            if s and u and None not in (k, m) and 100 * len(s & u) >= 80 * len(s | u):
                joined = reach[k] | reach[m]
                for x in joined:
                    reach[x] = joined
    want = Counter((k, len(s), min(reach[k]) if k is not None else None, k is None or min(reach[k]) == k) for (k, _), s in zip(pairs, sets))
    got = rows_of(near.near_components(awkward, n_words=n_words))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
    assert near.near_components(nothing).count() == 0
    assert near.near_dedup(nothing).count() == 0


def brute_spans(pairs, length):
    first = {}
    late = lambda k: math.inf if k is None else k
    for k, t in pairs:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            first[w] = min(first.get(w, math.inf), late(k))
    out = Counter()
    for k, t in pairs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < late(k):
                gone[p] += 1
                gone[p + length] -= 1
        cut = np.cumsum(gone)[: len(raw)] > 0
        out[k, t, np.frombuffer(raw, np.uint8)[~cut].tobytes(), int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum())] += 1
    return out


@pytest.mark.parametrize(("bucket", "ranges", "around"), [(1 << 17, 4096, 1 << 14), (900, 4096, 1 << 14), (900, 3, 1)])
def test_suffix(awkward, nothing, monkeypatch, bucket, ranges, around):
    """In one bucket, in many ranges, and in parts of ranges with all common grams split by their windows."""
    monkeypatch.setattr(suffix, "BUCKET_ENTRIES", bucket)
    monkeypatch.setattr(suffix, "MOST_RANGES", ranges)
    got = suffix.repeated_spans(awkward, length=BRUTE_WINDOW, most_around=around)
    want = brute_spans(texts(awkward), BRUTE_WINDOW)
    assert Counter((r["doc_id"], r["text"], bytes(r["kept"]), len(r["spans"])) for r in rows_of(got)) == want
    cut = suffix.repeated_spans(awkward, length=BRUTE_WINDOW, cut_text=True)
    assert cut.columns == awkward.columns
    short = Counter()
    for (k, t, kept, _), n in want.items():
        short[k, None if t is None else kept.decode("utf-8", "ignore")] += n
    assert Counter(texts(cut)) == short
    assert suffix.repeated_spans(nothing).count() == 0


def test_scores(awkward, nothing, labels):
    for module, score in ((quality, quality.quality_scores), (toxicity, toxicity.toxicity_scores)):
        model = module.fit(awkward, labels)
        scored = score(awkward, model)
        assert "score" in scored.columns and len(set(scored.columns)) == len(scored.columns)
        found = rows_of(scored.select("doc_id", "text", "score"))
        assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(texts(awkward))
        assert all(0 <= r["score"] <= 1 for r in found)
        empty = module.fit(nothing, labels.limit(0))
        assert score(nothing, empty).count() == 0
        assert all(0 <= r["score"] <= 1 for r in rows_of(score(awkward, empty, carry=["doc_id"])))


def test_language(awkward, nothing):
    pairs = texts(awkward)
    counts = Counter()
    for k, t in pairs:
        if crc(k) % 7 != 2:
            counts.update([*words_of(t), None])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for k, t in pairs:
        own = [*words_of(t), None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        want.append((str(k), crc(k) % 7 == 2, len(own), sum(counts[w] > 0 for w in own), total, round(base, 5)))
    got = rows_of(language.language_scores(awkward, rounds=1))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == sorted(want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert language.language_scores(nothing).count() == 0


def log_sum(x):
    return x.max() + math.log(np.exp(x - x.max()).sum())


def test_language_scores_word_by_word(awkward, monkeypatch):
    """score held against a plain pass over each whole text, one word at a time."""
    kept, step = [], language.weights
    monkeypatch.setattr(language, "weights", lambda *how: kept.append(step(*how)) or kept[-1])
    got = rows_of(language.language_scores(awkward, rounds=2))
    net = recurrent.Gru(*(x.astype(np.float64) for x in kept[0].arrays()))
    pairs, counts = texts(awkward), Counter()
    for k, t in pairs:
        if crc(k) % 7 != 2:
            counts.update([*words_of(t), None])

    def code(w):
        raw = np.frombuffer((w or "").encode(), np.uint8)
        return int(language.token_codes(raw, np.array([0, len(raw)]))[0][:1].view(np.int64)[0])

    n, size, wide = net.n_words, recurrent.CLASS_WORDS, recurrent.HIDDEN
    top = sorted(counts, key=lambda w: (-counts[w], code(w)))[:n]
    place = {w: k for k, w in enumerate(top)}
    rest, kinds = sum(counts.values()) - sum(counts[w] for w in top), len(counts) - len(top)
    want = Counter()
    for doc_id, t in pairs:
        h, last, total = np.zeros(wide), n + 1, 0.0
        for w in [*words_of(t), None]:
            at, x = place.get(w, n), net.inputs[last]
            gates = 1 / (1 + np.exp(-(h @ net.recurrent[:, : 2 * wide] + x[: 2 * wide])))
            h = h + gates[:wide] * (np.tanh((gates[wide:] * h) @ net.recurrent[:, 2 * wide :] + x[2 * wide :]) - h)
            classes, own = h @ net.class_out + net.class_bias, min(at // size, n // size)
            total += classes[own] - log_sum(classes)
            if at < n:
                inner = net.word_out[own * size : (own + 1) * size] @ h + net.word_bias[own * size : (own + 1) * size]
                total += inner[at % size] - log_sum(inner)
            else:
                total += math.log((counts[w] + 1) / (rest + kinds + 1))
            last = at
        want[str(doc_id), total / math.log(10)] += 1
    ours = sorted((str(r["doc_id"]), r["score"]) for r in got)
    theirs = sorted(want.elements())
    assert len(ours) == len(theirs) == len(pairs)
    assert all(a == b and abs(x - y) <= 1e-4 * abs(y) for (a, x), (b, y) in zip(ours, theirs))


def test_stages(spark, awkward, nothing, labels, tmp_path):
    """Each stage on the awkward rows against plain Python, and on no rows."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (awkward, nothing):
        docs.select(*corpus_pipeline.COLUMNS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        rows = texts(docs)
        model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), "quality")
        good = quality.quality_scores(docs, model).where(F.col("score") >= corpus_pipeline.LEAST_QUALITY)
        want = [Counter(texts(good)), after_exact(rows), after_near(rows), after_suffix(rows)]
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            out = corpus_pipeline.stash(stage(spark, docs, str(tmp_path)), f"test-{name}")
            assert out.columns == corpus_pipeline.COLUMNS
            found = texts(out)
            assert Counter((i, normal(t)) for i, t in found) == want[k] if k == 1 else Counter(found) == want[k], name
            assert k == 3 or set(found) <= set(rows)
        packed = corpus_pipeline.stash(corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)), "test-packing").collect()
        coder = packing.WordEncoder(packing.public_tokenizers.path("word_bpe_49k.json")).tokenizer
        sizes = Counter()
        for i, t in rows:
            sizes[i] += len(coder.encode(t or "", add_special_tokens=False).ids) + 1
        found = Counter()
        for r in packed:
            found[r["doc_id"]] += r["length"]
        assert found == sizes


def test_crc32_of_ids():
    assert crc(None) == 0 and crc(12) == zlib.crc32(b"12")
