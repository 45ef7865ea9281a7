"""Results held against plain Python that shares no code with the operators."""

import binascii
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest_texts import words_of
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from marginalia.llm import media, near, packing, quality, samples, suffix, toxicity
from marginalia.llm.blocks import multikey_sort, text_buffer

# packing


def least_cost(places, cost, capacity):
    """All windows tried, over the same candidate places."""
    at, add = [0, *places], [0, *cost]
    best = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min(best[i] + add[j] + capacity - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= capacity)
    return min(best[i] + packing.tail(at[-1] - at[i], capacity)[0] for i in range(len(at) - 1) if at[-1] - at[i] <= capacity)


def paid_for(ends, price, capacity):
    """What these windows cost: some end at candidates, the others are the tail's."""
    options, paid, last, total = [], 0, 0, ends[-1]
    for k, end in enumerate(ends):
        sizes = [b - a for a, b in zip([last, *ends[k:]], ends[k:])]
        if total - last <= capacity and packing.tail(total - last, capacity)[1] == sizes:
            options.append(paid + packing.tail(total - last, capacity)[0])
        if end not in price:
            break
        paid, last = paid + price[end] + capacity - (end - last), end
    return min(options)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.sampled_from([0, 4, 64])), min_size=1, max_size=40))
def test_cuts_cost_the_least(steps):
    places = np.cumsum([n for n, _ in steps])
    cost = np.array([c for _, c in steps])
    cost[-1] = 0
    ends = [int(e) for e in packing.cuts(places, cost, 64)]
    assert ends[-1] == places[-1] and all(0 < b - a <= 64 for a, b in zip([0, *ends], ends))
    price = dict(zip(places.tolist(), cost.tolist()))
    assert paid_for(ends, price, 64) == least_cost(places.tolist(), cost.tolist(), 64)


@pytest.mark.parametrize("kind", ["cased words", "bytes"])
def test_packing_with_another_tokenizer(spark, tmp_path, kind):
    """One that keeps case, and one that keeps white space: ids are the tokenizer's own."""
    if kind == "bytes":
        made = Tokenizer(models.BPE({c: k for k, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}, []))
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    else:
        made = Tokenizer(models.WordLevel({"[UNK]": 0, "Hello": 1, "world": 4, "hello": 2, ".": 3}, unk_token="[UNK]"))
        made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(f"{tmp_path}/tokenizer.json")
    texts = ["Hello world", "hello  world.\nHello", "", None, "WORLD . é" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = defaultdict(list)
    for r in sorted(packing.pack_documents(df, tokenizer=f"{tmp_path}/tokenizer.json", end_id=9, capacity=64).collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(found[r["doc_id"]])
        found[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert found == {k: [*made.encode(t or "", add_special_tokens=False).ids, 9] for k, t in enumerate(texts)}
    assert not packing.by_word(made) and packing.by_word(Tokenizer.from_file(packing.public_tokenizers.path("word_bpe_49k.json")))


# quality


def plain_votes(model, texts):
    """One text and one labelled vector at a time."""
    out = []
    for text in texts:
        terms = quality.term_counts(*text_buffer(pa.array([text or ""])))[0].astype(np.float64)
        if not terms.any():
            out.append(0.0)
            continue
        vector = (terms * model.weights) @ model.basis.astype(np.float64)
        found = []
        for other, label in zip(model.vectors.astype(np.float64), model.labels):
            cosine = sum(x * y for x, y in zip(vector, other)) / math.sqrt(sum(x * x for x in vector)) / math.sqrt(sum(y * y for y in other))
            found.append((cosine, label))
        best = sorted(found, reverse=True)[: quality.NEIGHBOURS]
        votes = [(min(max(c, 1e-6), 1.0) ** quality.SHARPNESS, label) for c, label in best]
        out.append(sum(v * label for v, label in votes) / sum(v for v, _ in votes))
    return out


def invented(n, seed):
    draw = np.random.default_rng(seed)
    good, bad = [f"word{k}" for k in range(40)], ["$$$", "BUY", "!!!", "||", "####", "x9x9"]
    return [(k, " ".join(draw.choice(good if k % 2 else bad, 30 + k % 7))) for k in range(n)]


def test_votes_one_by_one(spark):
    rows = invented(60, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert len(model.labels) > 2 * quality.NEIGHBOURS
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, model).collect()}
    for (k, _), want in zip(rows, plain_votes(model, [t for _, t in rows])):
        assert abs(got[k] - want) < 1e-3 and (got[k] > 0.7) == bool(k % 2)


# toxicity


class PlainKneserNey:
    """The same two models from dictionaries of byte strings."""

    def __init__(self, words, toxic, ordinary, shared):
        self.order, self.d, self.shared = toxicity.ORDER, toxicity.DISCOUNT, shared
        coded = [b"\x02" + w.encode() + b"\x03" for w in words]
        self.levels = {}
        for size in range(1, self.order):
            longer = {w[p - size : p + 1] for w in coded for p in range(size, len(w))}
            self.levels[size] = self.counted(Counter(x[1:] for x in longer))
        weigh = lambda weights: self.counted(sum((Counter({g: n for g in [g]}) for w, n in zip(coded, weights) if n for g in self.grams(w)), Counter()))
        self.both = weigh([a + b for a, b in zip(toxic, ordinary)])
        self.classes = [weigh(toxic), weigh(ordinary)]
        self.seen = {g for w in coded for g in self.grams(w)}

    def grams(self, coded):
        return [coded[max(0, p - self.order + 1) : p + 1] for p in range(1, len(coded))]

    def counted(self, counts):
        sums, follows = Counter(), Counter()
        for gram, n in counts.items():
            sums[gram[:-1]] += n
            follows[gram[:-1]] += 1
        return counts, sums, follows

    def smooth(self, table, gram, below, shared=0.0):
        counts, sums, follows = table
        context = gram[:-1]
        if not sums[context]:
            return below
        total = sums[context] + shared
        return max(counts[gram] - self.d, 0) / total + (self.d * follows[context] + shared) / total * below

    def ratio(self, gram):
        if gram not in self.seen:
            left = [(self.d * f[gram[:-1]] + self.shared) / (s[gram[:-1]] + self.shared) if s[gram[:-1]] else 1.0 for _, s, f in self.classes]
            return math.log(left[0]) - math.log(left[1])
        value = 1 / 256
        for size in range(1, len(gram)):
            value = self.smooth_level(size, gram[len(gram) - size :], value)
        value = self.smooth(self.both, gram, value)
        ratios = [math.log(self.smooth(table, gram, value, self.shared)) for table in self.classes]
        return ratios[0] - ratios[1]

    def smooth_level(self, size, gram, below):
        counts, sums, follows = self.levels[size]
        seen = sums[gram[:-1]]
        return (max(counts[gram] - self.d, 0) + self.d * follows[gram[:-1]] * below) / seen if seen else below

    def text(self, text, mixed):
        words = [w for w in (toxicity.bare(x) for x in re.split(r"[ \n\t\r]", text.lower())) if w]
        own = [sum(self.ratio(g) for g in self.grams(b"\x02" + w.encode() + b"\x03")) for w in words]
        return sum(math.log1p(mixed * math.expm1(min(max(r, -50), 50))) for r in own) / max(1, len(words))


@pytest.mark.parametrize("shared", toxicity.SHARED)
def test_kneser_ney_by_dictionaries(shared):
    words = ["idiot", "idiots", "river", "rivers", "riverside", "a", "über", "idle", "abcdefghijklm"]
    toxic, ordinary = np.array([9, 2, 1, 0, 0, 5, 0, 0, 1]), np.array([0, 0, 6, 3, 1, 7, 2, 2, 1])
    model = toxicity.train(words, toxic, ordinary, shared)
    model.mixed = 0.01
    plain = PlainKneserNey(words, toxic.tolist(), ordinary.tolist(), shared)
    texts = ["The river, an IDIOT!", "idiotic rivers\nriverbed", "", "  ...  ", "über a zzz", "abcdefghijklmnop idiot idiot"]
    got = model.ratios(pa.array(texts))
    assert np.allclose(got, [plain.text(t, 0.01) for t in texts], rtol=1e-4, atol=1e-7)
    assert got[0] > 0 and got[2] == got[3] == 0


# near copies


def test_links_of_an_id_with_several_texts(spark):
    draw = np.random.default_rng(5)
    first, second, third = (" ".join(f"{c}{k}" for k in draw.integers(0, 10_000, 60)) for c in "abc")
    rows = [(1, first), (1, second), (2, first + " end"), (3, second + " end"), (1, first), (5, third), (4, third), (4, second + " end"), (6, "alone " * 9), (7, None), (7, "")]
    got = near.near_components(spark.createDataFrame(rows, "doc_id long, text string"), n_words=4).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1)] * 3 + [(2, 1), (3, 1), (4, 1), (4, 1), (5, 1), (6, 6), (7, 7), (7, 7)]


def test_components_where_every_id_has_several_texts(spark):
    """Against all pairs of rows; half of the ids have two texts, one id has a third of all rows."""
    draw = np.random.default_rng(11)
    bases = [[f"w{k}" for k in draw.integers(0, 50_000, 80)] for _ in range(30)]
    rows = []
    for k in range(120):
        words = list(bases[draw.integers(0, 30)])
        words[draw.integers(0, 80)] = "changed"
        rows.append((int(k if k % 3 else 0) // 2, " ".join(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words_of(t) for _, t in rows)]
    comp = {k: k for k, _ in rows}
    for a, (k, _) in enumerate(rows):
        for b in range(a):
            m, both = rows[b][0], len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]) and comp[k] != comp[m]:
                low, high = sorted((comp[k], comp[m]))
                comp = {x: low if c == high else c for x, c in comp.items()}
    got = near.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((k, comp[k]) for k, _ in rows)


# media


def plain_png(raw):
    """(width, rows of samples) of a grey PNG: one byte at a time, by the format's own words."""
    assert raw[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, data, kinds = 8, b"", []
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        assert int.from_bytes(raw[at + 8 + size : at + 12 + size], "big") == binascii.crc32(kind + body)
        kinds.append(kind)
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND" and set(kinds[1:-1]) == {b"IDAT"} and at == len(raw)
    flat, above, rows = zlib.decompress(data), [0] * width, []
    assert len(flat) == height * (width + 1)
    for y in range(height):
        kind, line = flat[y * (width + 1)], list(flat[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = line[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: (abs(p - v), (a, b, c).index(v)))
            line[x] = (line[x] + [0, a, b, (a + b) // 2, paeth][kind]) % 256
        rows.append(line)
        above = line
    return width, rows


def plain_hash(rows):
    """Cell means of 32 x 32, their cosine transform from its definition, and the 64 lowest against the median."""
    height, width, n = len(rows), len(rows[0]), 32

    def cells(length):
        edges = [k * length // n for k in range(n)] + [length]
        return [(a, max(b, a + 1)) for a, b in zip(edges, edges[1:])]

    small = [[sum(rows[y][x] for y in range(*v) for x in range(*h)) / (v[1] - v[0]) / (h[1] - h[0]) for h in cells(width)] for v in cells(height)]
    wave = [[math.cos(math.pi / n * k * (x + 0.5)) for x in range(n)] for k in range(8)]
    low = [sum(small[y][x] * wave[u][y] * wave[v][x] for y in range(n) for x in range(n)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return low, middle


def test_media_by_another_reader(spark):
    texts = ["", "short", "abc" * 700, "é🙂漢" * 500, "".join(chr(33 + (k * k) % 90) for k in range(20_000)), "x" * 192, " ".join(f"word{k % 37}" for k in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = media.media_columns(df).collect()
    assert len(stored) == len(texts)
    for r in stored:
        raw = texts[r["doc_id"]].encode()
        width, rows = plain_png(bytes(r["media"]))
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert width == 192 and bytes(v for row in rows for v in row) == payload == bytes(r["payload"])
        low, middle = plain_hash(rows)
        bits = [b >> k & 1 for b in bytes(r["hash"]) for k in range(7, -1, -1)]
        # what lies at the median but for rounding may fall on either side
        clear = [abs(v - middle) > 1e-6 * max(map(abs, low)) for v in low]
        assert all(bit == (v > middle) for bit, v, sure in zip(bits, low, clear) if sure), r["doc_id"]
    assert sum(r["media"] is not None for r in stored) == len({bytes(r["media"]) for r in stored})


# samples and suffixes


def test_cap_on_bytes_empties_no_class(spark):
    """The text that comes first by hash is larger than the cap, or takes most of it."""
    rows = [(k, k % 2, "word " * 20) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string")
    first = {r["label"]: r["doc_id"] for r in df.groupBy("label").agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("doc_id")).collect()}
    for size in (540_000, 99_000):
        text = F.when(F.col("doc_id").isin(*first.values()), F.repeat(F.lit("x"), size)).otherwise(F.col("text"))
        kept = samples.first_rows(df.withColumn("text", text), 150, 100_000)
        assert {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()} == {0: 99, 1: 99}
        assert kept.where(F.col("doc_id").isin(*first.values())).count() == 0
    # texts that are all too large: the smallest of each label
    large = df.withColumn("text", F.repeat(F.lit("x"), 200_000 + F.col("doc_id").cast("int")))
    assert {r["doc_id"] for r in samples.first_rows(large, 150, 100_000).collect()} == {0, 1}


def test_split_windows_spread_over_buckets():
    """Windows around one phrase in many surroundings, as a gram with too many of them is split."""
    draw, phrase = np.random.default_rng(3), b"All rights reserved by the owners"
    texts = [bytes(draw.integers(97, 123, 40).astype(np.uint8)) + phrase + bytes(draw.integers(97, 123, 40).astype(np.uint8)) for _ in range(1500)]
    raw, size = np.frombuffer(b"".join(texts), np.uint8), len(texts[0])
    bounds = np.arange(len(texts) + 1) * size
    place = np.concatenate([bounds[:-1] + k for k in range(24, size - 50 + 1)])
    doc, none = place // size, np.zeros(len(place), np.int64)
    rows = suffix.records(raw, bounds, doc, place, none, none, np.ones(len(place), np.uint8), 50, 18)
    rows = rows[multikey_sort(*suffix.words_of(rows))]
    n_buckets = len(rows) // 64
    owner = suffix.buckets_of(rows, np.array([phrase[:16]], "S16"), 2, 1, n_buckets, 50, 18)
    assert owner.min() >= 2 and owner.max() < 2 + n_buckets
    counts = np.bincount(owner - 2, minlength=n_buckets)
    assert counts.max() <= 4 * np.median(counts)


# the pipeline


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def after_exact(rows):
    least = {}
    for k, t in rows:
        least.setdefault(normal(t), []).append(k)
    return Counter((min((k for k in ids if k is not None), default=None), text) for text, ids in least.items())


def after_near(rows):
    sets = []
    for k, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = {k: k for k, _ in rows if k is not None}
    for (k, _), s in zip(rows, sets):
        for (m, _), u in zip(rows, sets):
            if s and u and None not in (k, m) and 100 * len(s & u) >= 80 * len(s | u) and comp[k] != comp[m]:
                low, high = sorted((comp[k], comp[m]))
                comp = {x: low if c == high else c for x, c in comp.items()}
    return Counter((k, t) for k, t in rows if k is None or comp[k] == k)


def after_suffix(rows, length=50):
    first, late = {}, lambda k: math.inf if k is None else k
    for k, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            first[raw[p : p + length]] = min(first.get(raw[p : p + length], math.inf), late(k))
    out = Counter()
    for k, t in rows:
        raw, gone = (t or "").encode(), set()
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < late(k):
                gone.update(range(p, p + length))
        out[k, None if t is None else bytes(c for p, c in enumerate(raw) if p not in gone).decode("utf-8", "ignore")] += 1
    return out


def test_stages_chained(spark, tmp_path):
    """Each stage's rows on all that the one before kept, and run() as a whole."""
    rows = invented(60, 2)
    passage = "this one passage of many words goes from one document to the next without any change at all, "
    good = [(k, t) for k, t in rows if k % 2]
    rows += [(100 + k, t.replace(" ", " \n ")) for k, t in good[:4]]  # copies but for white space
    rows += [(200 + k, t + " word1 and") for k, t in good[:6]]  # near copies
    rows += [(300 + k, f"{good[k][1][:150]} {passage} {good[k + 9][1][-150:]}") for k in range(5)]
    rows += [(400, None), (401, ""), (402, " \n"), (None, good[1][1]), (None, f"word3 word4 {passage} word5"), (7, dict(good)[7])]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, None, "s", 1) for k, t in rows], columns).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = plain_votes(model, [t for _, t in rows])
    assert not any(abs(s - corpus_pipeline.LEAST_QUALITY) < 1e-3 for s in scores)

    def step(k, docs):
        out = corpus_pipeline.stash(corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)), f"chain-{k}")
        assert k == 4 or out.columns == corpus_pipeline.COLUMNS
        return out, [(r["doc_id"], r["text"]) for r in out.collect()] if k < 4 else out.collect()

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now, kept = step(0, read)
    assert Counter(kept) == Counter(r for r, s in zip(rows, scores) if s >= corpus_pipeline.LEAST_QUALITY) and 30 < len(kept) < len(rows) - 25
    now, less = step(1, now)
    assert Counter((k, normal(t)) for k, t in less) == after_exact(kept) and set(less) <= set(kept) and len(less) < len(kept)
    now, few = step(2, now)
    assert Counter(few) == after_near(less) and len(few) < len(less)
    now, cut = step(3, now)
    assert Counter(cut) == after_suffix(few) != Counter(few)
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect() if r["text"] is not None)

    def whole(pieces):
        """Documents put together from their pieces, which lie without gaps in their sequences."""
        sequences, out, held = defaultdict(list), Counter(), []
        for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
            assert p["offset"] == sum(x["length"] for x in sequences[p["sequence_id"]]) and p["start"] == len(held)
            sequences[p["sequence_id"]].append(p)
            held += np.frombuffer(p["ids"], "<u4").tolist()
            if len(held) == p["doc_tokens"]:
                out[p["doc_id"], tuple(held)] += 1
                held = []
        assert not held and all(sum(x["length"] for x in s) <= 4096 for s in sequences.values())
        return out

    coder = packing.WordEncoder(packing.public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = Counter((k, (*coder.encode(t or "", add_special_tokens=False).ids, 2)) for k, t in cut)
    assert whole(step(4, now)[1]) == want
    assert {k for k, _ in whole(corpus_pipeline.run(spark, str(tmp_path)).collect())} == {k for k, _ in want}
