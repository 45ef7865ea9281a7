"""The methods inside the operators, and results on the test tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest_texts import words_of
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import blocks, chat, exact, graph, language, media, near, packing, queries, recurrent, shingles, suffix, tokens
from marginalia.llm.blocks import multikey_sort
from marginalia.session import recording

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# packing


def least_cost(places, cost, capacity):
    """All windows tried, over the same candidate places."""
    at, add = [0, *places], [0, *cost]
    best = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min(best[i] + add[j] + capacity - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= capacity)
    ends = [best[i] + packing.tail(at[-1] - at[i], capacity)[0] for i in range(len(at) - 1) if at[-1] - at[i] <= capacity]
    return min(ends)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.sampled_from([0, 4, 64])), min_size=1, max_size=40))
def test_monotone_queue_finds_the_least_cost(steps):
    places = np.cumsum([n for n, _ in steps])
    cost = np.array([c for _, c in steps])
    cost[-1] = 0
    ends = packing.cuts(places, cost, 64)
    price = dict(zip(places.tolist(), cost.tolist()))
    assert ends[-1] == places[-1] and all(0 < b - a <= 64 for a, b in zip([0, *ends], ends))
    paid, last, inner = 0, 0, [e for e in ends if e in price]
    # the last windows may split at places that are no candidates
    body = [e for e in ends if e in price and all(x in price for x in ends if x <= e)]
    for e in body[:-1] if body and body[-1] == places[-1] and len(body) == len(ends) else body:
        paid += price[e] + 64 - (e - last)
        last = e
    options = [paid + packing.tail(int(places[-1]) - last, 64)[0]]
    assert min(options) >= least_cost(places.tolist(), cost.tolist(), 64) and inner
    assert least_cost(places.tolist(), cost.tolist(), 64) <= paid + packing.padding(int(places[-1]) - last, 64)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé.,!?' \n\t\x1c\xa0ſİßΣ1²字\u0958\u0301-—‘s"), max_size=60), min_size=1, max_size=6))
def test_words_encode_as_texts(texts):
    """Also when the cache shrinks between batches."""
    coder = packing.encoder(packing.public_tokenizers.path("word_bpe_49k.json"))
    old, packing.CACHED_WORDS = packing.CACHED_WORDS, 20
    try:
        ids, sizes = coder.encode(pa.array(texts, pa.string()), 2)
    finally:
        packing.CACHED_WORDS = old
    want = [[*x.ids, 2] for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert np.split(ids, np.cumsum(sizes))[:-1] and [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == want


def test_cuts_prefer_sentences():
    stops = np.zeros(200, bool)
    stops[[58, 99, 150, 199]] = True
    places, cost = packing.candidates(stops, np.array([200]))
    assert packing.cuts(places, cost, 64)[0] == 59


def test_little_padding(spark):
    draw = random.Random(1)
    rows = [(k, " ".join(draw.choice(["alpha", "beta.", "gamma", "delta"]) for _ in range(300))) for k in range(300)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    sizes = Counter()
    for p in pieces:
        sizes[p["sequence_id"]] += p["length"]
    lost = sum(packing.padding(n, packing.CAPACITY) for n in sizes.values())
    assert lost < 0.01 * sum(sizes.values())


# tokens


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=200), st.integers(1, 20))
def test_segments_encode_alike(text, chars):
    coder = tokens.encoding(tokens.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokens.public_tokenizers.PATTERN)
    assert "".join(tokens.segments(text, chars)) == text
    assert tokens.encode(text, coder, chars).tolist() == coder.encode_ordinary(text)


# media


@pytest.mark.parametrize("kind", range(5))
def test_filters_round_trip(kind):
    pixels = np.random.default_rng(kind).integers(0, 256, (7, 9)).astype(np.uint8)
    rows = np.zeros((7, 10), np.uint8)
    rows[:, 0] = kind
    for y in range(7):
        for x in range(9):
            a, b = (int(pixels[y, x - 1]) if x else 0), (int(pixels[y - 1, x]) if y else 0)
            c = int(pixels[y - 1, x - 1]) if x and y else 0
            near_ = min((a, b, c), key=lambda v: abs(a + b - c - v))
            rows[y, x + 1] = (int(pixels[y, x]) - [0, a, b, (a + b) // 2, near_][kind]) % 256
    assert (media.unfiltered(rows) == pixels).all()


def test_damage_is_found():
    png = bytearray(media.write_png(b"a" * 192 * 3))
    for at in (0, 20, 45, len(png) - 1):
        bad = bytes(png[:at]) + bytes([png[at] ^ 1]) + bytes(png[at + 1 :])
        with pytest.raises(ValueError):
            media.read_png(bad)
    with pytest.raises(ValueError):
        media.read_png(bytes(png[:-5]))


def test_close_images_have_close_hashes():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 256, (64, 192)).astype(np.uint8)
    distance = lambda x, y: sum(bin(a ^ b).count("1") for a, b in zip(media.cosine_hash(x), media.cosine_hash(y)))
    changed = base.copy()
    changed[5, 5] ^= 255
    assert distance(base, changed) <= 4 < distance(base, draw.integers(0, 256, (64, 192)).astype(np.uint8))


# exact copies


def test_only_survivors_have_their_full_text_hashed(spark):
    """Length and prefix thin out first: texts of a length of their own, or with a prefix of their own
    among equal lengths, are never hashed whole."""
    start = "p" * exact.PREFIX_CHARS
    rows = [(k, "x" * (k + 1)) for k in range(20)]  # lengths of their own
    rows += [(100 + k, f"{k:04d}" + "y" * 400) for k in range(10)]  # one length, other prefixes
    rows += [(200 + k, start + f"{k % 4:04d}") for k in range(6)]  # one length and prefix, four texts
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for digests, want in ((False, 6), (True, 36)):
        with recording() as paths:
            found = exact.exact_groups(docs, digests=digests)
            hashed = spark.read.parquet(next(p for p in paths if "exact-hashes" in p))
        assert hashed.where("text_sha256 IS NOT NULL").count() == want
        assert {r["c0"] for r in hashed.where("_survives").collect()} == set(range(200, 206))
        assert {(r["doc_id"], r["keep_id"]) for r in found.where("group_size > 1").collect()} == {(200, 200), (204, 200), (201, 201), (205, 201)}


# sketches and components


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB \té\n", max_size=40), max_size=8), st.integers(1, 5))
def test_shingle_counts(texts, n):
    raw = [t.encode() for t in texts]
    bounds = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    codes, edges = shingles.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), bounds, n)
    for k, text in enumerate(texts):
        w = words_of(text)
        want = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        assert edges[k + 1] - edges[k] == len(want) and (np.diff(codes[edges[k] : edges[k + 1]].astype(object)) > 0).all()


@pytest.mark.parametrize("true", [0.5, 0.8, 0.9, 1.0])
def test_odd_sketches_estimate(true):
    draw = np.random.default_rng(5)
    errors = []
    for _ in range(30):
        both = round(200 * 2 * true / (1 + true))
        pool = draw.integers(0, 2**63, 400).astype(np.uint64)
        x, y = np.sort(pool[:200]), np.sort(pool[200 - both : 400 - both])
        codes, edges = np.r_[x, y], np.array([0, 200, 400])
        samples = shingles.minhash(codes, edges, 336)
        sketch = shingles.odd_sketch(samples, 2048)
        differing = np.unpackbits(sketch[0] ^ sketch[1]).sum()
        errors.append(float(shingles.similarity(differing, 336, 2048)) - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
    assert abs(np.mean(errors)) < 0.02
    assert true < 0.8 or true + min(errors) > near.margin(336, 80)


def test_large_near_group_in_tiles(spark, monkeypatch):
    """More members than tiles hold, many not similar to the smallest id."""
    monkeypatch.setattr(near, "TILE", 8)
    draw = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(90):
        own = list(base)
        for at in draw.sample(range(60), draw.choice([0, 1, 2, 3])):
            own[at] = f"x{k}-{at}"
        rows.append((k, " ".join(own)))
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(57)} for k, t in rows}
    parent = {k: k for k, _ in rows}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = near.near_components(spark.createDataFrame(rows, "doc_id long, text string"), n_words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: find(k) for k, _ in rows}


@pytest.mark.parametrize("times", [2, 3])
def test_near_links_of_repeated_rows(spark, times):
    """Every row comes several times: groups of a first text and others that differ from it elsewhere."""
    draw, rows = random.Random(5), []
    for group in range(20):
        base = [f"w{group}-{k}" for k in range(60)]
        for k in range(6):
            own = list(base)
            if k:
                own[draw.randrange(4, 56)] = f"x{k}"
            rows.append((group * 10 + k, " ".join(own)))
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(57)} for k, t in rows}
    comp = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    docs = spark.createDataFrame(rows * times, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["component_id"]) for r in near.near_components(docs, n_words=4).collect())
    assert got == Counter({(k, c): times for k, c in comp.items()})


def test_components_of_long_paths(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)]
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["comp"] for r in got} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


# suffixes


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), max_size=30))
def test_multikey_sort(rows):
    columns = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
    order = multikey_sort(*columns)
    assert [rows[k] for k in order] == sorted(rows)


def test_equal_windows_choose_equal_anchors():
    draw = np.random.default_rng(3)
    shared = draw.integers(0, 4, 80).astype(np.uint8)
    found = []
    for _ in range(2):
        raw = np.r_[draw.integers(0, 4, 60), shared, draw.integers(0, 4, 60)].astype(np.uint8)
        code, _, _, _, low, high = suffix.anchors(raw, np.array([0, 200]), 50, 18)
        found.append({(int(w) - 60): int(c) for c, a, b in zip(code, low, high) for w in range(a, b + 1) if 60 <= w <= 90})
    assert found[0] == found[1] and len(found[0]) == 31


def test_anchors_fill_equal_ranges_alike():
    """Anchors have the least hashes of their windows; their codes are spread all the same."""
    raw = np.random.default_rng(5).integers(32, 127, 200_000).astype(np.uint8)
    code = np.unique(suffix.anchors(raw, np.array([0, len(raw)]), 50, 18)[0])
    sizes = np.bincount((code >> np.uint64(59)).astype(np.int64), minlength=32)
    assert sizes.max() < 1.3 * np.median(sizes) and sizes.min() > 0.7 * np.median(sizes)


@pytest.mark.parametrize("chunk", [64, 100, 333])
def test_long_documents_in_segments(monkeypatch, chunk):
    """Every window of a long document has the anchor that it has where the document is hashed whole."""
    draw = np.random.default_rng(chunk)
    words_ = ["".join(chr(97 + c) for c in draw.integers(0, 3, 5)) for _ in range(700)]
    table = pa.table({"id": [1, 2, 3], "text": [" ".join(words_[:500]), "short", " ".join(words_[100:])]})
    body = blocks.to_bytes(table)

    def chosen():
        block = suffix.Block(body, "id", "text", 50, 18)
        return {w: (int(p), int(c), int(d)) for p, c, d, a, b in zip(block.place, block.code, block.doc, block.low, block.high) for w in range(a, b + 1)}

    whole = chosen()
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    assert chosen() == whole and len(whole) > 5000


def test_records_sort_as_suffixes():
    """The order of a bucket is that of the suffixes' bytes, and equal records are equal bytes."""
    draw = np.random.default_rng(4)
    raw = draw.integers(97, 99, 400).astype(np.uint8)
    place = np.arange(32, 340)
    rows = suffix.records(raw, np.array([0, 400]), np.zeros(len(place), np.int64), place, np.full(len(place), 32), np.zeros(len(place), np.int64), np.zeros(len(place), np.uint8), 50, 18)
    order = multikey_sort(*suffix.words_of(rows))
    suffixes = [raw[p : p + 50].tobytes() + raw[p - 32 : p].tobytes() for p in place]
    assert [suffixes[k] for k in order] == sorted(suffixes)


# chat


def test_snapshots_collapse(spark):
    logs = [
        (1, 0, "user", "hi"),
        (2, 0, "user", "hi"),
        (2, 1, "assistant", "yo"),
        (3, 5, "user", "hi"),
        (3, 9, "assistant", "yo"),
        (4, 0, "user", "hi"),
        (4, 1, "assistant", "other <|im_end|>"),
        (5, 0, "user", None),
        (6, None, None, ""),
        (None, 0, "user", "hi"),
        (None, 1, "user", "alone"),
        (7, 0, "user", "hi"),
        (7, 0, "user", "hi"),
        (7, 1, "assistant", "yo"),
    ]
    rows = spark.createDataFrame([(*x, "z", "z") for x in logs], "conv_id long, turn long, role string, text string, place string, hash1 string")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.render_conversations(rows).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {
        2: (2, 3, turn("user", "hi") + turn("assistant", "yo")),
        4: (2, 1, turn("user", "hi") + turn("assistant", "other <| im_end |>")),
        5: (1, 1, turn("user", "")),
        6: (1, 1, turn("", "")),
        None: (2, 1, turn("user", "hi") + turn("user", "alone")),
    }
    assert chat.render_conversations(rows.limit(0)).count() == 0


def test_chat_runs_no_python(spark):
    plan = chat.render_conversations(spark.createDataFrame([(1, 0, "u", "t")], "conv_id long, turn long, role string, text string"))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())


# language


def test_gradients():
    draw = np.random.default_rng(1)
    model = recurrent.Gru.start(np.arange(1024, 0, -1.0), 500.0, 1024)
    for x in model.arrays():
        x += (draw.standard_normal(x.shape) * 0.2).astype(np.float32)
    targets = draw.integers(0, 70, (4, 3))
    targets[2, 1] = 1024
    ids = np.vstack([np.full((1, 3), 1025), targets[:-1]])
    ids[2, 2] = 1025  # a text starts inside the window
    h, real = np.zeros((3, recurrent.HIDDEN), np.float32), np.ones((4, 3), bool)
    loss = lambda: -model.gradients(ids, targets, real, h)[2] / 12
    (rows, found), *rest = model.gradients(ids, targets, real, h)[0]
    inputs = np.zeros_like(model.inputs)
    inputs[rows] = found
    grads = [inputs, *rest]
    for x, g in zip(model.arrays(), grads):
        for at in np.argsort(-np.abs(g).ravel())[:3]:
            old, step = x.ravel()[at], np.float32(1e-2)
            x.ravel()[at] = old + step
            up = loss()
            x.ravel()[at] = old - step
            down = loss()
            x.ravel()[at] = old
            assert abs((up - down) / (2 * float(step)) - g.ravel()[at]) < 3e-3 + 0.05 * abs(g.ravel()[at])


def test_probabilities_sum_to_one_and_state_is_carried():
    model = recurrent.Gru.start(np.arange(1024, 0, -1.0), 500.0, 1024)
    model.word_out += 0.3
    model.class_out += np.random.default_rng(2).standard_normal(model.class_out.shape).astype(np.float32)
    h = np.random.default_rng(3).standard_normal((1, recurrent.HIDDEN)).astype(np.float32)
    every = np.arange(1025)
    assert abs(np.exp(model.logs(np.repeat(h, len(every), 0), every).astype(np.float64)).sum() - 1) < 1e-4
    text = np.random.default_rng(4).integers(0, 1025, 150)
    whole = recurrent.score(model, [text, text[:10], text[:0]], window=1000)
    parts = recurrent.score(model, [text, text[:10], text[:0]], window=7, width=2)
    assert np.allclose(whole, parts, rtol=1e-4) and whole[2] == 0


def test_training_lowers_the_loss():
    draw = np.random.default_rng(6)
    texts = [np.tile(draw.permutation(8), 40) for _ in range(30)]
    model = recurrent.Gru.start(np.full(8, 10.0), 1.0, 512)
    before = recurrent.score(model, texts).sum()
    trained, seen = recurrent.train(model, texts)
    assert seen > 5000 and recurrent.score(trained, texts).sum() > before * 0.9


@pytest.mark.parametrize("sizes", [[3], [31, 1], [700, 45, 2], [5000]])
def test_training_sees_every_token(sizes):
    texts = [np.random.default_rng(k).integers(0, 513, n) for k, n in enumerate(sizes)]
    assert recurrent.train(recurrent.Gru.start(np.full(8, 10.0), 1.0, 512), texts)[1] == sum(sizes)


def test_every_training_document_changes_the_weights(spark, monkeypatch):
    rows = [(k, f"own{k} " * (k % 5 + 1)) for k in range(200)]
    rounds, step = [], language.weights

    def weights(model, lessons, n):
        rounds.extend((row["round"], len(row["tokens"]) // 2) for row in lessons.collect() if row["round"] < n)
        return step(model, lessons, n)

    monkeypatch.setattr(language, "weights", weights)
    language.language_scores(spark.createDataFrame(rows, "doc_id long, text string")).count()
    trained = [k % 5 + 2 for k, _ in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    assert sorted(n for _, n in rounds) == sorted(trained)
    assert {k for k, _ in rounds} == set(range(language.ROUNDS))


# the test tables


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@tables
def test_queries_with_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist()), key=repr)
        assert rows(got) == rows(want), name


@tables
def test_digests(spark, documents):
    packed = {(r["doc_id"], r["start"]): r for r in queries.op1_packing(spark, SF).collect()}
    coder = packing.WordEncoder(packing.public_tokenizers.path("word_bpe_49k.json")).tokenizer
    for (doc_id, start), r in packed.items():
        text = dict(documents)[doc_id]
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[start : start + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
    coded = {r["doc_id"]: r for r in queries.op5_byte_bpe(spark, SF).collect()}
    stored = {r["doc_id"]: r for r in queries.op6_media(spark, SF).collect()}
    for doc_id, text in documents:
        raw = text.encode()
        assert coded[doc_id]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = stored[doc_id]
        assert (r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.1"
    labels = duckdb.sql(f"SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM '{where}/labels.parquet' GROUP BY 1").df().set_index("doc_id")
    for query, label, least in ((queries.op3_quality, "quality", 0.98), (queries.op7_toxicity, "toxic", 0.97)):
        found = query(spark, where).toPandas().set_index("doc_id").join(labels, how="inner")
        held = found[found.held_out]
        assert (held.predicted == held[label]).mean() > least
        assert (held[held[label] == 1].predicted == 1).mean() > 0.85


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_model_beats_its_base(spark):
    found = queries.op10_language(spark, "/root/testdata/sf0.01").toPandas()
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum()
