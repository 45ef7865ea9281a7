"""Tag stems, similarity, clustering and shared-tag pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions.tags import are_similar, frequent_words, stem_tag
from marginalia.operators import tags as T
from marginalia.operators.edit_join import deletion_hashes, edit_join, edit_pairs, near_ids


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(
    ("tag", "stem"),
    [
        ("senior-product-manager", "product-manager"),
        ("product-management", "product-manager"),
        ("Product-Manager", "product-manager"),
        ("analytics", "analyst"),
        ("analysis", "analyst"),
        ("head-of-senior-design", "senior-designer"),
        ("plain", "plain"),
    ],
)
def test_stem(spark, tag, stem):
    assert spark.createDataFrame([(tag,)], "t string").select(stem_tag(F.col("t"))).first()[0] == stem


def test_frequent_words_of_a_row_are_those_of_words_dealt_out(spark):
    texts = ["", " ", None, "short words", "planning", "Planning plan-ning; PLAN9NING gardens", "gardens\x0bplanning\x0cgardens\tx"]
    texts += ["İstanbul über-planning plan\xa0ning plan -- ning", "alphabet betatest gammaray deltaone epsilon zetazeta thetatheta zetazeta"]
    draw = random.Random(3)
    texts += ["".join(draw.choice("abA-9é \n\x1c") * draw.randint(1, 4) for _ in range(400)) for _ in range(60)]
    rows = spark.createDataFrame([(str(k), x) for k, x in enumerate(texts)], "path string, content string")
    for most, least in ((6, 7), (1, 1), (3, 4)):
        want = {r["path"]: r["proposed_tags"] for r in T.deterministic_tags(rows, most, least).collect()}
        got = {r["path"]: r["tags"] for r in rows.select("path", frequent_words(F.col("content"), most, least).alias("tags")).collect()}
        assert len(want) > 3 and got == {str(k): want.get(str(k), []) for k in range(len(texts))}


@pytest.mark.parametrize(
    ("a", "b", "similar"),
    [
        ("hr-analyst", "ai-analyst", False),
        ("machine-model", "machine-models", True),
        ("abc", "abd", False),
        ("abcd", "abce", True),
        ("abcdefghij", "abcdefghxy", False),
        ("abcdefghijk", "abcdefghixy", True),
        ("aéb-xxxx", "aeb-xxxx", False),
        ("abcdef", "abcdef", True),
    ],
)
def test_similar(spark, a, b, similar):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(are_similar(F.col("a"), F.col("b"))).first()[0] is similar


def counts(spark, n):
    return spark.createDataFrame(list(n.items()), "tag string, n long")


def test_only_leaders_attract(spark):
    groups = T.tag_groups(counts(spark, {"aaaaaa": 1, "aaaaab": 1, "aaaabb": 1})).collect()
    assert {(g["leader"], g["tag"]) for g in groups} == {("aaaaaa", "aaaaaa"), ("aaaaaa", "aaaaab")}


def test_canonical_by_count_then_length(spark):
    mapping = T.normalization_map(counts(spark, {"product-management": 3, "product-manager": 5, "senior-product-manager": 1})).collect()
    assert {(m["variant"], m["canonical"]) for m in mapping} == {
        ("product-management", "product-manager"),
        ("senior-product-manager", "product-manager"),
    }
    even = T.normalization_map(counts(spark, {"analytics": 2, "analysis": 2, "analyst": 2})).collect()
    assert {m["canonical"] for m in even} == {"analyst"}


@pytest.mark.parametrize("most", [200_000, 0])
def test_rounds_equal_the_sequential_rule(spark, monkeypatch, most):
    """In one task, and by rounds."""
    monkeypatch.setattr(T, "MOST_EDGES", most)
    draw = random.Random(3)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(6, 8))) for _ in range(60)})
    close = lambda a, b: distance(a, b) <= 2 and distance(a, b) / max(len(a), len(b)) < 0.2
    leader, heads = {}, []
    for word in words:
        leader[word] = next((h for h in heads if close(h, word)), word)
        if leader[word] == word:
            heads.append(word)
    groups = counts(spark, dict.fromkeys(words, 1)).select(F.col("tag").alias("stem"), F.col("tag").alias("first_tag"))
    assert {r["stem"]: r["leader"] for r in T.leaders(groups).collect()} == leader


@pytest.mark.parametrize(("threshold", "letters", "most"), [(1, "ab", 9), (2, "abc", 9), (3, "abc", 9), (3, "ab", 14)])
def test_edit_join_misses_nothing(spark, monkeypatch, threshold, letters, most):
    monkeypatch.setattr("marginalia.operators.edit_join.MOST_CHARS", 6)
    draw = random.Random(threshold)
    left, right = ({"".join(draw.choice(letters) for _ in range(draw.randint(0, most))) for _ in range(60)} for _ in range(2))
    got = edit_join(spark.createDataFrame([(x,) for x in left], "a string"), "a", spark.createDataFrame([(x,) for x in right], "b string"), "b", threshold)
    want = {(a, b, distance(a, b)) for a in left for b in right if distance(a, b) <= threshold}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize(("threshold", "common"), [(1, 1000), (2, 1000), (2, 2), (3, 2)])
def test_edit_pairs_of_one_table(spark, monkeypatch, threshold, common):
    """Short strings by deletions, long ones by pieces, common pieces in parts; each pair once."""
    monkeypatch.setattr("marginalia.operators.edit_join.MOST_CHARS", 7)
    monkeypatch.setattr("marginalia.operators.edit_join.COMMON", common)
    draw = random.Random(threshold)
    words = {"".join(draw.choice("ab") for _ in range(draw.randint(0, 12))) for _ in range(90)}
    got = edit_pairs(spark.createDataFrame([(x,) for x in [*words, None, *list(words)[:5]]], "w string"), "w", threshold)
    want = sorted((a, b, distance(a, b)) for a in words for b in words if a < b and distance(a, b) <= threshold)
    assert sorted(tuple(r) for r in got.collect()) == want


def index(spark, notes):
    rows = [(t, p, k, i) for k, (p, ts) in enumerate(notes.items()) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "tag string, path string, ord long, tag_pos int")


@pytest.mark.parametrize(
    ("notes", "cap", "pairs"),
    [
        ({"A": "xy", "B": "xy", "C": "x"}, 0, {("A", "B", "xy")}),
        ({"A": "xy", "B": "xy", "C": "x"}, 2, set()),
        ({"A": "tt", "B": "t"}, 0, {("A", "B", "tt")}),
        ({"B": "xy", "A": "yx"}, 0, {("A", "B", "xy")}),
    ],
)
def test_shared_tags(spark, notes, cap, pairs):
    got = T.shared_tag_pairs(index(spark, notes), 2, cap).collect()
    assert {(r["note_a"], r["note_b"], "".join(r["shared"])) for r in got} == pairs


def test_distinct_tags_count_once(spark):
    assert T.shared_tag_pairs(index(spark, {"A": "tt", "B": "t"}), 2, 0, distinct=True).count() == 0


def plain_pairs(rows, least):
    """All pairs of listings of all pairs of notes."""
    out = {}
    first = {}
    for path, ord_, tags in rows:
        for k, tag in enumerate(tags):
            first[tag] = min(first.get(tag, (ord_, k)), (ord_, k))
    for a, i, x in rows:
        for b, j, y in rows:
            if a < b:
                met = [(first[s], *sorted([(i, k), (j, m)]), s) for k, s in enumerate(x) for m, t in enumerate(y) if s == t]
                if len(met) >= least:
                    out[a, b] = [s for *_, s in sorted(met)]
    return out


@pytest.mark.parametrize(("least", "repeats", "tile"), [(1, True, 4), (2, False, 512), (2, True, 3), (3, True, 512), (3, False, 2)])
def test_pairs_by_rare_tags(spark, monkeypatch, least, repeats, tile):
    monkeypatch.setattr(T, "TILE", tile)
    draw = random.Random(least * 10 + tile)
    rows = []
    for k in range(60):
        # some tags are on nearly all notes
        tags = draw.sample([f"rare{j}" for j in range(40)], draw.randrange(4)) + [t for t in ("all", "most", "many") if draw.random() < 0.8]
        draw.shuffle(tags)
        rows.append((f"{draw.randrange(1000):03}-{k}.md", k, tags + (tags[:1] if repeats and k % 5 == 0 else [])))
    states = spark.createDataFrame(rows, "path string, ord long, proposed_tags array<string>")
    got = T.shared_tag_pairs(T.tag_index(states), least).collect()
    assert {(r["note_a"], r["note_b"]): r["shared"] for r in got} == plain_pairs(rows, least)
    assert all(r["n_shared"] == len(r["shared"]) for r in got)


def test_frequent_tags_make_no_candidates(spark):
    """Two tags on all of 2,000 notes, and a rare one on every pair: all pairs of notes share two tags in the
    first half only."""
    rows = [(f"{k:04}.md", k, ["common", f"rare{k // 2}"] + (["usual"] if k < 40 else [])) for k in range(2000)]
    entries = T.tag_index(spark.createDataFrame(rows, "path string, ord long, proposed_tags array<string>"))
    found = T.candidate_pairs(entries, 2)
    assert found.count() == 1000 + 40 * 39 // 2 - 20
    assert T.shared_tag_pairs(entries, 2).count() == 1000 + 40 * 39 // 2 - 20


def test_pieces_and_large_ones(spark, monkeypatch):
    """Chains of stems, some larger than a task may walk through, against the rule applied to all at once."""
    draw, edges = random.Random(4), []
    for piece in range(12):
        names = [f"{chr(97 + piece)}{k:02}" for k in range(draw.randrange(2, 14))]
        edges += [(a, b) for k, a in enumerate(names) for b in names[k + 1 : k + 3] if draw.random() < 0.8]
    df = spark.createDataFrame([(a, b, a, b) for a, b in edges], "earlier string, later string, earlier_tag string, later_tag string")
    named = {}
    for r in T.pieces(df).collect():
        named.setdefault(r["piece"], set()).add(r["stem"])
    assert all({a in g for a, b in edges if b in g} <= {True} for g in named.values()) and all(p == min(g) for p, g in named.items())
    want = {}
    for a, b in sorted(edges, key=lambda e: (e[1], e[0])):
        if b not in want and a not in want:
            want[b] = a
    groups = spark.createDataFrame([(x, x) for x in sorted({x for e in edges for x in e} | {"alone"})], "stem string, first_tag string")
    monkeypatch.setattr(T, "similar_stems", lambda *_: df)
    for most in (1000, 8, 0):
        monkeypatch.setattr(T, "MOST_EDGES", most)
        got = {r["stem"]: r["leader"] for r in T.leaders(groups).collect()}
        assert got == {r["stem"]: want.get(r["stem"], r["stem"]) for r in groups.collect()}, most


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each stem is similar to the next: leaders alternate, and ranges settle what they hold in one round."""
    names = [f"s{k:04}" for k in range(401)]
    edges = spark.createDataFrame([(a, b, a, b) for a, b in zip(names, names[1:])], "earlier string, later string, earlier_tag string, later_tag string")
    monkeypatch.setattr(T, "MOST_EDGES", 200)
    monkeypatch.setattr(T, "similar_stems", lambda *_: edges)
    written, stash = [], T.stash
    monkeypatch.setattr(T, "stash", lambda df, name: (written.append(name), stash(df, name))[1])
    groups = spark.createDataFrame([(x, x) for x in names], "stem string, first_tag string")
    assert {r["stem"]: r["leader"] for r in T.leaders(groups).collect()} == {x: names[k - k % 2] for k, x in enumerate(names)}
    assert written.count("stem-roles") <= 3


def test_edges_that_decide_nothing_go(spark, monkeypatch):
    """All stems of a range are similar to those of the range before: once these are known to follow, their
    edges are not dealt out again, while what they lead to still waits for others."""
    names = [f"s{k:03}" for k in range(90)]
    close = [(a, b) for k, a in enumerate(names) for b in names[k + 1 : k + 31]]
    edges = spark.createDataFrame([(a, b, a, b) for a, b in close], "earlier string, later string, earlier_tag string, later_tag string")
    monkeypatch.setattr(T, "MOST_EDGES", 100)
    monkeypatch.setattr(T, "similar_stems", lambda *_: edges)
    follow, idle, stash = set(), [], T.stash

    def watched(df, name):
        out = stash(df, name)
        if name == "stem-roles":
            follow.update(r["stem"] for r in out.where("follows").collect())
        if name == "open-edges":
            idle.append(sum(r["earlier"] in follow for r in out.collect()))
        return out

    monkeypatch.setattr(T, "stash", watched)
    groups = spark.createDataFrame([(x, x) for x in names], "stem string, first_tag string")
    leaders = {r["stem"]: r["leader"] for r in T.leaders(groups).collect()}
    want, heads = {}, []
    for name in names:
        want[name] = next((h for h in heads if (h, name) in set(close)), name)
        heads += [name] if want[name] == name else []
    assert leaders == want
    assert len(idle) > 2 and not any(idle)


def test_deletion_hashes_are_those_of_what_is_left():
    draw = random.Random(7)
    one = lambda w, t: deletion_hashes(np.frombuffer(w.encode("utf-32-le"), np.uint32).reshape(1, len(w)), t)[1].tolist()
    for threshold in (0, 1, 2, 3) * 20:
        word = "".join(draw.choice("aab😀é") for _ in range(draw.randrange(9)))
        left = {"".join(c for k, c in enumerate(word) if k not in gone) for n in range(threshold + 1) for gone in combinations(range(len(word)), n)}
        assert set(one(word, threshold)) == {key for w in left for key in one(w, 0)} and len(set(one(word, threshold))) == len(left)


@pytest.mark.parametrize("threshold", [1, 2])
def test_only_near_strings_meet(spark, threshold):
    """What the places of what is left out tell: of strings that become the same, only those within as many edits
    meet, each such pair, with runs, signs beyond a byte, and short ones."""
    rng = random.Random(5)
    words = {"", "a", "ab", "ba", "é", "ŝŝ", "ŝā", "āŝ"} | {"".join(rng.choice("aabŝāé") for _ in range(rng.randint(3, 9))) for _ in range(160)}
    words = sorted(words | {w[1:] + w[:1] for w in words})
    rows = spark.createDataFrame([(k, w, False) for k, w in enumerate(words)], "id long, string string, fewer boolean")
    got = [(r["a"], r["b"]) for r in near_ids(rows, threshold).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for (i, a), (j, b) in combinations(enumerate(words), 2) if distance(a, b) <= threshold}


def test_similar_stems_lose_no_pair_by_fewer_deletions(spark):
    """Stems of one part and up to ten characters have one deletion each: all similar pairs are still found."""
    rng = random.Random(6)
    tags = {"".join(rng.choice("aab") for _ in range(rng.randint(2, 13))) for _ in range(150)}
    tags |= {x + "-" + y for x, y in zip(sorted(tags)[::3], sorted(tags)[1::3])} | {x[:5] + "-" + x[5:] for x in tags if len(x) > 9}
    groups = T.stems(counts(spark, dict.fromkeys(tags, 1)))
    got = {frozenset(r) for r in T.similar_stems(groups).select("earlier", "later").collect()}
    names = spark.createDataFrame([(x, y) for x, y in combinations(sorted(tags), 2)], "a string, b string")
    want = {frozenset(r) for r in names.where(are_similar(F.col("a"), F.col("b"))).collect()}
    assert len(want) > 200 and got == want


@pytest.mark.parametrize(("most", "least", "set_tags"), [(1, 2, 10), (3, 2, 10), (3, 1, 10), (5, 3, 10), (0, 2, 10), (100, 2, 10), (3, 2, 2)])
def test_most_shared(spark, monkeypatch, most, least, set_tags):
    """Against all pairs: tags on nearly all notes, copies, repeated tags, and notes linked with many others."""
    monkeypatch.setattr(T, "SET_TAGS", set_tags)
    draw = random.Random(most * 10 + least)
    notes = {}
    for k in range(70):
        tags = draw.sample([f"rare{j}" for j in range(30)], draw.randrange(4)) + [t for t in ("all", "most", "many") if draw.random() < 0.8]
        draw.shuffle(tags)
        notes[f"{draw.randrange(100):02}-{k}.md"] = tags + tags[: k % 2]
    names = list(notes)
    for k in range(20):
        notes[f"copy-{k}.md"] = notes[names[0]]
    linked = {tuple(sorted(draw.sample(list(notes), 2))) for _ in range(200)} | {tuple(sorted((names[1], b))) for b in list(notes)[2:60]}
    apart = spark.createDataFrame([*linked, *((b, a) for a, b in linked), ("none.md", names[0])], "path string, other string")
    got = sorted(tuple(r) for r in T.most_shared(index(spark, notes), apart, most, least).collect())
    want = []
    for a, x in notes.items():
        shared = {b: len(set(x) & set(y)) for b, y in notes.items() if a != b and tuple(sorted((a, b))) not in linked}
        best = sorted((b for b, n in shared.items() if n >= least), key=lambda b: (-shared[b], b))[:most]
        want += [(a, b, shared[b], k + 1) for k, b in enumerate(best)]
    assert got == sorted(want)


def test_frequent_tags_list_no_pairs(spark):
    """What is read of the lists of 400 notes with the same tags grows with the notes."""
    sets = spark.createDataFrame([(k, f"{k:03}.md", [0, 1, 2]) for k in range(400)], "id long, path string, tags array<long>")
    apart = spark.createDataFrame([(k, j) for k in range(1, 400) for j in (0,)] + [(0, k) for k in range(1, 400)], "id long, other long")
    # 0 is apart from all others, so its four lists are read whole
    assert T.first_sharers(sets, apart, 5, 2).count() == 399 * 7 + 4 * 400
    assert T.first_sharers(sets, apart.limit(0), 5, 2).count() == 400 * 6


def test_most_shared_of_no_tags(spark):
    assert T.most_shared(index(spark, {}), spark.createDataFrame([], "path string, other string"), 5).count() == 0
    assert T.most_shared(index(spark, {"A": "xy", "B": "x"}), spark.createDataFrame([], "path string, other string"), 5).count() == 0
