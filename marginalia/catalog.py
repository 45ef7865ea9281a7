"""Queries over the reference's operators on note-shaped documents, each with its SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions.tags import RANKS, WORD_FORMS, stem_tag
from .operators import enrich as E
from .operators import links as L
from .operators import rewrite as R
from .operators import search as Q
from .operators import state as S
from .operators import tags as T
from .operators.edit_log import replayed
from .operators.search_index import SearchIndex
from .plans.store import Store
from .session import shared_dir, stash
from .sources.vault import drop_vault, read_vault, write_edits

CAP, MIN_SHARED, WORD = 10, 2, "the"


# note-shaped inputs, built alike in both languages


def docs(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet")
    path = F.concat("source", F.lit("/"), "lang", F.lit("-"), "doc_id", F.lit(".md"))
    return rows.select("doc_id", "lang", "source", path.alias("path"), F.col("text").alias("content"))


NOTES = """docs AS (
    SELECT doc_id, lang, source, source || '/' || lang || '-' || doc_id || '.md' AS path, text AS content FROM documents
)"""


def linked_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d)
    first = F.concat(F.lit("\n[["), "lang", F.lit("-"), (F.col("doc_id") * 7 + 3) % 1000, F.lit("]]"))
    second = F.concat(F.lit("\n[[en-"), (F.col("doc_id") * 3) % 1000, F.lit("|x]]"))
    return rows.withColumn("content", F.concat("content", first, second))


LINKED = f"""{NOTES}, linked AS (
    SELECT doc_id, lang, source, path, content || chr(10) || '[[' || lang || '-' || ((doc_id * 7 + 3) % 1000) || ']]'
        || chr(10) || '[[en-' || ((doc_id * 3) % 1000) || '|x]]' AS content FROM docs
)"""


def tagged_states(spark: SparkSession, d: str) -> DataFrame:
    """State records of all notes with deterministic tags, written as the store would."""
    notes = docs(spark, d)
    tags = T.deterministic_tags(notes.select("path", "content"))
    rows = notes.join(tags, "path").select("path", F.col("doc_id").alias("ord"), X.content_hash(F.col("content")).alias("content_hash"), "proposed_tags")
    rows = rows.select(
        "path",
        "ord",
        "content_hash",
        F.lit(0.0).alias("processed_at"),
        "proposed_tags",
        F.array().cast(f"array<{S.LINK}>").alias("proposed_links"),
        (F.col("ord") % 3 == 0).alias("tags_applied"),
        F.lit(False).alias("links_applied"),
    )
    return stash(rows, "states")


TAGGED = f"""{NOTES}, words AS (
    SELECT path, doc_id, regexp_replace(w, '[^a-z]', '', 'g') AS tag
    FROM (SELECT path, doc_id, unnest(string_split_regex(lower(content), '\\s+')) AS w FROM docs)
), counted AS (
    SELECT path, doc_id, tag, count(*) AS n FROM words WHERE length(tag) >= 7 GROUP BY ALL
), entries AS (
    SELECT path, doc_id AS ord, tag, row_number() OVER (PARTITION BY path ORDER BY n DESC, tag) - 1 AS tag_pos FROM counted
    QUALIFY tag_pos < 6
), tag_n AS (SELECT tag, count(*) AS n FROM entries GROUP BY tag)"""

PAIRS = f"""{TAGGED}, capped AS (
    SELECT e.* FROM entries e JOIN tag_n USING (tag) WHERE n <= {CAP}
), places AS (SELECT tag, min((ord, tag_pos)) AS place FROM capped GROUP BY tag), pairs AS (
    SELECT least(a.path, b.path) AS note_a, greatest(a.path, b.path) AS note_b, count(*) AS n_shared,
        string_agg(tag, ',' ORDER BY place) AS shared
    FROM capped a JOIN capped b USING (tag) JOIN places USING (tag)
    WHERE (a.ord, a.tag_pos) < (b.ord, b.tag_pos) AND a.path <> b.path
    GROUP BY 1, 2 HAVING count(*) >= {MIN_SHARED}
)"""


def shown(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("shared", F.array_join("shared", ","))


# scans, hashes, lines, search


def scan_hash(spark, d):
    return docs(spark, d).select("path", X.content_hash(F.col("content")).alias("content_hash"))


def list_notes(spark, d):
    listed = Q.list_notes(docs(spark, d), "src1").select("path")
    return S.numbered(listed, X.sort_key(F.col("path")), name="at").select("path", (F.col("at") + 1).alias("place"))


def incremental_changed(spark, d):
    """A later snapshot: every tenth note is edited, every fiftieth was unknown."""
    before = docs(spark, d)
    states = before.where("doc_id % 50 <> 7").select("path", X.content_hash(F.col("content")).alias("content_hash"))
    edited = F.when(F.col("doc_id") % 10 == 3, F.concat("content", F.lit(" edited"))).otherwise(F.col("content"))
    return S.changed(Q.hashed(before.withColumn("content", edited)), states).select("path", "content_hash")


def note_lines(spark, d):
    return Q.note_lines(docs(spark, d))


def search_lines(spark, d):
    return Q.search_lines(docs(spark, d), "license")


def search_cutoff(spark, d):
    return Q.search(docs(spark, d), WORD)


def search_index_lines(spark, d):
    return SearchIndex.build(docs(spark, d)).search_lines("license")


def search_index_cutoff(spark, d):
    return SearchIndex.build(docs(spark, d)).search(WORD)


def note_preview(spark, d):
    return docs(spark, d).select("path", X.preview(F.col("content")).alias("preview"), X.stem(F.col("path")).alias("stem"))


LINES = r"""lines AS (
    SELECT path, line_no, line FROM (
        SELECT path, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no, len(parts) AS n
        FROM (SELECT path, string_split_regex(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS parts FROM docs)
    ) WHERE line_no < n OR line <> ''
)"""

SCAN_SQL = {
    "scan_hash": f"WITH {NOTES} SELECT path, substr(sha256(content), 1, 16) AS content_hash FROM docs",
    "list_notes": f"""WITH {NOTES} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place
        FROM docs WHERE starts_with(path, 'src1/')""",
    "incremental_changed": f"""WITH {NOTES}, later AS (
            SELECT path, doc_id, substr(sha256(content), 1, 16) AS old_hash,
                substr(sha256(CASE WHEN doc_id % 10 = 3 THEN content || ' edited' ELSE content END), 1, 16) AS content_hash
            FROM docs)
        SELECT path, content_hash FROM later WHERE doc_id % 50 = 7 OR content_hash <> old_hash""",
    "note_lines": f"WITH {NOTES}, {LINES} SELECT path, line_no, line FROM lines",
    "search_lines": f"""WITH {NOTES}, {LINES} SELECT path, line_no, trim(line, chr(9) || chr(32)) AS line FROM lines
        WHERE regexp_matches(line, 'license', 'i')""",
    "search_cutoff": f"""WITH {NOTES}, {LINES}, found AS (
            SELECT path, line_no, trim(line, chr(9) || chr(32)) AS line FROM lines WHERE regexp_matches(line, '{WORD}', 'i')
        ), counts AS (SELECT path, count(*) AS n FROM found GROUP BY path), running AS (
            SELECT path, n, coalesce(sum(n) OVER (
                ORDER BY string_split(path, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts)
        SELECT path, line_no, line, before + n > 100 AS truncated FROM found JOIN running USING (path) WHERE before <= 100""",
    "note_preview": f"""WITH {NOTES} SELECT path, substr(content, 1, 500) AS preview, lang || '-' || doc_id AS stem FROM docs""",
}
SCAN_SQL |= {"search_index_lines": SCAN_SQL["search_lines"], "search_index_cutoff": SCAN_SQL["search_cutoff"]}


# links, tags and frontmatter in texts


def links_outgoing(spark, d):
    return L.edges(linked_docs(spark, d))


def links_backlinks(spark, d):
    return L.backlinks(linked_docs(spark, d))


def already_linked_pairs(spark, d):
    pairs = T.shared_tag_pairs(T.tag_index(tagged_states(spark, d)), MIN_SHARED, CAP)
    # each pair's first note also links to the second's stem where its number is even
    notes = docs(spark, d)
    more = pairs.join(notes.select(F.col("path").alias("note_a"), "doc_id"), "note_a").where("doc_id % 2 = 0")
    added = more.select(F.col("note_a").alias("src_path"), F.lit(9).alias("pos"), X.stem(F.col("note_b")).alias("target"))
    return L.already_linked(pairs, L.edges(linked_docs(spark, d)).unionByName(added)).select("note_a", "note_b")


def inline_tags(spark, d):
    rows = docs(spark, d)
    content = F.concat("content", F.lit(" #"), "source", F.lit(" #topic/"), "lang", F.lit(" #1x ##no\n#"), "source")
    return rows.select("path", F.array_join(X.inline_tags(content), ",").alias("tags"))


def frontmatter_fields(spark, d):
    rows = docs(spark, d)
    head = F.concat(
        F.lit("---\ntitle: "), "source", F.lit(": x\n lang : "), "lang", F.lit("\nplain\nid: "), "doc_id", F.lit("\nlang: last\n---\n"), "content"
    )
    return rows.select("path", F.explode(X.frontmatter(head)).alias("key", "value"))


TEXT_SQL = {
    "links_outgoing": rf"""WITH {LINKED} SELECT src_path, pos, target FROM (
            SELECT path AS src_path, unnest(t) AS target, generate_subscripts(t, 1) - 1 AS pos
            FROM (SELECT path, regexp_extract_all(content, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1) AS t FROM linked))""",
    "links_backlinks": f"""WITH {LINKED} SELECT a.path, b.path AS src_path
        FROM (SELECT path, lang || '-' || doc_id AS stem FROM docs) a JOIN linked b
        ON a.path <> b.path AND (contains(b.content, '[[' || stem || ']]') OR contains(b.content, '[[' || stem || '|'))""",
    "already_linked_pairs": f"""WITH {PAIRS}, {LINKED.removeprefix(NOTES + ", ")}, who AS (
            SELECT path, doc_id, lang || '-' || doc_id AS stem FROM docs)
        SELECT note_a, note_b FROM pairs JOIN who a ON a.path = note_a JOIN who b ON b.path = note_b
            JOIN linked la ON la.path = note_a JOIN linked lb ON lb.path = note_b
        WHERE a.doc_id % 2 = 0
            OR contains(la.content, '[[' || b.stem || ']]') OR contains(la.content, '[[' || b.stem || '|x]]')
            OR contains(lb.content, '[[' || a.stem || ']]') OR contains(lb.content, '[[' || a.stem || '|x]]')""",
    "inline_tags": rf"""WITH {NOTES} SELECT path, array_to_string(list_sort(list_distinct(regexp_extract_all(
            content || ' #' || source || ' #topic/' || lang || ' #1x ##no' || chr(10) || '#' || source,
            '(?:^|\s)#([a-zA-Z][\w/-]*)', 1))), ',') AS tags FROM docs""",
    "frontmatter_fields": f"""WITH {NOTES} SELECT path, unnest(['title', 'lang', 'id']) AS key,
            unnest([source || ': x', 'last', doc_id::VARCHAR]) AS value FROM docs""",
}


# tags


def tag_counts(spark, d):
    return T.tag_counts(tagged_states(spark, d))


def tag_index(spark, d):
    return T.tag_index(tagged_states(spark, d))


def tag_freq_filter(spark, d):
    return T.skipped_tags(tag_index(spark, d), CAP)


def tag_pairs(spark, d):
    return shown(T.ranked_pairs(T.shared_tag_pairs(tag_index(spark, d), MIN_SHARED, CAP)))


def tag_pairs_unevaluated(spark, d):
    pairs = stash(T.shared_tag_pairs(tag_index(spark, d), MIN_SHARED, CAP), "pairs")
    evaluated = pairs.where("length(note_a) % 2 = 0").select("note_a", "note_b")
    return shown(T.unevaluated(pairs, S.mark_evaluated(evaluated.limit(0), evaluated)))


def tag_pairs_dup_semantics(spark, d):
    """Every fifth note lists its first tag twice: both listings count."""
    states = tagged_states(spark, d)
    twice = F.when(F.col("ord") % 5 == 0, F.concat("proposed_tags", F.slice("proposed_tags", 1, 1))).otherwise(F.col("proposed_tags"))
    return shown(T.shared_tag_pairs(T.tag_index(states.withColumn("proposed_tags", twice)), MIN_SHARED, CAP))


def varied_counts(spark, d) -> DataFrame:
    """Tags with their counts, and forms of some of them that share a stem or differ by a letter."""
    counts = T.tag_counts(tagged_states(spark, d))
    forms = [("senior-", ""), ("", "s"), ("", "-management"), ("", "-manager"), ("head-of-", "-design")]
    picked = counts.where("length(tag) >= 11")
    more = [picked.select(F.concat(F.lit(a), "tag", F.lit(b)).alias("tag"), (F.col("n") + k).alias("n")) for k, (a, b) in enumerate(forms)]
    out = counts
    for rows in more:
        out = out.unionByName(rows)
    return stash(out.groupBy("tag").agg(F.sum("n").cast("long").alias("n")), "varied-tags")


def tag_stems(spark, d):
    return varied_counts(spark, d).select("tag", stem_tag(F.col("tag")).alias("stem"))


def tag_similar(spark, d):
    return T.similar_stems(T.stems(varied_counts(spark, d))).select("earlier", "later")


def tag_groups(spark, d):
    return T.tag_groups(varied_counts(spark, d))


def tag_canonical(spark, d):
    return T.canonical_groups(varied_counts(spark, d)).withColumn("variants", F.array_join("variants", ","))


def tag_normalization_map(spark, d):
    return T.normalization_map(varied_counts(spark, d))


def tag_merge_preview(spark, d):
    counts = varied_counts(spark, d)
    return T.merge_preview(counts, stash(T.normalization_map(counts), "map")).withColumn("variants", F.array_join("variants", ","))


def tags_normalized(spark, d):
    """Notes that list each long tag in another form too."""
    states = tagged_states(spark, d)
    forms = F.transform(F.filter("proposed_tags", lambda t: F.length(t) >= 11), lambda t: F.concat(t, F.lit("s")))
    states = stash(states.withColumn("proposed_tags", F.concat("proposed_tags", forms)), "formed")
    mapping = T.normalization_map(T.tag_counts(states))
    return T.normalized(states, stash(mapping, "map")).select("path", F.array_join("proposed_tags", ",").alias("tags"), "replaced")


FORMS = ", ".join(f"('{other}', '{first}')" for first, *others in WORD_FORMS for other in others)
VARIED = f"""{TAGGED}, varied AS (
    SELECT tag, sum(n)::BIGINT AS n FROM (
        SELECT tag, n FROM tag_n
        UNION ALL SELECT 'senior-' || tag, n FROM tag_n WHERE length(tag) >= 11
        UNION ALL SELECT tag || 's', n + 1 FROM tag_n WHERE length(tag) >= 11
        UNION ALL SELECT tag || '-management', n + 2 FROM tag_n WHERE length(tag) >= 11
        UNION ALL SELECT tag || '-manager', n + 3 FROM tag_n WHERE length(tag) >= 11
        UNION ALL SELECT 'head-of-' || tag || '-design', n + 4 FROM tag_n WHERE length(tag) >= 11
    ) GROUP BY tag
)"""


def grouping(source: str) -> str:
    """CTEs over source(tag, n): named (tag, n, stem), stems, close pairs, leaders and grouped."""
    return rf"""forms(form, canon) AS (VALUES {FORMS}), named AS (
    SELECT tag, n, (
        SELECT string_agg(coalesce(canon, part), '-' ORDER BY k)
        FROM (SELECT unnest(parts) AS part, generate_subscripts(parts, 1) AS k) LEFT JOIN forms ON form = part
    ) AS stem
    FROM (SELECT tag, n, string_split(regexp_replace(lower(tag),
        '{RANKS}', ''), '-') AS parts FROM {source})
), stems AS (
    SELECT stem, first_tag, row_number() OVER (ORDER BY first_tag) AS i, len(parts) AS n_parts, parts, length(stem) AS chars
    FROM (SELECT stem, min(tag) AS first_tag, string_split(stem, '-') AS parts FROM named GROUP BY stem)
), measured AS (
    SELECT a.stem AS earlier, b.stem AS later, a.i AS i, b.i AS j, levenshtein(a.stem, b.stem) AS edits,
        greatest(a.chars, b.chars) AS longest, a.parts AS p, b.parts AS q, a.n_parts = b.n_parts AND a.n_parts > 1 AS same
    FROM stems a JOIN stems b ON a.i < b.i AND abs(a.chars - b.chars) <= 2
), close AS (
    SELECT earlier, later, i, j FROM measured WHERE edits <= 2 AND CASE
        WHEN longest <= 3 THEN edits = 0 WHEN longest <= 5 THEN edits <= 1
        WHEN same THEN len(list_filter(list_zip(p, q), lambda x: CASE WHEN greatest(length(x[1]), length(x[2])) <= 3
            THEN x[1] <> x[2] ELSE levenshtein(x[1], x[2]) > 1 END)) = 0
        ELSE edits / longest < 0.2 END
), walk(step, led) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT step + 1, CASE WHEN EXISTS (SELECT 1 FROM close WHERE j = step + 1 AND list_contains(led, i))
        THEN led ELSE list_append(led, step + 1) END
    FROM walk WHERE step < (SELECT count(*) FROM stems)
), heads AS (
    SELECT unnest(led) AS i FROM walk WHERE step = (SELECT count(*) FROM stems)
), leaders AS (
    SELECT s.stem, coalesce((SELECT earlier FROM close WHERE j = s.i AND i IN (SELECT i FROM heads) ORDER BY i LIMIT 1), s.stem) AS leader
    FROM stems s
), grouped AS (
    SELECT leader, tag, n, stem FROM named JOIN leaders USING (stem)
    QUALIFY count(*) OVER (PARTITION BY leader) > 1
), best AS (
    SELECT leader, tag AS canonical FROM grouped
    QUALIFY row_number() OVER (PARTITION BY leader ORDER BY n DESC, length(tag), tag) = 1
), mapping AS (SELECT tag AS variant, canonical FROM grouped JOIN best USING (leader) WHERE tag <> canonical)"""


GROUPED = f"{VARIED}, {grouping('varied')}"

TAG_SQL = {
    "tag_counts": f"WITH {TAGGED} SELECT tag, n FROM tag_n",
    "tag_index": f"WITH {TAGGED} SELECT tag, path, ord, tag_pos FROM entries",
    "tag_freq_filter": f"WITH {TAGGED} SELECT tag, n FROM tag_n WHERE n > {CAP}",
    "tag_pairs": f"WITH {PAIRS} SELECT note_a, note_b, n_shared, shared FROM pairs",
    "tag_pairs_unevaluated": f"WITH {PAIRS} SELECT note_a, note_b, n_shared, shared FROM pairs WHERE length(note_a) % 2 <> 0",
    "tag_pairs_dup_semantics": f"""WITH {TAGGED}, twice AS (
            SELECT path, ord, tag, tag_pos FROM entries
            UNION ALL SELECT path, ord, tag, (SELECT count(*) FROM entries x WHERE x.path = e.path) FROM entries e WHERE ord % 5 = 0 AND tag_pos = 0
        ), capped AS (SELECT * FROM twice WHERE tag IN (SELECT tag FROM twice GROUP BY tag HAVING count(*) <= {CAP})),
        places AS (SELECT tag, min((ord, tag_pos)) AS place FROM capped GROUP BY tag)
        SELECT least(a.path, b.path) AS note_a, greatest(a.path, b.path) AS note_b, count(*) AS n_shared,
            string_agg(tag, ',' ORDER BY place) AS shared
        FROM capped a JOIN capped b USING (tag) JOIN places USING (tag)
        WHERE (a.ord, a.tag_pos) < (b.ord, b.tag_pos) AND a.path <> b.path
        GROUP BY 1, 2 HAVING count(*) >= {MIN_SHARED}""",
    "tag_stems": f"WITH RECURSIVE {GROUPED} SELECT tag, stem FROM named",
    "tag_similar": f"WITH RECURSIVE {GROUPED} SELECT earlier, later FROM close",
    "tag_groups": f"WITH RECURSIVE {GROUPED} SELECT leader, tag, n FROM grouped",
    "tag_canonical": f"""WITH RECURSIVE {GROUPED}, ordered AS (
            SELECT leader, tag, row_number() OVER (PARTITION BY leader
                ORDER BY length(tag), stem <> leader, first_tag, tag) AS place FROM grouped JOIN stems USING (stem))
        SELECT min(tag) FILTER (WHERE place = 1) AS canonical, string_agg(tag, ',' ORDER BY tag) AS variants FROM ordered GROUP BY leader""",
    "tag_normalization_map": f"WITH RECURSIVE {GROUPED} SELECT variant, canonical FROM mapping",
    "tag_merge_preview": f"""WITH RECURSIVE {GROUPED}
        SELECT canonical, any_value(c.n) AS n, string_agg(variant, ',' ORDER BY v.n DESC, variant) AS variants
        FROM mapping JOIN varied c ON c.tag = canonical JOIN varied v ON v.tag = variant GROUP BY canonical""",
    "tags_normalized": f"""WITH RECURSIVE {TAGGED}, formed AS (
            SELECT path, tag, tag_pos FROM entries
            UNION ALL SELECT path, tag || 's', 100 + tag_pos FROM entries WHERE length(tag) >= 11
        ), formed_n AS (SELECT tag, count(*) AS n FROM formed GROUP BY tag), {grouping('formed_n')}, mapped AS (
            SELECT path, coalesce(canonical, tag) AS tag, tag_pos, canonical IS NOT NULL AS moved
            FROM formed LEFT JOIN mapping ON variant = tag
        ), firsts AS (SELECT path, tag, min(tag_pos) AS tag_pos, count_if(moved) AS moved FROM mapped GROUP BY path, tag)
        SELECT path, string_agg(tag, ',' ORDER BY tag_pos) AS tags, sum(moved)::BIGINT AS replaced FROM firsts GROUP BY path""",
}


# proposed links


def wrong_targets() -> Column:
    """The targets that a note's record proposes, good and bad ones."""
    number, own = F.col("doc_id"), F.concat("lang", F.lit("-"), "doc_id")
    pick = lambda every, rest, x: F.when(number % every == rest, x)
    return F.array_compact(
        F.array(
            F.col("path"),
            pick(2, 0, own),
            pick(3, 0, F.concat(F.lit("Wrong/"), F.upper(own), F.lit(".md"))),
            pick(40, 1, F.concat(own, F.lit("zz"))),
            pick(5, 0, F.lit("entirely different thing")),
            pick(2, 0, own),
            pick(4, 0, F.col("path")),
        )
    )


def link_states(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d)
    reason = lambda i: F.repeat(F.lit("r"), ((F.col("doc_id") + i) % 4).cast("int"))
    links = F.transform(wrong_targets(), lambda t, i: F.struct(t.alias("target"), reason(i).alias("reason")))
    return rows.select(
        "path",
        F.col("doc_id").alias("ord"),
        F.lit("h").alias("content_hash"),
        F.lit(0.0).alias("processed_at"),
        F.array(F.lit("b"), F.lit("a")).alias("proposed_tags"),
        links.cast(f"array<{S.LINK}>").alias("proposed_links"),
        (F.col("doc_id") % 3 == 0).alias("tags_applied"),
        (F.col("doc_id") % 4 == 0).alias("links_applied"),
    )


def link_rows(states: DataFrame) -> DataFrame:
    return L.proposals(states).select("path", "pos", "target", "reason")


def link_validate(spark, d):
    return L.validated(link_states(spark, d), docs(spark, d)).select("path", "pos", "target", "status", "correction")


def link_validate_fix(spark, d):
    return L.validated(link_states(spark, d), docs(spark, d), fix=True).select("path", "pos", "target", "status", "correction")


def link_fuzzy(spark, d):
    return L.repairs(L.proposals(link_states(spark, d)), docs(spark, d)).select("target", "by_name", "by_fuzzy")


def link_validation_counts(spark, d):
    return L.validation_counts(L.validated(link_states(spark, d), docs(spark, d), fix=True))


def links_fixed(spark, d):
    fixed = L.fixed_links(link_states(spark, d), docs(spark, d))
    return fixed.select("path", F.array_join(F.transform("proposed_links", lambda x: x["target"]), ",").alias("targets"), "links_applied")


def links_dedup(spark, d):
    return link_rows(L.deduplicated(link_states(spark, d)))


def links_self_removed(spark, d):
    return link_rows(L.without_self_links(link_states(spark, d)))


def verdicts_merged(spark, d):
    """Confirmed pairs of neighbouring notes; every ninth names a note without a record."""
    states = link_states(spark, d)
    rows = states.select("path", "ord")
    nxt = rows.select(F.col("path").alias("note_b"), (F.col("ord") - 1).alias("ord"))
    pairs = rows.join(nxt, "ord").select(F.col("path").alias("note_a"), "note_b", "ord").where("ord % 6 = 0")
    given = F.when(F.col("ord") % 9 == 0, F.concat(F.lit("new/"), "ord", F.lit(".md")))
    verdicts = pairs.select("note_a", "note_b", given.alias("link_from"), F.lit(None).cast("string").alias("link_to"), F.lit("why").alias("reason"), F.col("ord").alias("seq"))
    merged = L.with_verdicts(states, verdicts)
    return merged.select("path", F.array_join(F.transform("proposed_links", lambda x: x["target"]), ",").alias("targets"), "links_applied", "content_hash")


STATES = f"""{NOTES}, listed AS (
    SELECT path, doc_id, list_filter([path,
        CASE WHEN doc_id % 2 = 0 THEN lang || '-' || doc_id END,
        CASE WHEN doc_id % 3 = 0 THEN 'Wrong/' || upper(lang || '-' || doc_id) || '.md' END,
        CASE WHEN doc_id % 40 = 1 THEN lang || '-' || doc_id || 'zz' END,
        CASE WHEN doc_id % 5 = 0 THEN 'entirely different thing' END,
        CASE WHEN doc_id % 2 = 0 THEN lang || '-' || doc_id END,
        CASE WHEN doc_id % 4 = 0 THEN path END], lambda x: x IS NOT NULL) AS targets FROM docs
), links AS (
    SELECT path, doc_id, target, pos, repeat('r', ((doc_id + pos) % 4)::INT) AS reason
    FROM (SELECT path, doc_id, unnest(targets) AS target, generate_subscripts(targets, 1) - 1 AS pos FROM listed)
)"""
VALID = f"""{STATES}, files AS (
    SELECT path, lang || '-' || doc_id || '.md' AS file, lang || '-' || doc_id AS stem FROM docs
), wanted AS (
    SELECT DISTINCT target, lower(string_split(target, '/')[-1]) AS low_name,
        regexp_replace(lower(string_split(target, '/')[-1]), '\\.md$', '') AS low_stem FROM links
), repaired AS (
    SELECT target, EXISTS (SELECT 1 FROM files WHERE path = target) AS exact,
        (SELECT min(path) FROM files WHERE file = target OR file = target || '.md') AS by_name,
        coalesce(
            (SELECT min(path) FROM files WHERE file = low_name), (SELECT min(path) FROM files WHERE stem = low_stem),
            (SELECT path FROM files WHERE levenshtein(stem, low_stem) <= 3 ORDER BY levenshtein(stem, low_stem), path LIMIT 1)
        ) AS by_fuzzy FROM wanted
), checked AS (
    SELECT path, doc_id, pos, target, reason, exact, by_name, by_fuzzy FROM links JOIN repaired USING (target)
), fixes AS (
    SELECT path, doc_id, pos, target, exact OR by_name IS NOT NULL AS fine,
        CASE WHEN exact THEN 'valid' WHEN coalesce(by_name, by_fuzzy) IS NOT NULL THEN 'fixed' ELSE 'removed' END AS status,
        CASE WHEN NOT exact THEN coalesce(by_name, by_fuzzy) END AS correction FROM checked
)"""

LINK_SQL = {
    "link_validate": f"""WITH {VALID} SELECT path, pos, target,
            CASE WHEN exact OR by_name IS NOT NULL THEN 'valid' WHEN by_fuzzy IS NOT NULL THEN 'fixable' ELSE 'invalid' END AS status,
            CASE WHEN NOT exact AND by_name IS NULL THEN by_fuzzy END AS correction FROM checked""",
    "link_validate_fix": f"WITH {VALID} SELECT path, pos, target, status, correction FROM fixes",
    "link_fuzzy": f"""WITH {VALID} SELECT target, by_name, CASE WHEN NOT exact AND by_name IS NULL THEN by_fuzzy END AS by_fuzzy FROM repaired""",
    "link_validation_counts": f"""WITH {VALID} SELECT count_if(fine) AS valid, count_if(status = 'removed') AS invalid,
            count_if(status = 'fixed') AS fixed, count_if(status = 'removed') AS removed FROM fixes""",
    "links_fixed": f"""WITH {VALID}, kept AS (
            SELECT path, string_agg(coalesce(correction, target), ',' ORDER BY pos) AS targets FROM fixes WHERE status <> 'removed' GROUP BY path)
        SELECT path, coalesce(targets, '') AS targets, targets IS NOT NULL AND doc_id % 4 = 0 AS links_applied FROM docs LEFT JOIN kept USING (path)""",
    "links_dedup": f"""WITH {STATES}, best AS (
            SELECT path, target, reason, min(pos) OVER (PARTITION BY path, target) AS first_pos FROM links
            QUALIFY row_number() OVER (PARTITION BY path, target ORDER BY length(reason) DESC, pos) = 1)
        SELECT path, row_number() OVER (PARTITION BY path ORDER BY first_pos) - 1 AS pos, target, reason FROM best""",
    "links_self_removed": f"""WITH {STATES} SELECT path, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS pos, target, reason
        FROM links WHERE target <> path""",
    "verdicts_merged": f"""WITH {STATES}, confirmed AS (
            SELECT CASE WHEN a.doc_id % 9 = 0 THEN 'new/' || a.doc_id || '.md' ELSE a.path END AS path, b.path AS target
            FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 6 = 0
        ), old AS (SELECT path, doc_id, string_agg(target, ',' ORDER BY pos) AS targets FROM links GROUP BY path, doc_id)
        SELECT path, concat_ws(',', targets, target) AS targets,
            CASE WHEN target IS NOT NULL THEN false ELSE doc_id % 4 = 0 END AS links_applied,
            CASE WHEN doc_id IS NOT NULL THEN 'h' END AS content_hash
        FROM old FULL JOIN confirmed USING (path)""",
}


# state


def pending_tags(spark, d):
    return S.pending_tags(tagged_states(spark, d)).select("path", F.array_join("proposed_tags", ",").alias("tags"))


def pending_links(spark, d):
    rows = S.pending_links(link_states(spark, d))
    return rows.select("path", F.array_join(F.transform("proposed_links", lambda x: x["target"]), ",").alias("targets"))


def state_summary(spark, d):
    return S.summary(link_states(spark, d))


def status_top10(spark, d):
    return S.first_notes(docs(spark, d).where("doc_id % 3 <> 1").select("path"))


def state_upsert(spark, d):
    """Even notes are processed again, and some new ones; places stay."""
    states = link_states(spark, d)
    again = docs(spark, d).where("doc_id % 2 = 0").select("path", "doc_id")
    new = again.where("doc_id % 10 = 0").select(F.concat(F.lit("new/"), "doc_id", F.lit(".md")).alias("path"), "doc_id")
    results = again.unionByName(new).select(
        "path", F.lit("h2").alias("content_hash"), F.array(F.lit("c")).alias("proposed_tags"), F.array().cast(f"array<{S.LINK}>").alias("proposed_links"), F.col("doc_id").alias("seq")
    )
    after = S.mark_processed(states, results, F.lit(1.0))
    return after.select("path", "ord", "content_hash", "processed_at", F.array_join("proposed_tags", ",").alias("tags"), F.size("proposed_links").alias("n_links"), "tags_applied", "links_applied")


def state_log_merged(spark, d):
    """A written log: all records, then three deltas of every second, third and fifth note, with pairs in
    each; the second makes earlier pairs void."""
    states = stash(link_states(spark, d), "log-base")
    store = Store(spark, f"{shared_dir(spark)}/tables/log-{uuid.uuid4().hex[:12]}")
    for k, every in enumerate((1, 2, 3, 5)):
        some = states.where(F.col("ord") % every == 0)
        pairs = some.select(F.col("path").alias("note_a"), F.lit(f"z{every}").alias("note_b"))
        store.append(some.withColumn("content_hash", F.lit(f"h{k}")), pairs, clear_pairs=every == 2, last_run=float(k))
    now = store.load()
    found = now.evaluated.groupBy("note_a").agg(F.array_join(F.array_sort(F.collect_list("note_b")), ",").alias("pairs"))
    rows = now.states.join(found, now.states["path"] == found["note_a"], "left")
    return rows.select("path", "ord", "content_hash", F.size("proposed_links").cast("long").alias("n_links"), "pairs", F.lit(now.last_run).alias("last_run"))


def state_applied(spark, d):
    done = docs(spark, d).where("doc_id % 5 = 1").select("path")
    return S.mark_applied(link_states(spark, d), done, "links_applied").select("path", "links_applied", "tags_applied")


def state_json_roundtrip(spark, d):
    """All records as the parts of a state file, and read again."""
    states = link_states(spark, d)
    pairs = states.where("ord % 7 = 0").select(F.col("path").alias("note_a"), F.concat(F.lit("z|"), "path").alias("note_b"))
    folder = f"{shared_dir(spark)}/tables/state-json-{uuid.uuid4().hex[:12]}"
    S.write_json(S.json_lines(states, pairs, 1.0), folder)
    again, evaluated, _ = S.read_json(spark, folder)
    rows = again.join(evaluated.withColumnRenamed("note_a", "path"), "path", "left")
    return rows.select("path", "ord", F.array_join(F.transform("proposed_links", lambda x: x["target"]), ",").alias("targets"), "tags_applied", "links_applied", "note_b")


STATE_SQL = {
    "state_json_roundtrip": f"""WITH {STATES} SELECT path, row_number() OVER (ORDER BY doc_id) - 1 AS ord, array_to_string(targets, ',') AS targets,
            doc_id % 3 = 0 AS tags_applied, doc_id % 4 = 0 AS links_applied, CASE WHEN doc_id % 7 = 0 THEN 'z|' || path END AS note_b FROM listed""",
    "pending_tags": f"""WITH {TAGGED} SELECT path, string_agg(tag, ',' ORDER BY tag_pos) AS tags FROM entries WHERE ord % 3 <> 0 GROUP BY path""",
    "pending_links": f"""WITH {STATES} SELECT path, string_agg(target, ',' ORDER BY pos) AS targets FROM links WHERE doc_id % 4 <> 0 GROUP BY path""",
    "state_summary": """SELECT count(*) AS total, count_if(doc_id % 3 <> 0) AS pending_tags, count_if(doc_id % 4 <> 0) AS pending_links FROM documents""",
    "status_top10": f"WITH {NOTES} SELECT path FROM docs WHERE doc_id % 3 <> 1 ORDER BY string_split(path, '/') LIMIT 10",
    "state_upsert": f"""WITH {STATES}, top AS (SELECT max(doc_id) AS last FROM docs)
        SELECT path, doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN 'h2' ELSE 'h' END AS content_hash,
            CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS processed_at, CASE WHEN doc_id % 2 = 0 THEN 'c' ELSE 'b,a' END AS tags,
            CASE WHEN doc_id % 2 = 0 THEN 0 ELSE len(targets) END AS n_links,
            doc_id % 2 <> 0 AND doc_id % 3 = 0 AS tags_applied, doc_id % 2 <> 0 AND doc_id % 4 = 0 AS links_applied FROM listed
        UNION ALL SELECT 'new/' || doc_id || '.md', last + 1 + doc_id, 'h2', 1.0, 'c', 0, false, false FROM docs, top WHERE doc_id % 10 = 0""",
    "state_log_merged": f"""WITH {STATES} SELECT path, doc_id AS ord, 'h' || CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2
            WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS content_hash, len(targets) AS n_links, nullif(array_to_string(list_filter(
            [CASE WHEN doc_id % 2 = 0 THEN 'z2' END, CASE WHEN doc_id % 3 = 0 THEN 'z3' END, CASE WHEN doc_id % 5 = 0 THEN 'z5' END],
            lambda x: x IS NOT NULL), ','), '') AS pairs, 3.0::DOUBLE AS last_run FROM listed""",
    "state_applied": f"""WITH {NOTES} SELECT path, doc_id % 5 = 1 OR doc_id % 4 = 0 AS links_applied, doc_id % 3 = 0 AS tags_applied FROM docs""",
}


# rewrites


def fronted(rows: DataFrame) -> DataFrame:
    """Notes with five kinds of frontmatter, by number."""
    kind = F.col("doc_id") % 5
    head = (
        F.when(kind == 0, F.concat(F.lit("---\ntags: [\"c\", 'b' , "), "source", F.lit("]\n---\n")))
        .when(kind == 1, F.lit("---\nkey: value\n---\n"))
        .when(kind == 2, F.lit("---\ntags:\n  - c\n---\n"))
        .when(kind == 3, F.lit("---\nopen "))
        .otherwise(F.lit(""))
    )
    return rows.withColumn("content", F.concat(head, F.replace("content", F.lit("---"), F.lit("=="))))


FRONTED = f"""{NOTES}, fronted AS (
    SELECT doc_id, lang, source, path, CASE doc_id % 5
        WHEN 0 THEN '---' || chr(10) || 'tags: ["c", ''b'' , ' || source || ']' || chr(10) || '---' || chr(10)
        WHEN 1 THEN '---' || chr(10) || 'key: value' || chr(10) || '---' || chr(10)
        WHEN 2 THEN '---' || chr(10) || 'tags:' || chr(10) || '  - c' || chr(10) || '---' || chr(10)
        WHEN 3 THEN '---' || chr(10) || 'open ' ELSE '' END AS head, replace(content, '---', '==') AS body FROM docs
)"""


def rewrite_tags(spark, d):
    pending = S.pending_tags(link_states(spark, d))
    return R.plan_tags(fronted(docs(spark, d)), pending).select("path", F.sha2("new_content", 256).alias("sha"))


def rewrite_links(spark, d):
    rows = docs(spark, d)
    headed = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("## Related Notes\n- x\n"), "content", F.lit("\n\n"))).otherwise(F.col("content"))
    plan = R.plan_links(rows.withColumn("content", headed), S.pending_links(link_states(spark, d)))
    return plan.select("path", F.sha2("new_content", 256).alias("sha"))


def edits(rows: DataFrame, operation: str, target: Column) -> DataFrame:
    return rows.select("path", F.lit(operation).alias("operation"), F.concat(F.lit("note "), "doc_id").alias("content"), target.alias("target"))


def edit_append(spark, d):
    rows = docs(spark, d)
    done = R.edited(rows, edits(rows, "append", F.lit("")).unionByName(edits(rows, "prepend", F.lit(""))))
    return done.select("path", "operation", F.sha2("new_content", 256).alias("sha"))


def edit_replace_first(spark, d):
    rows = docs(spark, d)
    done = R.edited(rows, edits(rows, "replace", F.lit(" de ")))
    return done.select("path", F.sha2("new_content", 256).alias("sha"), "error")


def planned_edits(notes: DataFrame) -> DataFrame:
    """Two to four edits of every note, not in their order; those of every third note on an older text."""
    one = lambda seq, operation, content, target="": F.struct(
        F.lit(seq).cast("long").alias("seq"), F.lit(operation).alias("operation"), content.alias("content"), F.lit(target).alias("target")
    )
    number, even = F.col("doc_id").cast("string"), F.col("doc_id") % 2 == 0
    planned = F.array(
        one(3, "append", F.concat(F.lit("end "), number)),
        one(1, "replace", F.concat(F.lit(" DE "), number), " de "),
        F.when(even, one(2, "replace", F.lit("twice"), " DE ")),
        F.when(even, one(4, "prepend", F.lit("top"))),
    )
    base = F.when(F.col("doc_id") % 3 == 0, F.lit("older")).otherwise(F.col("content_hash"))
    rows = notes.withColumn("e", F.explode(F.array_compact(planned)))
    return rows.select("path", "e.seq", F.lit("").alias("tie"), "e.operation", "e.content", "e.target", base.alias("base_hash"))


def edit_log_replayed(spark, d):
    notes = Q.hashed(docs(spark, d))
    found = replayed(notes, planned_edits(notes))
    errors = F.array_join(F.transform("failed", lambda x: F.concat_ws(":", x["seq"], x["error"])), ",")
    return found.select("path", F.sha2("new_content", 256).alias("sha"), "n_applied", errors.alias("errors"))


REWRITE_SQL = {
    "edit_log_replayed": f"""WITH {NOTES}, found AS (
            SELECT *, strpos(content, ' de ') AS spot, doc_id % 2 = 0 AS even, doc_id % 3 = 0 AS old FROM docs
        ), replaced AS (
            SELECT *, CASE WHEN spot > 0 THEN substr(content, 1, spot - 1) || ' DE ' || doc_id || substr(content, spot + 4) ELSE content END AS one FROM found
        ), again AS (
            SELECT *, strpos(one, ' DE ') AS spot2 FROM replaced
        ), ended AS (
            SELECT *, (CASE WHEN even AND spot2 > 0 THEN substr(one, 1, spot2 - 1) || 'twice' || substr(one, spot2 + 4) ELSE one END)
                || chr(10) || 'end ' || doc_id AS two FROM again
        )
        SELECT path, CASE WHEN NOT old THEN sha256(CASE WHEN even THEN 'top' || chr(10) || two ELSE two END) END AS sha,
            CASE WHEN old THEN 0 ELSE 1 + (spot > 0)::BIGINT + (even AND spot2 > 0)::BIGINT + even::BIGINT END::BIGINT AS n_applied,
            array_to_string(list_filter(CASE WHEN old THEN list_filter([1, CASE WHEN even THEN 2 END, 3, CASE WHEN even THEN 4 END], lambda x: x IS NOT NULL)
                .list_transform(lambda x: x || ':note changed since')
                ELSE [CASE WHEN spot = 0 THEN '1:target not found' END, CASE WHEN even AND spot2 = 0 THEN '2:target not found' END] END,
                lambda x: x IS NOT NULL), ',') AS errors
        FROM ended""",
    "rewrite_tags": f"""WITH {FRONTED} SELECT path, sha256(CASE doc_id % 5
            WHEN 0 THEN '---' || chr(10) || 'tags: [' || array_to_string(list_sort(list_distinct(['a', 'b', 'c', source])), ', ') || ']' || chr(10) || '---' || chr(10) || body
            WHEN 1 THEN '---' || chr(10) || 'key: value' || chr(10) || 'tags: [a, b]' || chr(10) || '---' || chr(10) || body
            WHEN 2 THEN '---' || chr(10) || 'tags:' || chr(10) || '  - c' || chr(10) || 'tags:' || chr(10) || '  - a' || chr(10) || '  - b' || chr(10) || '---' || chr(10) || body
            ELSE '---' || chr(10) || 'tags: [a, b]' || chr(10) || '---' || chr(10) || head || body END) AS sha
        FROM fronted WHERE doc_id % 3 <> 0""",
    "rewrite_links": f"""WITH {STATES}, rows AS (
            SELECT path, string_agg('- [[' || replace(target, '.md', '') || ']]' || CASE WHEN reason <> '' THEN ' — ' || reason ELSE '' END,
                chr(10) ORDER BY pos) AS body FROM links WHERE doc_id % 4 <> 0 GROUP BY path)
        SELECT path, sha256(CASE WHEN doc_id % 2 = 1
            THEN rtrim('## Related Notes' || chr(10) || '- x' || chr(10) || content, chr(10) || chr(32)) || chr(10)
            ELSE rtrim(content, chr(10) || chr(32)) || chr(10) || chr(10) || '## Related Notes' || chr(10) END || body) AS sha
        FROM docs JOIN rows USING (path)""",
    "edit_append": f"""WITH {NOTES} SELECT path, 'append' AS operation, sha256(content || chr(10) || 'note ' || doc_id) AS sha FROM docs
        UNION ALL SELECT path, 'prepend', sha256('note ' || doc_id || chr(10) || content) FROM docs""",
    "edit_replace_first": f"""WITH {NOTES}, found AS (SELECT *, strpos(content, ' de ') AS spot FROM docs)
        SELECT path, CASE WHEN spot > 0 THEN sha256(substr(content, 1, spot - 1) || 'note ' || doc_id || substr(content, spot + 4)) END AS sha,
            CASE WHEN spot = 0 THEN 'target not found' END AS error FROM found""",
}


# model replies, the vault source


def enrich_mapinpandas(spark, d):
    notes = Q.hashed(docs(spark, d).select("path", "content"))
    replies = stash(E.enriched(notes, E.FrequentWords()), "replies")
    return E.parsed_replies(replies).where("size(proposed_tags) > 0").select("path", F.array_join("proposed_tags", ",").alias("tags"))


def parse_replies(spark, d):
    """Well and badly formed replies, by number."""
    kind = F.col("doc_id") % 6
    good = F.concat(F.lit('{"tags": ["'), "lang", F.lit('"], "links": []}'))
    reply = (
        F.when(kind == 0, good)
        .when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 2, F.lit("{}"))
        .when(kind == 3, F.lit("no JSON"))
        .when(kind == 4, F.lit("[1]"))
        .otherwise(F.concat(F.lit("  "), good, F.lit("  ")))
    )
    parsed = E.parsed_replies(docs(spark, d).select("path", reply.alias("reply")))
    return parsed.select("path", "ok", F.array_join("proposed_tags", ",").alias("tags"))


def parse_verdicts(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("true", "false", '"false"', '""', "1", "0", "null"))), (F.col("doc_id") % 7 + 1).cast("int"))
    reply = F.concat(F.lit('{"should_link": '), said, F.lit(', "reason": "r", "link_to": "'), "path", F.lit('"}'))
    parsed = E.parsed_verdicts(docs(spark, d).select("path", reply.alias("reply")))
    return parsed.select("path", "confirmed", "reason", "link_to")


def judged_pairs(spark: SparkSession, d: str) -> DataFrame:
    states = tagged_states(spark, d)
    pairs = T.shared_tag_pairs(T.tag_index(states), MIN_SHARED, CAP)
    replies = stash(E.verified(pairs, docs(spark, d), states, E.SharedTags(3)), "verdicts")
    return E.parsed_verdicts(replies)


def pairs_verified(spark, d):
    return judged_pairs(spark, d).select("note_a", "note_b", "confirmed", "reason", "link_from", "link_to")


def discovery_counts(spark, d):
    rows = judged_pairs(spark, d)
    return rows.agg(F.count("*").alias("candidates"), F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("skipped"))


def read_note(spark, d):
    rows = docs(spark, d)
    return Q.read_note(rows, rows.orderBy("doc_id").first()["path"])


def note_metadata(spark, d):
    rows = Q.metadata(fronted(docs(spark, d)))
    return rows.select("path", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("keys"), F.array_join("tags", ",").alias("tags"))


def vault_roundtrip(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Writes notes as files in a folder of their own, reads them back as a vault, and edits them
    there. Only where the shared folder is one of the local file system."""
    root = shared_dir(spark).removeprefix("file:") + f"/vault-{uuid.uuid4().hex}"

    def put(batches):
        made = set()
        for batch in batches:
            for path, text in zip(batch["path"], batch["content"]):
                folder = os.path.dirname(f"{root}/{path}")
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(f"{root}/{path}", "w", encoding="utf-8", newline="") as file:
                    file.write(text)
            yield batch[["path"]]

    rows.select("path", "content").mapInPandas(put, "path string").count()
    plan = read_vault(spark, root).select("path", F.concat("content", F.lit("\nend")).alias("new_content"))
    write_edits(stash(plan, "edits"), root)
    found = stash(read_vault(spark, root).select("path", "content_hash"), "vault-hashes")
    drop_vault(found, root)
    return found


def vault_source_roundtrip(spark, d):
    return vault_roundtrip(spark, docs(spark, d))


MODEL_SQL = {
    "enrich_mapinpandas": f"WITH {TAGGED} SELECT path, string_agg(tag, ',' ORDER BY tag_pos) AS tags FROM entries GROUP BY path",
    "parse_replies": f"""WITH {NOTES} SELECT path, doc_id % 6 IN (0, 1, 5) AS ok, CASE WHEN doc_id % 6 IN (0, 1, 5) THEN lang ELSE '' END AS tags FROM docs""",
    "parse_verdicts": f"WITH {NOTES} SELECT path, doc_id % 7 IN (0, 2, 4) AS confirmed, 'r' AS reason, path AS link_to FROM docs",
    "pairs_verified": f"""WITH {PAIRS} SELECT note_a, note_b, n_shared >= 3 AS confirmed, 'shared tags: ' || replace(shared, ',', ', ') AS reason,
            note_a AS link_from, note_b AS link_to FROM pairs""",
    "discovery_counts": f"""WITH {PAIRS} SELECT count(*) AS candidates, count_if(n_shared >= 3) AS confirmed, count_if(n_shared < 3) AS skipped FROM pairs""",
    "read_note": f"WITH {NOTES} SELECT path, content FROM docs ORDER BY doc_id LIMIT 1",
    "note_metadata": rf"""WITH {FRONTED} SELECT path, CASE WHEN doc_id % 5 IN (0, 2) THEN 'tags' WHEN doc_id % 5 = 1 THEN 'key' ELSE '' END AS keys,
            array_to_string(list_sort(list_distinct(regexp_extract_all(head || body, '(?:^|\s)#([a-zA-Z][\w/-]*)', 1))), ',') AS tags FROM fronted""",
    "vault_source_roundtrip": f"""WITH {NOTES} SELECT path, substr(sha256(content || chr(10) || 'end'), 1, 16) AS content_hash FROM docs""",
}

ORACLES = SCAN_SQL | TEXT_SQL | TAG_SQL | LINK_SQL | STATE_SQL | REWRITE_SQL | MODEL_SQL
QUERIES = {name: globals()[name] for name in ORACLES}
