"""One query for each operator over a whole table, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, exact, language, licences, media, near, packing, quality, suffix, tokens, toxicity
from .common import documents, remainder


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def scored(rows: DataFrame, threshold: float) -> DataFrame:
    held_out = (remainder(4) == 2).alias("held_out")
    return rows.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, "quality")
    return scored(quality.quality_scores(docs, model, carry=["doc_id"]), 0.7)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(documents(spark, sf_dir).select("doc_id", "text"), digests=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = tokens.bpe_round_trip(documents(spark, sf_dir))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_columns(documents(spark, sf_dir))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, "toxic")
    return scored(toxicity.toxicity_scores(docs, model, carry=["doc_id"]), 0.3)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(documents(spark, sf_dir), n_words=4)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_spans(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_scores(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licence_scan(documents(spark, sf_dir), carry=["doc_id"]).drop("places")
    return found.withColumn("score", F.round("score", 6))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_chat,
        op3_quality,
        op4_exact_dedup,
        op5_byte_bpe,
        op6_media,
        op7_toxicity,
        op8_minhash,
        op9_suffix_dedup,
        op10_language,
        op11_filter_audit,
        op12_license_scan,
    )
}

#: The notices that op12_license_scan looks for, as a table of their words.
NOTICE_SQL = ", ".join(
    f"({k}, '{n.label}', {n.base}, {n.share - 1e-9!r}, {n.words!r}, {[f' {key} ' for key in n.keys]!r}::VARCHAR[])"
    for k, n in enumerate(licences.BASE + licences.NOTICES)
)

ORACLES = {
    "op2_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS place
            FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
        ), whole AS (
            SELECT conv_id, count(*) AS n_turns, list(struct_pack(r := role, t := text) ORDER BY place) AS said,
                string_agg(
                    '<|im_start|>' || role || chr(10)
                    || regexp_replace(text, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || '<|im_end|>' || chr(10),
                    '' ORDER BY place
                ) AS rendered
            FROM turns GROUP BY conv_id
        ), begun AS (
            SELECT DISTINCT w.said[1:k] AS said FROM whole w, LATERAL unnest(range(1, n_turns)) AS u(k)
        )
        SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, any_value(rendered) AS rendered
        FROM whole WHERE said NOT IN (SELECT said FROM begun)
        GROUP BY said, n_turns
    """,
    "op4_exact_dedup": r"""
        WITH hashed AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        ), grouped AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM hashed JOIN grouped USING (text_sha256)
    """,
    "op8_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'
            ), lambda x: x <> '') AS w FROM documents
        ), shingles AS (
            SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s
            FROM words
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
        ), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reached AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reached r JOIN ways w ON w.a = r.b
        ), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """,
    "op9_suffix_dedup": r"""
        WITH bytes AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents
        ), windows AS (
            SELECT doc_id, p, hash(substr(h, 2 * p + 1, 100)) AS w FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49)) AS p FROM bytes)
        ), later AS (
            SELECT doc_id, p FROM windows JOIN (SELECT w, min(doc_id) AS least FROM windows GROUP BY w HAVING count(*) > 1) USING (w)
            WHERE doc_id > least
        ), marked AS (
            SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM later
        ), numbered AS (
            SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked
        ), spans AS (
            SELECT doc_id, k, min(p) AS start, max(p) + 50 AS stop FROM numbered GROUP BY doc_id, k
        ), gaps AS (
            SELECT doc_id, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS start, start AS stop FROM spans
            UNION ALL SELECT doc_id, coalesce(max(stop), 0), n_bytes FROM bytes LEFT JOIN spans USING (doc_id) GROUP BY doc_id, n_bytes
        ), kept AS (
            SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start))) AS kept_sha256
            FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
        ), counts AS (SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
        SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
        FROM bytes JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
    """,
    "op11_filter_audit": r"""
        WITH words AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), copies AS (SELECT t, min(doc_id) AS least FROM words GROUP BY t), failed AS (
            SELECT doc_id, part,
                CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
            FROM words JOIN copies USING (t)
        ), known AS (
            SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
            FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ), counted AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
            FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, fails
        ), letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
        ), steps AS (
            SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before
            FROM orders, (SELECT unnest(range(1, 6)) AS step)
        ), stepped AS (
            SELECT part, filter_order, step, own, n, n_good, n_toxic, fails = own AS alone,
                contains(fails, own) AS hit, translate(fails, before, '') <> fails AS gone
            FROM counted, steps
        ), summed AS (
            SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN gone AND hit THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN NOT gone AND hit THEN n_good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN NOT gone AND hit THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM stepped GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
        FROM summed
    """,
    "op12_license_scan": rf"""
        WITH notices(k, label, base, least, own, keys) AS (VALUES {NOTICE_SQL}), numbered AS (
            SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), words AS (
            SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM numbered
        ), places AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM words),
        templates AS (SELECT k, unnest(own) AS word, generate_subscripts(own, 1) - 1 AS place FROM notices),
        held AS (SELECT word, count(DISTINCT r) AS n FROM places GROUP BY word), weighed AS (
            SELECT k, word, place, 1 + ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1)) AS weight
            FROM templates LEFT JOIN held USING (word)
        ), shares AS (SELECT k, word, place, weight / sum(weight) OVER (PARTITION BY k) AS share FROM weighed), met AS (
            SELECT r, k, pos - place AS start, sum(share) AS share FROM places JOIN shares USING (word) GROUP BY ALL
        ), found AS (
            SELECT r, start, label, base, least(share, 1.0) AS share FROM met JOIN notices USING (k) JOIN words USING (r)
            WHERE share >= least AND len(list_filter(keys, lambda key: NOT contains(
                ' ' || array_to_string(w[greatest(start, 0) + 1:start + len(own)], ' ') || ' ', key))) = 0
        ), summed AS (
            SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
            FROM found GROUP BY r
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
            coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
        FROM words LEFT JOIN summed USING (r)
    """,
}
