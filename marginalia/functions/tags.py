"""Tag stems and their similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

# Word forms that share a stem (the first of each), and prefixes of rank.
WORD_FORMS = (
    ("manager", "management"),
    ("engineer", "engineering"),
    ("designer", "design"),
    ("developer", "development"),
    ("analyst", "analytics", "analysis"),
    ("architect", "architecture"),
    ("scientist", "science"),
    ("consultant", "consulting"),
    ("strategist", "strategy"),
    ("leader", "leadership"),
    ("coordinator", "coordination"),
    ("director", "direction"),
    ("operator", "operations"),
    ("administrator", "administration"),
    ("automate", "automation", "automated"),
    ("optimize", "optimization", "optimized"),
    ("integrate", "integration", "integrated"),
    ("collaborate", "collaboration", "collaborative"),
    ("communicate", "communication"),
    ("negotiate", "negotiation"),
    ("innovate", "innovation", "innovative"),
    ("transform", "transformation"),
    ("implement", "implementation"),
    ("migrate", "migration"),
    ("visualize", "visualization"),
)
RANKS = r"^(senior-|sr-|junior-|jr-|lead-|head-of-|head-|vp-|chief-|principal-|staff-|associate-)"

THRESHOLD = 2


def stem_tag(tag: Column) -> Column:
    """Lower case, one prefix of rank less, each part in its first form."""
    forms = F.create_map(*[F.lit(x) for first, *others in WORD_FORMS for other in others for x in (other, first)])
    parts = F.split(F.regexp_replace(F.lower(tag), RANKS, ""), "-")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(forms, p), p)), "-")


def are_similar(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Whether two stems are close: at most threshold edits, fewer in short stems; stems of as many
    parts part by part, others by the share of edits."""
    # -1 beyond the threshold
    edits = F.levenshtein(a, b, threshold)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    parts_a, parts_b = F.split(a, "-"), F.split(b, "-")
    by_part = F.forall(
        F.zip_with(
            parts_a,
            parts_b,
            lambda p, q: F.when(F.greatest(F.char_length(p), F.char_length(q)) <= 3, p == q).otherwise(F.levenshtein(p, q, 1) >= 0),
        ),
        lambda ok: ok,
    )
    same_shape = (F.size(parts_a) == F.size(parts_b)) & (F.size(parts_a) > 1)
    return (
        F.when(edits < 0, False)
        .when(longest <= 3, edits == 0)
        .when(longest <= 5, edits <= 1)
        .when(same_shape, by_part)
        .otherwise(edits / longest < 0.2)
    )


def frequent_words(content: Column, most: int = 6, least_chars: int = 7) -> Column:
    """A text's most frequent long words, ties by word, as operators.tags.deterministic_tags has them for a note:
    within the row, so that no word is shuffled. Empty without such words."""
    # words end at white space alone: other signs inside them go first
    letters = F.regexp_replace(F.lower(content), r"[^a-z\s]+", "")
    words = F.array_sort(F.regexp_extract_all(letters, F.lit(f"[a-z]{{{least_chars},}}"), F.lit(0)))
    # in sorted words each one's count is from its first place to the next one's
    first = lambda w: F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
    entry = lambda w, at: lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), F.size(w))).alias("rank"), F.get(w, i).alias("tag"))
    ranked = lambda w: once(first(w), lambda at: F.slice(F.array_sort(F.transform(at, entry(w, at))), 1, most))
    tags = F.transform(once(words, ranked), lambda x: x["tag"])
    return F.coalesce(tags, F.array().cast("array<string>"))
