"""Note text as Column expressions: hashing, links, tags, frontmatter, lines, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that define the note format. (?U) makes \w and \s cover Unicode.
LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
INLINE_TAG = r"(?U)(?:^|\s)#([a-zA-Z][\w/-]*)"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
TRIM = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
RIGHT_TRIM = r"(?U)[\s\x1c-\x1f]+$"
SUFFIX = r"(?s)(?<=.)\.[^.]+$"
FENCE = "```"
MARK = "---"
PREVIEW_CHARS = 500


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value being worked out once: beside and inside functions of elements, an expression that is
    named twice is worked out twice, and one inside them for each element."""
    return F.transform(F.array(value), then)[0]


def trim(text: Column) -> Column:
    return F.regexp_replace(text, TRIM, "")


def right_trim(text: Column) -> Column:
    return F.regexp_replace(text, RIGHT_TRIM, "")


def content_hash(content: Column) -> Column:
    """The first 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(F.encode(content, "UTF-8"), 256), 1, 16)


def outgoing_links(content: Column) -> Column:
    """Targets of wiki-links in order, repeats included."""
    return F.regexp_extract_all(content, F.lit(LINK), F.lit(1))


def inline_tags(content: Column) -> Column:
    """Distinct #tags, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(INLINE_TAG), F.lit(1))))


def lines(content: Column) -> Column:
    """The lines of a text; no empty line after a final line end, none at all in an empty text."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(content == "", F.array().cast("array<string>")).otherwise(once(F.split(content, LINE_END, -1), whole))


def frontmatter_end(content: Column) -> Column:
    """1-based place of the closing mark, which may stand anywhere after the opening one; null
    without frontmatter."""
    at = F.locate(MARK, content, 4)
    return F.when(content.startswith(MARK) & (at > 0), at)


def frontmatter_text(content: Column) -> Column:
    end = frontmatter_end(content)
    return F.when(end.isNotNull(), F.substring(content, F.lit(4), end - 4))


def frontmatter(content: Column) -> Column:
    """A map of the `key: value` lines, split at the first colon; of repeated keys the last counts.
    Empty without frontmatter."""
    pair = lambda x: F.struct(
        trim(F.substring_index(x, ":", 1)).alias("key"), trim(F.regexp_replace(x, r"(?s)^[^:]*:", "")).alias("value")
    )
    rows = lambda text: F.filter(lines(trim(text)), lambda x: x.contains(":"))
    # a pair stays if its key does not come again after it
    last = lambda pairs, keys: F.filter(
        pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), p["key"])
    )
    found = lambda pairs: F.map_from_entries(once(F.transform(pairs, lambda p: p["key"]), lambda keys: last(pairs, keys)))
    fields = once(frontmatter_text(content), lambda text: once(F.transform(rows(text), pair), found))
    return F.coalesce(fields, F.create_map().cast("map<string,string>"))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(name(path), SUFFIX, "")


def sort_key(path: Column) -> Column:
    """Orders paths by components: a/b.md before a-b.md."""
    return F.split(path, "/")


def preview(content: Column) -> Column:
    return F.substring(content, 1, PREVIEW_CHARS)


def is_hidden(path: Column) -> Column:
    """Whether the file name (not a folder) starts with a full stop."""
    return name(path).startswith(".")


def without_fence(reply: Column) -> Column:
    """A reply without the lines of a code fence, if it starts with one."""
    text = trim(reply)
    kept = F.filter(lines(text), lambda x: ~trim(x).startswith(FENCE))
    return F.when(text.startswith(FENCE), F.array_join(kept, "\n")).otherwise(text)


def link_title(target: Column) -> Column:
    return F.replace(target, F.lit(".md"), F.lit(""))
