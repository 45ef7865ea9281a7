import pytest

LONG = " ".join(f"word{k % 977} and{k % 31}." for k in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank. It ran away quickly, then it slept."),
    (2, None),
    (3, ""),
    (4, "   \t\n "),
    (5, "THE quick  brown\tfox jumps over the lazy dog near the old river bank. It ran away quickly, then it slept."),
    (6, "short"),
    (7, "short"),
    (8, "ééé ñandú größer 漢字 🙂 <|endoftext|> <|im_end|>"),
    (9, LONG),
    (10, "x" * 70_000),
    (None, "short"),
    (None, "no id at all"),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank. It ran away quickly, then it slept."),
    (1, "the same id with another text"),
    (12, "a b c"),
    (13, "A B C"),
]
#: Names that operators use inside or add.
EXTRA = ["id", "score", "kept", "keep_id", "group_size", "text_sha256", "component_id", "spans", "n_bytes", "held", "label", "block", "_text", "_maybe", "key", "rep", "comp"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank and long texts, repeated rows and ids, and columns with clashing names."""
    names = ", ".join(f"`{c}` string" for c in EXTRA)
    rows = [(k, t, None if k == 7 else "en", "s", None, *(["y"] * len(EXTRA))) for k, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(3, "text")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
