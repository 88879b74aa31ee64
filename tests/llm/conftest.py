import pytest

#: Names that operators use inside; tables may have such columns too.
CLASHING = ["id", "row", "sha", "key", "size", "gid", "kind", "rank", "path", "count", "shard", "root", "n", "first", "c0", "host", "x", "start", "_row", "piece", "kept", "length", "language", "held_out", "score"]

LONG = "Longword" + "ab" * 60_000
SPACES = " " * 50_000
SENTENCE = "the quick brown fox jumps over the lazy dog and runs away from all of them at once "

ROWS = [
    (1, "Copied text  here, with\ttabs.", "en", "s1"),
    (2, "Copied text here, with tabs.", "en", "s1"),
    (2, "Copied text here, with tabs.", "en", "s1"),  # a repeated row
    (3, None, None, None),
    (4, "", "en", None),
    (5, "   \n\t ", None, "s2"),
    (None, "Copied text here, with tabs.", "en", "s1"),
    (None, None, None, None),
    (6, LONG, "en", "s3"),
    (7, SENTENCE * 300, "en", "s3"),
    (8, SENTENCE * 300 + "and one more", "en", "s3"),
    (9, SPACES, "en", "s3"),
    (10, "é ñ ü 中文 😀 \x00 \x1c <|endoftext|>", "fr", "s4"),
    (11, "short", "en", "s4"),
    (12, "Short!", "en", "s4"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity, and many columns of clashing names."""
    rows = [(*r, len(r[1] or ""), *[f"x{i}"] * len(CLASHING)) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
