from __future__ import annotations

import pytest

#: Null, empty, blank, copied, near-copied, long and foreign texts, with a null source and a null language.
LONG = " ".join(f"w{i % 997} x{i}." for i in range(30_000))
BASE = "The quick brown fox jumps over the lazy dog near the old river bank. It was a bright cold day in April and the clocks were striking. Nobody knew why the harbour had been closed for so long that year."


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (0, BASE, "en", "a", "x"),
        (1, BASE, "en", "a", "x"),
        (2, BASE.replace("lazy", "idle"), "en", "b", "y"),
        (3, None, None, None, None),
        (4, "", "en", "b", ""),
        (5, " \n\t ", "en", "b", None),
        (6, LONG, "en", "c", "z"),
        (7, "über die Straße ging der alte Mann mit dem Hund. Er war müde.", "de", "c", "z"),
        (8, "日本語のテキスト。 emoji 🙂🙂 \U0001d400", "ja", "c", "z"),
        (9, "a\nb\na\n\nc", "en", None, "z"),
        (10, "...!!! 123 456", "en", "a", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, id string").selectExpr("*", "0 as rank", "'q' as h", "1 as copies", "2 as fp", "'s' as size")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
