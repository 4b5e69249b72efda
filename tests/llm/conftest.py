import pytest
from llm_texts import prose

AWKWARD = [
    None,
    "",
    " \t\n\x0b\f\r ",
    "one",
    "two words",
    "l'été, 日本語 😀 <|endoftext|> don't stop \x1c x",
    "a" * 3000,
    "same line here\n" * 40,
    "1" * 2000 + " " + "1.2.3.4 " * 50,
    " ".join(f"word{i % 97}" for i in range(20_000)),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and ties, and columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", "x", 1, 2, [3]) for i, t in enumerate(AWKWARD)]
    rows += rows[3:6] + [(None, "no id here", None, None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, id string, digest int, size int, h array<int>"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    """Prose with exact copies, near copies and a hot source."""
    texts = [prose(i, 30 + 11 * (i % 9)) for i in range(120)]
    texts += [texts[3]] * 5 + [texts[4] + " end."] + [texts[5].replace(texts[5].split()[7], "changed", 1)]
    rows = [(i, t, f"s{0 if i % 3 else i % 7}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")
