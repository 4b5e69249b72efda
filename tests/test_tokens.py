"""Tokens of each language family, and highlights at points, against expected values and a loop."""

import random

import pytest
from pyspark.sql import functions as F

from changelens.operators import source_code as K
from changelens.operators.barrier import bind
from changelens.schemas import FILES


def cut(spark, language, *texts):
    frame = spark.createDataFrame([(i, t, language) for i, t in enumerate(texts)], "i int, c string, language string")
    rows = frame.select("i", K.tokens("c", "language").alias("t")).orderBy("i").collect()
    for text, row in zip(texts, rows):
        assert "".join(row.t) == text
    return [r.t for r in rows]


def test_comments_nest_in_rust_only(spark):
    nested = "/* a /* b /* c */ d */ e */"
    assert cut(spark, "rust", nested + "x")[0] == [nested, "x"]
    assert cut(spark, "rust", "/* a / * ** // /* b */ x */y")[0] == ["/* a / * ** // /* b */ x */", "y"]
    assert cut(spark, "rust", "/* a /* b */ open")[0] == ["/* a /* b */ open"]
    assert cut(spark, "java", nested)[0][:2] == ["/* a /* b /* c */", " "]
    deep = "/*" * K.NESTED_COMMENTS + "*/" * K.NESTED_COMMENTS
    assert cut(spark, "rust", deep + "z")[0] == [deep, "z"]


@pytest.mark.parametrize(
    "language, text, expected",
    [
        ("rust", 'r#"a " b"# x', ['r#"a " b"#', " ", "x"]),
        ("rust", 'br##"a "# b"##;', ['br##"a "# b"##', ";"]),
        ("rust", 'r"\\" + bar', ['r"\\"', " ", "+", " ", "bar"]),
        ("rust", "for r in 'a", ["for", " ", "r", " ", "in", " ", "'", "a"]),
        ("cpp", 'R"x(a )" b)x" y', ['R"x(a )" b)x"', " ", "y"]),
        ("cpp", 'u8R"(\n")" y', ['u8R"(\n")"', " ", "y"]),
        ("cpp", 'BAR"x"', ["BAR", '"x"']),
        ("java", '"""a "b" \\""" c""" d', ['"""a "b" \\""" c"""', " ", "d"]),
        ("java", '"" + ""', ['""', " ", "+", " ", '""']),
        ("zig", "\\\\ one \"two\n\\\\ three\n;", ['\\\\ one "two', "\n", "\\\\ three", "\n", ";"]),
        ("go", "`raw \\` + 'x'", ["`raw \\`", " ", "+", " ", "'x'"]),
        ("python", "'''a\n'b''' # c", ["'''a\n'b'''", " ", "# c"]),
        ("javascript", "`a\n\\` b` c", ["`a\n\\` b`", " ", "c"]),
    ],
)
def test_strings(spark, language, text, expected):
    assert cut(spark, language, text)[0] == expected
    frame = spark.createDataFrame([(t, language) for t in expected], "t string, l string")
    shown = {r.t: r.h for r in frame.select("t", K.token_highlight(F.col("t"), F.col("l")).alias("h")).collect()}
    first = next(t for t in expected if any(q in t for q in "\"'`") or t.startswith("\\\\")) if language != "rust" or "for" not in text else None
    assert first is None or shown[first] == "string"


def test_long_literals_do_not_exhaust_the_stack(spark):
    for language in ("rust", "cpp", "java"):
        comment = "/*" + "* / ** x/y " * 60_000 + "*/"
        assert cut(spark, language, comment + "z")[0][-1] == "z"
    assert cut(spark, "rust", 'r#"' + '" / ' * 100_000 + '"#z')[0][-1] == "z"
    assert cut(spark, "java", '"""' + '" \\" ' * 100_000 + '"""z')[0][-1] == "z"
    assert cut(spark, "rust", "/*" + "/* x */ " * 50_000 + "*/z")[0][-1] == "z"


def test_highlights_at_points_match_the_loop(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(['fn ', '"s" ', "// é\n", "12", " x", "(", "r#\"q\"#"]) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    files = spark.createDataFrame([(f"{i}.rs", "rust", "changed", False, "", t, None) for i, t in enumerate(texts)], FILES)
    spans = {}
    for r in K.highlight_spans(files).collect():
        spans.setdefault(r.path, []).append(r)
    df = bind(K.with_spans(files), points=F.expr("transform(sequence(0, 60), x -> cast((x * 37) % 67 - 2 as bigint))"))
    rows = K.highlights_at(df).collect()
    assert len(rows) == 61 * 40
    for r in rows:
        expected = [s.highlight for s in spans.get(r.path, []) if s.start_byte <= r.byte_at < s.end_byte]
        assert r.highlight == (expected[0] if expected else None)


def test_pieces_hold_the_comments_and_strings_of_the_tokens(spark):
    """On random text of each family the comments and strings are the same, at the same places, in fewer parts."""
    rnd = random.Random(21)
    bits = ["r", "br", "u8R", "x1", "1.5", "@a", '"', "'", "`", "#", "//", "/*", "*/", "/", "\\", "\n", " ", "=", "*", "(", ")", "{", "}", ":", "é", "$", '"""']
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    rows = [(i, t, lang) for lang in K.FAMILIES for i, t in enumerate(texts)]
    frame = bind(spark.createDataFrame(rows, "i int, c string, language string"), t=K.tokens("c", "language"), p=K.pieces("c", "language"))

    def marked(parts):
        ends = F.transform(parts, lambda x, k: F.array_join(F.slice(parts, 1, k), ""))
        kept = F.transform(parts, lambda x, k: F.when(K.is_comment(x, F.col("language")) | K.is_string(x), F.struct(F.get(ends, k), x)))
        return F.array_compact(kept)

    seen = bind(frame, a=marked(F.col("t")), b=marked(F.col("p")))
    assert seen.filter("array_join(p, '') <> c or a <> b or size(p) > size(t)").collect() == []
    assert seen.agg(F.sum(F.size("p")) < F.sum(F.size("t"))).first()[0]
