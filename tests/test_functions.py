import pytest
from pyspark.sql import functions as F

from changelens.functions import similarity as Y
from changelens.functions import spans as P
from changelens.functions import text as X
from changelens.operators import source_code as K


def one(spark, expr, *values):
    """Value of a column expression over string columns a, b, c."""
    names = "abcdef"[: len(values)]
    row = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return row.select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    "a, b, same",
    [("a b c", "abc", True), ("a\tb\nc", "abc", True), ("a\x0bb\fc", "abc", True), ("abc", "abcd", False), ("", " ", True)],
)
def test_equal_ignoring_whitespace(spark, a, b, same):
    assert one(spark, X.equal_ignoring_whitespace("a", "b"), a, b) is same


@pytest.mark.parametrize("text, count", [("    code", 4), ("\tcode", 1), ("   ", 3), ("code", 0), ("", 0)])
def test_leading_whitespace(spark, text, count):
    assert one(spark, X.leading_whitespace("a"), text) == count


def test_strip_and_blank(spark):
    assert one(spark, X.strip_whitespace("a"), "  hello  world  ") == "helloworld"
    assert one(spark, X.is_blank("a"), " \t\n") is True
    assert one(spark, X.is_blank("a"), "x") is False


@pytest.mark.parametrize(
    "old, new, change",
    [
        ("\tcode", "    code", "tabs converted to spaces"),
        ("    code", "\tcode", "spaces converted to tabs"),
        ("code  ", "code", "trailing whitespace removed"),
        ("code", "code ", "trailing whitespace added"),
        ("code ", "code  ", "trailing whitespace changed"),
        ("  code", "    code", "indentation increased"),
        ("    code", "  code", "indentation decreased"),
        ("a  b", "a b", "whitespace changed"),
    ],
)
def test_whitespace_change_type(spark, old, new, change):
    assert one(spark, X.whitespace_change_type("a", "b"), old, new) == change


@pytest.mark.parametrize(
    "text, kind",
    [
        ("/// d", "doc"), ("//! d", "doc"), ("/** d", "doc"), ("/* b */", "block"), ("  // l", "line"),
        ("# p", "line"), ("end */ \n", "block"), ("x = 1", "unknown"), ("", "unknown"),
    ],
)
def test_comment_type(spark, text, kind):
    assert one(spark, X.comment_type("a"), text) == kind


@pytest.mark.parametrize(
    "path, language",
    [
        ("src/main.zig", "zig"), ("a/b.test.ts", "typescript"), ("x.h", "c"), ("x.hpp", "cpp"), (".bashrc", None),
        ("Makefile", None), ("a.b/c", None), ("x.unknown", None), ("dir/.x.py", "python"),
    ],
)
def test_language_of(spark, path, language):
    assert one(spark, X.language_of("a"), path) == language


@pytest.mark.parametrize(
    "line, parts",
    [
        ("@@ -1,3 +1,4 @@", (1, 3, 1, 4)), ("@@ -10 +10,2 @@ f()", (10, 1, 10, 2)), ("@@ -0,0 +1,5 @@", (0, 0, 1, 5)),
        ("not a header", None), ("@@ bad", None),
    ],
)
def test_hunk_header(spark, line, parts):
    value = one(spark, X.hunk_header("a"), line)
    assert (tuple(value) if value else None) == parts


def test_escapes(spark):
    assert one(spark, X.shell_escape("a"), 'a$b`c\\d"e!f') == 'a\\$b\\`c\\\\d\\"e\\!f'
    assert one(spark, X.json_escape("a"), 'q"\\\n\r\t\x01') == 'q\\"\\\\\\n\\r\\t\\u0001'
    assert one(spark, X.json_unescape("a"), 'q\\"\\\\\\n\\u0041') == 'q"\\\nA'
    assert one(spark, X.line_ref(F.lit(3), F.lit(3)), "") == "Line 3"
    assert one(spark, X.line_ref(F.lit(3), F.lit(5)), "") == "Lines 3-5"


def test_binary_sniff(spark):
    assert one(spark, X.is_binary("a"), "a\x00b") is True
    assert one(spark, X.is_binary("a"), "x" * 8192 + "\x00") is False
    assert one(spark, X.is_binary("a"), "") is False


@pytest.mark.parametrize(
    "old, new, spans",
    [
        ("Hello beautiful world", "Hello world", (6, 16, 6, 6)),
        ("Hello world", "Hello world, extra stuff", (11, 11, 11, 24)),
        ("same", "same", (4, 4, 4, 4)),
        ("", "abc", (0, 0, 0, 3)),
        ("aaa", "aa", (2, 3, 2, 2)),
        ("é1", "é2", (2, 3, 2, 3)),
    ],
)
def test_change_ranges(spark, old, new, spans):
    r = one(spark, P.change_ranges("a", "b"), old, new)
    assert (r.old_start, r.old_end, r.new_start, r.new_end) == spans


def test_inline_segments(spark):
    r = one(spark, P.inline_segments("a", "b"), "let é = 1;", "let è = 1;")
    assert tuple(r) == ("let ", "é", "è", " = 1;")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequence_length_against_table():
    import random

    random.seed(3)
    assert Y.subsequence_length(b"abcd", b"axbxcxd") == 4
    assert Y.subsequence_length(b"abc", b"xyz") == 0
    for _ in range(300):
        a = bytes(random.choices(b"abc", k=random.randrange(40)))
        b = bytes(random.choices(b"abc", k=random.randrange(90)))
        assert Y.subsequence_length(a, b) == lcs(a, b)


def test_subsequence_lengths_of_a_batch():
    """Sizes around the word border, several words with carries, empty and very long texts, all in one batch."""
    import random

    rnd = random.Random(5)
    sizes = [0, 1, 5, 63, 64, 65, 127, 128, 129, 200, 400]
    left = [bytes(rnd.choices(b"abc", k=rnd.choice(sizes))) for _ in range(250)] + [b"a" * 64, b"a" * 130, b"ab" * 900, b""]
    right = [bytes(rnd.choices(b"abcd", k=rnd.choice(sizes))) for _ in range(250)] + [b"a" * 64, b"a" * 129, b"ba" * 700, b"x"]
    assert Y.subsequence_lengths(left, right).tolist() == [Y.subsequence_length(a, b) for a, b in zip(left, right)]
    assert Y.subsequence_lengths(left[:60], right[:60]).tolist() == [lcs(a, b) for a, b in zip(left[:60], right[:60])]
    assert Y.subsequence_lengths([], []).tolist() == []


@pytest.mark.parametrize(
    "a, b, low, high",
    [
        ("x += 1;\nreturn x;", "x += 2;\nreturn x;", 0.9, 0.9999),
        ("code", "", 0, 0),
        ("", "", 1, 1),
        (" ", "", 1, 1),
        ("a b", "ab", 1, 1),
        ("abc", "xyz", 0, 0),
    ],
)
def test_body_similarity(spark, a, b, low, high):
    assert low <= one(spark, Y.body_similarity("a", "b"), a, b) <= high


def test_body_similarity_of_long_texts(spark):
    a = "".join(f"line {i};\n" for i in range(2000))
    b = a.replace("line 7;", "line 8;")
    assert 0.999 < one(spark, Y.body_similarity("a", "b"), a, b) < 1


@pytest.mark.parametrize(
    "old, new, renamed",
    [
        ("const foo = 42;", "const bar = 42;", True),
        ("bar + baz", "bar * baz", False),
        ("a = a", "b = b", True),
        ("a = a", "b = c", False),
        ("x", "x ", False),
        ("x == 1", "y == 1", True),
    ],
)
def test_is_rename(spark, old, new, renamed):
    assert one(spark, K.is_rename("a", "b", F.lit("zig")), old, new) is renamed
    assert one(spark, K.is_rename("a", "b", F.lit("json")), old, new) is False


def test_normalized(spark):
    assert one(spark, K.normalized("a", F.lit("rust")), "let x = f(x, y); // x") == "let _id0 = _id1(_id0, _id2); // x"


def test_tokens_cover_long_literals(spark):
    text = 'x = "' + "a\\\"" * 20000 + '"; /* ' + "*" * 50000 + " */ 'c' é"
    tok = one(spark, K.tokens("a", F.lit("rust")), text)
    assert "".join(tok) == text
    assert sum(t.startswith('"') for t in tok) == 1 and sum(t.startswith("/*") for t in tok) == 1


def test_infer_highlight(spark):
    for kind, highlight in {
        "doc_comment": "comment", "string": "string", "integer": "number", "type_identifier": "type_",
        "builtin_identifier": "function", "while": "keyword", "nil": "constant", "+=": "operator", "::": "operator",
        ";": "punctuation", "call_expression": "none", "....": "none",
    }.items():
        assert one(spark, X.infer_highlight("a"), kind) == highlight, kind
