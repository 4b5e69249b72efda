import random

from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions.similarity import subsequence_length
from changelens.operators import constructs as C
from changelens.operators import entries as E
from changelens.operators import moves as M
from changelens.operators import navigation as N
from changelens.operators import outline as O
from changelens.operators import regions as R


def regions(spark, rows):
    """Rows of (path, side, start, end, header end, kind, name, collapsed, level)."""
    return spark.createDataFrame(rows, schemas.REGIONS)


def file_rows(spark, rows, found):
    """One file's rows (type, old line, new line, spans of the new side) and regions, as ``file_rows`` gives them."""
    made = [(t, o, n, "x", None, changes, [], True) for t, o, n, changes in rows]
    kind = "array<struct<line_type:string,old_line:bigint,new_line:bigint,content:string,old_content:string,changes:array<%s>,old_changes:array<%s>,selectable:boolean>>"
    region = schemas.REGIONS.split(", ", 1)[1].replace(" ", ":").replace(",:", ",")
    schema = f"path string, listed boolean, rows {kind % (schemas.CHANGE, schemas.CHANGE)}, regions array<struct<{region}>>"
    return spark.createDataFrame([("a", False, made, found)], schema)


def test_hidden_lines(spark):
    made = [("new", 1, 10, 2, "function", "f", True, 1), ("new", 20, 30, 20, "function", "g", False, 1), ("old", 1, 40, 1, "class", "h", True, 1)]
    rows = file_rows(spark, [("context", n, n, []) for n in (1, 2, 3, 10, 11, 25)] + [("deletion", 26, None, []), ("deletion", 41, None, [])], made)
    assert [r.ord for r in R.visible_lines(rows).orderBy("ord").collect()] == [0, 1, 4, 5, 7]
    moved = N.nearest_navigable(rows).orderBy("ord").collect()
    assert [r.cursor for r in moved] == [0, 1, 1, 1, 4, 5, 5, 7]
    flags = N.flag_rows(rows).orderBy("ord").collect()
    assert [r.visible for r in flags] == [True, True, False, False, True, True, False, True]


def test_cursor_goes_down_or_to_the_top(spark):
    hidden_top = [("new", 1, 3, 1, "function", "f", True, 1)]
    rows = file_rows(spark, [("context", 2, 2, []), ("context", 3, 3, []), ("context", 4, 4, [])], hidden_top)
    assert [r.cursor for r in N.nearest_navigable(rows).orderBy("ord").collect()] == [2, 2, 2]
    rows = file_rows(spark, [("context", 2, 2, []), ("context", 3, 3, [])], hidden_top)
    assert [r.cursor for r in N.nearest_navigable(rows).orderBy("ord").collect()] == [0, 0]
    assert N.nearest_navigable(file_rows(spark, [], hidden_top)).count() == 0


def test_cosmetic_rows_are_hidden(spark):
    comment = [(0, 1, "x", "comment")]
    rows = file_rows(spark, [("context", 1, 1, []), ("addition", None, 2, comment), ("deletion", 2, None, [(0, 1, "x", "novel")])], [])
    shown = R.visible_lines(rows, folded=False, drop_cosmetic=True)
    assert [r.ord for r in shown.orderBy("ord").collect()] == [0, 2]


def test_uncollapse(spark):
    made = regions(spark, [
        ("a", "new", 1, 10, 2, "function", "f", True, 1),
        ("a", "new", 11, 90, 12, "function", "g", True, 1),
        ("a", "old", 1, 10, 2, "function", "f", True, 1),
        ("a", "new", 95, 95, 95, "function", "h", True, 1),
    ])
    entries = spark.createDataFrame([("a", 5, 2), ("a", None, 80), ("a", None, 95)], "path string, old_line bigint, new_line bigint")
    got = {(r.side, r.name): r.collapsed for r in R.uncollapse_changed(made, entries).collect()}
    assert got == {("new", "f"): True, ("new", "g"): False, ("old", "f"): False, ("new", "h"): True}


OLD = "fn oldFunc() {\n    a();\n}\n\nfn keepFunc() {\n    b();\n}\n"
NEW = "fn newFunc() {\n    a();\n}\n\nfn keepFunc() {\n    b();\n    c();\n}\n"


def test_summary_of_a_small_source(spark):
    def side(line, text):
        return (line, [(0, len(text), text, "novel")])

    chunks = [[(side(0, "fn oldFunc() {"), side(0, "fn newFunc() {")), (None, side(6, "    c();"))]]
    frame = spark.createDataFrame(
        [("a.rs", "rust", "changed", False, OLD, NEW, chunks), ("a.md", None, "changed", False, OLD, NEW, chunks)], schemas.FILES
    )
    known = frame.filter("path = 'a.rs'")
    found = O.find_regions(known)
    constructs, stats = C.file_summary(frame, found)
    assert {(r.name, r.change_type, r.lines_changed, r.category) for r in constructs.collect()} == {
        ("oldFunc", "deleted", 3, "semantic"), ("newFunc", "added", 3, "semantic"), ("keepFunc", "modified", 1, "semantic"),
    }
    rows = {r.path: r for r in C.with_totals(stats).withColumn("brief", C.brief_description(stats)).collect()}
    a = rows["a.rs"]
    assert (a.functions_added, a.functions_modified, a.functions_deleted, a.total_constructs) == (1, 1, 1, 3)
    assert a.brief == "1 fn added, 1 fn modified, 1 fn deleted" and a.has_changes
    assert rows["a.md"].total_constructs == 0 and rows["a.md"].brief == "+1 -0 lines"


def test_category_of_constructs(spark):
    made = regions(spark, [
        ("a", "old", 1, 4, 1, "function", "same", True, 1), ("a", "new", 1, 4, 1, "function", "same", True, 1),
        ("a", "old", 5, 8, 5, "function", "grown", True, 1), ("a", "new", 5, 9, 5, "function", "grown", True, 1),
        ("a", "old", 10, 14, 10, "struct_", "mixed", True, 1), ("a", "new", 10, 14, 10, "struct_", "mixed", True, 1),
        ("a", "old", 20, 24, 20, "class", "still", True, 1), ("a", "new", 20, 24, 20, "class", "still", True, 1),
        ("a", "old", 30, 32, 30, "class", "twice", True, 1), ("a", "old", 40, 45, 40, "class", "twice", True, 1),
        ("a", "new", 30, 35, 30, "class", "twice", True, 1), ("a", "new", 50, 52, 50, "class", "twice", True, 1),
        ("a", "new", 60, 61, 60, "class", "inner", True, 2), ("a", "new", 60, 61, 60, "class", "", True, 1),
    ])
    lines = spark.createDataFrame(
        [("a", 3, "whitespace"), ("a", 2, "comment"), ("a", 11, "comment"), ("a", 12, "semantic")], "path string, line bigint, category string"
    )
    got = {(r.name, r.line_start): (r.change_type, r.lines_changed, r.category) for r in C.changed_constructs(made, lines).collect()}
    assert got == {
        ("same", 1): ("modified", 2, "comment"),
        ("grown", 5): ("modified", 0, "whitespace"),
        ("mixed", 10): ("modified", 2, "semantic"),
        # The last old region of a name counts: 40-45 is as long as 30-35.
        ("twice", 50): ("modified", 0, "whitespace"),
    }


SNIPPETS = {
    "rust": (
        "// top {\nfn main() {\n    let x = \"}\";\n    if x {\n        y();\n    }\n}\nmod m {\n    /* { */\n    fn inner()\n    {\n"
        "        z();\n    }\n    struct P { a: u8 }\n}\nfn one() { 1 }\nfn dec();\n",
        [("main", 2, 7, 2, 1), ("m", 8, 15, 8, 1), ("inner", 10, 13, 11, 2)],
    ),
    "python": (
        "class A:\n    '''doc\n    string'''\n    def f(self):\n        return 1\n\n    def g(self):\n        if x:\n            def h():\n"
        "                pass\n        return 2\n\ndef top(): pass\ndef last():\n    return 3\n",
        [("A", 1, 11, 1, 1), ("f", 4, 5, 4, 2), ("g", 7, 11, 7, 2), ("last", 14, 15, 14, 1)],
    ),
    "zig": (
        "const S = struct {\n    x: u8,\n    fn f(self: S) void {\n        _ = self;\n    }\n};\ntest \"a\" {\n    try x();\n}\n",
        [("S", 1, 6, 1, 1), ("f", 3, 5, 3, 2), ("", 7, 9, 7, 1)],
    ),
    "javascript": ("class Q {\n  run(a) {\n    for (;;) {\n      go('{');\n    }\n  }\n}\n", [("Q", 1, 7, 1, 1), ("run", 2, 6, 2, 2)]),
    "c": ("struct P {\n    int x;\n};\nint add(int a)\n{\n    return a;\n}\n", [("P", 1, 3, 1, 1), ("add", 4, 7, 4, 1)]),
    "go": ("type T struct {\n\tx int\n}\nfunc (t T) Run() {\n\tt.x = 1\n}\n", [("T", 1, 3, 1, 1), ("Run", 4, 6, 4, 1)]),
    "java": ("public class A {\n    public int get(int y) {\n        return x;\n    }\n}\n", [("A", 1, 5, 1, 1), ("get", 2, 4, 2, 2)]),
    "json": ('{\n  "a": {\n  }\n}\n', []),
}


STATEMENTS = {
    "python": (
        "def f(\n    a,\n    b=[\n1],\n):\n    x = {\n'k': 1,\n}\n\nclass A(\n    B, C\n):\n    def g(self, a,\n          b):\n"
        "        return (\na +\n\nb)\n\ny = 1\n",
        [("f", 1, 8, 5, 1), ("A", 10, 18, 12, 1), ("g", 13, 18, 14, 2)],
    ),
    "javascript": (
        "class Q {\n  run(\n    a,\n    b\n  ) {\n    go(\n      a,\n      b);\n    if (a) {\n      b();\n    }\n  }\n}\n"
        "describe('x', [1,\n  2], () => {\n  class R {\n    m(a) {\n      n();\n    }\n  }\n});\n",
        [("Q", 1, 13, 1, 1), ("run", 2, 12, 5, 2)],
    ),
    "c": ("int add(int a,\n        int b)\n{\n    call(a,\n         b);\n    if (a) {\n        b();\n    }\n}\nint dec(int a,\n        int b);\n", [("add", 1, 9, 2, 1)]),
    "rust": ("fn dec(\n    a: u8,\n) -> u8;\nfn long(\n    a: [u8; 2],\n) -> u8 {\n    a\n}\n", [("long", 4, 8, 6, 1)]),
}


def test_outline_of_headers_over_several_lines(spark):
    frame = spark.createDataFrame([(k, k, "", v[0]) for k, v in STATEMENTS.items()], "path string, language string, old_content string, new_content string")
    got = {}
    for r in O.find_regions(frame, ["new"]).orderBy("path", "start_line").collect():
        got.setdefault(r.path, []).append((r.name, r.start_line, r.end_line, r.header_end_line, r.level))
    for language, (_, expected) in STATEMENTS.items():
        assert got.get(language, []) == expected, language


def test_outline(spark):
    frame = spark.createDataFrame([(k, k, "", v[0]) for k, v in SNIPPETS.items()], "path string, language string, old_content string, new_content string")
    got = {}
    for r in O.find_regions(frame, ["new"]).orderBy("path", "start_line").collect():
        got.setdefault(r.path, []).append((r.name, r.start_line, r.end_line, r.header_end_line, r.level))
    for language, (_, expected) in SNIPPETS.items():
        assert got.get(language, []) == expected, language
    assert O.find_regions(frame, ["old"]).count() == 0


def content_and_regions(bodies):
    """Source text of (name, kind, body lines) constructs, and their regions."""
    lines, found = [], []
    for name, kind, body in bodies:
        start = len(lines) + 1
        lines += [f"fn {name}()", *body]
        found.append((start, len(lines), start, kind, name))
    return "\n".join(lines) + "\n", found


def greedy(old, new, old_lines, new_lines, threshold):
    """Pairs by the plain rule: old regions in order, each takes the best free new one."""
    taken, pairs = set(), []

    def body(lines, r):
        return "\n".join(lines[r[2] : r[1]]) + "\n"

    for o in old:
        best = None
        for n in new:
            if n in taken or n[3:] != o[3:] or n[:2] == o[:2]:
                continue
            a, b = ("".join(body(x, r).split()).encode() for x, r in ((old_lines, o), (new_lines, n)))
            score = 1.0 if a == b else 0.0 if not a or not b else subsequence_length(a, b) / max(len(a), len(b))
            if score >= threshold and (best is None or score > best[0]):
                best = (score, n)
        if best:
            taken.add(best[1])
            pairs.append((o[4], o[0], best[1][0], round(best[0], 9)))
    return sorted(pairs)


def moved(spark, old_bodies, new_bodies, **options):
    old, old_found = content_and_regions(old_bodies)
    new, new_found = content_and_regions(new_bodies)
    frame = spark.createDataFrame([("a", old, new)], "path string, old_content string, new_content string")
    rows = [("a", side, s, e, h, kind, name, True, 1) for side, found in (("old", old_found), ("new", new_found)) for s, e, h, kind, name in found]
    result = M.moved_constructs(M.region_bodies(frame, regions(spark, rows)), **options)
    got = sorted((r.name, r.old_start_line, r.new_start_line, round(r.similarity, 9)) for r in result.collect())
    return got, greedy(old_found, new_found, old.split("\n"), new.split("\n"), options.get("threshold", 0.9))


def test_swapped_functions_moved(spark):
    helper, main = ("helper", "function", ["  a;", "}"]), ("main", "function", ["  b;", "  c;", "}"])
    got, expected = moved(spark, [helper, main], [main, helper])
    assert got == expected and [g[0] for g in got] == ["helper", "main"]


def test_moves_of_a_repeated_name(spark):
    """One name holds most regions, and many bodies are equal or tie."""
    rng = random.Random(5)

    def made(count):
        rows = []
        for _ in range(count):
            name = "init" if rng.random() < 0.8 else f"f{rng.randrange(3)}"
            base = rng.choice(["value = compute(input, other);", "return register(handler, option);"])
            body = [base + rng.choice(["", " x", " yy"]), rng.choice(["done();", "done( );", "end();"])]
            rows.append((name, rng.choice(["function", "function", "class"]), body))
        return rows

    old, new = made(18), made(16)
    got, expected = moved(spark, old, new)
    assert got == expected
    assert len(got) > 8


def test_moves_of_ten_thousand_regions_of_one_name(spark):
    """Every tenth body is edited; each region must find its own counterpart, without one job per so many names."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(40, 200))) + f"#{i}" for i in range(10_000)]
    order = rng.sample(range(len(texts)), len(texts))
    rows = [("a", "old", 2 * i + 1, 2 * i + 2, 2 * i + 1, "function", "init", True, 1, t) for i, t in enumerate(texts)]
    edited = [t + "!" if i % 10 == 0 else t for i, t in enumerate(texts)]
    rows += [("a", "new", 2 * k + 1, 2 * k + 2, 2 * k + 1, "function", "init", True, 1, edited[i]) for k, i in enumerate(order)]
    moved = M.moved_constructs(spark.createDataFrame(rows, schemas.REGIONS + ", body string")).collect()
    at = {i: 2 * k + 1 for k, i in enumerate(order)}
    still = sum(at[i] == 2 * i + 1 for i in range(len(texts)))
    assert len(moved) == len(texts) - still
    assert all(r.new_start_line == at[(r.old_start_line - 1) // 2] for r in moved)


def test_moves_run_one_python_step(spark):
    rows = [("a", s, 1, 3, 1, "function", "f", True, 1, "x") for s in ("old", "new")]
    plan = M.moved_constructs(spark.createDataFrame(rows, schemas.REGIONS + ", body string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_only_equal_bodies_are_shuffled_as_digests(spark):
    """Where a body is so short that only an equal one reaches the threshold, its digest meets the others'; the pairs stay the same."""
    texts = ["short", "x" * 40, "x" * 39 + "y", "x" * 2000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    made = lambda threshold: [r[0] for r in frame.select(M._comparable(F.col("t"), threshold)).collect()]
    assert made(0.9) == texts
    for threshold, digests in ((0.999, 2), (0.999999, 3), (1.0, 3)):
        got = made(threshold)
        assert got[0] == "short" and [len(x) for x in got].count(32) == digests and len(set(got)) == 4
    rng, old, new = random.Random(8), [], []
    for side in (old, new):
        for k in range(20):
            side.append((f"f{rng.randrange(4)}", "function", [rng.choice(["value = compute(input, other, one);", "return register(handler, option, two);"]) + rng.choice(["", "z"])]))
    got, expected = moved(spark, old, new, threshold=0.999999)
    assert got == expected and len(got) > 5 and all(g[3] == 1 for g in got)


def test_asof_and_ranges(spark):
    rows = spark.createDataFrame(
        [("a", 0, 5), ("a", 1, None), ("a", 2, 6), ("a", 3, 40), ("b", 0, 1)], "path string, ord bigint, new_line bigint"
    )
    asked = spark.createDataFrame([("a", 1), ("a", 6), ("a", 7), ("a", 41), ("b", 2), ("c", 1)], "path string, line bigint")
    got = {(r.path, r.line): r.ord for r in N.scroll_to_line(rows, asked, block_rows=4).collect()}
    assert got == {("a", 1): 0, ("a", 6): 2, ("a", 7): 3, ("a", 41): None, ("b", 2): None, ("c", 1): None}


def test_changed_line_keeps_the_last_category(spark):
    frame = spark.createDataFrame(
        [("a", 0, 0, 3, "comment"), ("a", 0, 1, 3, "semantic"), ("a", 1, 0, None, "comment")],
        "path string, chunk_idx bigint, entry_idx bigint, new_line bigint, category string",
    )
    assert [tuple(r) for r in E.changed_lines(frame).collect()] == [("a", 3, "semantic")]


def test_constructs_of_the_code_are_matched_in_one_pass(spark):
    """The regions are computed once: one scan, and nothing is shuffled to match them."""
    from changelens.plans.catalog import QUERIES

    plan = QUERIES["code_constructs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Aggregate" not in plan
