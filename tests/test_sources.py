import json
import random

from pyspark.sql import functions as F

from changelens import schemas
from changelens.operators import entries as E
from changelens.operators import session as S
from changelens.sources import diff_json, event_log, listing, patch, report


def test_listing(spark):
    text = "M\tsrc/main.zig\nA\tsrc/new.zig\nD\tsrc/old.zig\nR100\told/a.c\tnew/a.c\nC075\tx\ty\n?? loose\nX\tskip\n\nR\tonly\n"
    frame = spark.createDataFrame([("unstaged", text)], "mode string, text string")
    rows = [(r.path, r.status, r.old_path) for r in listing.parse_listing(frame).collect()]
    assert rows == [
        ("src/main.zig", "modified", None),
        ("src/new.zig", "added", None),
        ("src/old.zig", "deleted", None),
        ("new/a.c", "renamed", "old/a.c"),
        ("y", "copied", "x"),
        ("? loose", "untracked", None),
    ]


def test_path_filter(spark):
    frame = spark.createDataFrame([("src/a.zig",), ("lib/b.zig",), ("doc/src.md",)], "path string")
    assert {r.path for r in listing.filter_paths(frame, ["src", "b.z"]).collect()} == {"src/a.zig", "lib/b.zig", "doc/src.md"}
    assert {r.path for r in listing.filter_paths(frame, ["src/"]).collect()} == {"src/a.zig"}
    assert listing.filter_paths(frame, []).count() == 3


def test_records(spark):
    good = {
        "path": "a.zig", "language": "Zig", "status": "changed",
        "chunks": [[
            {"lhs": {"line_number": 4, "changes": [{"start": 0, "end": 3, "content": "abc", "highlight": "keyword"}]}},
            {"rhs": {"changes": [{"content": "x", "highlight": "odd"}, {}]}},
            {"lhs": None, "rhs": {"line_number": 1, "changes": []}},
        ]],
    }
    texts = [json.dumps(good), "{}", '{"status": "created"}', "broken", '{"path": 1', "[1]", "12", '{"status":"deleted","path":"b"}']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, record string")
    rows = {r.i: r for r in diff_json.parse_records(frame).collect()}
    assert set(rows) == {0, 1, 2, 7}
    assert (rows[1].path, rows[1].language, rows[1].status, rows[1].chunks) == ("unknown", "Text", "changed", [])
    assert rows[2].status == "added" and rows[7].status == "removed"
    a, b, c = rows[0].chunks[0]
    assert (a.lhs.line_number, a.rhs) == (4, None)
    assert tuple(a.lhs.changes[0]) == (0, 3, "abc", "keyword")
    assert b.rhs.line_number == 0 and [tuple(x) for x in b.rhs.changes] == [(0, 0, "x", "novel"), (0, 0, "", "normal")]
    assert c.lhs is None and c.rhs.line_number == 1


def test_records_that_follow_each_other(spark):
    one = json.dumps({"path": "we{ird\\\"}.c", "status": "created"}, indent=2)
    text = f"  {one}{{}}\n\n{one} {{ no json }} {{"
    frame = spark.createDataFrame([(text,), ("",)], "text string")
    split = diff_json.split_objects(frame, "text")
    assert split.count() == 4
    assert [r.path for r in diff_json.parse_records(split).collect()] == ["we{ird\\\"}.c", "unknown", "we{ird\\\"}.c"]


def log(spark, *texts):
    rows = [(name, i, line) for name, text in texts for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "log string, pos bigint, line string")


def delta(text):
    return json.dumps({"type": "message_update", "delta": {"type": "text_delta", "delta": text}}, separators=(",", ":"))


def test_event_log(spark):
    hard = 'a "quoted" \\ line\nand \u00e9 \u20ac'
    lines = log(
        spark,
        ("two", delta("Hello") + "\n\n" + delta(" world!")),
        ("hard", delta(hard)),
        ("error", delta("lost") + '\n{"success":false,"error":"first"}\n{"success":false}\n' + '{"success":false,"error":"second"}'),
        ("unknown", '{"success":false}'),
        ("silent", "x" * 600),
        ("short", '{"type":"status"}'),
    )
    rows = {r.log: r for r in event_log.responses(lines).collect()}
    assert (rows["two"].outcome, rows["two"].text) == ("text", "Hello world!")
    assert rows["hard"].text == hard
    assert rows["error"].text.endswith(":\nsecond") and rows["error"].outcome == "error"
    assert rows["unknown"].text.endswith("(unknown)")
    assert rows["silent"].text.endswith("(600 bytes total):\n" + "x" * 500 + "\n...")
    assert rows["short"].text.endswith('(17 bytes total):\n{"type":"status"}')
    for size in (1, 2, 3):
        again = event_log.responses(lines, block_lines=size).collect()
        assert sorted(again, key=str) == sorted(rows.values(), key=str)


def test_event_log_in_parts_and_blocks(spark):
    rnd = random.Random(5)
    texts = {}
    for name in ("a", "b", "quiet", "broken"):
        kinds = {"quiet": "s", "broken": "tse"}.get(name, "ts")
        texts[name] = [(rnd.choice(kinds), "é" * rnd.randint(0, 9) if kinds != "s" else "z" * rnd.randint(0, 40)) for _ in range(90)]
    texts["broken"].append(("e", ""))
    made = {"t": lambda t, k: delta(t), "s": lambda t, k: t, "e": lambda t, k: f'{{"success":false,"error":"at {k}"}}'}
    lines = {name: [made[kind](t, k) for k, (kind, t) in enumerate(rows)] for name, rows in texts.items()}
    frame = log(spark, *[(name, "\n".join(rows)) for name, rows in lines.items()])
    for block_lines in (7, 4096):
        found = {}
        for r in event_log.responses(frame, part_bytes=50, block_lines=block_lines).orderBy("part").collect():
            found.setdefault(r.log, []).append((r.outcome, r.part, r.text))
        for name in ("a", "b"):
            assert "".join(t for _, _, t in found[name]) == "".join(t for kind, t in texts[name] if kind == "t")
            assert [p for _, p, _ in found[name]] == list(range(len(found[name]))) and len(found[name]) > 2
            assert all(len(t.encode()) <= 68 for _, _, t in found[name])
        assert found["broken"] == [("error", 0, "The helper returned an error:\nat 90")]
        raw = "\n".join(lines["quiet"])
        (outcome, part, text), = found["quiet"]
        assert (outcome, part) == ("empty", 0) and text.endswith(f"({len(raw)} bytes total):\n{raw[:500]}" + "\n..." * (len(raw) > 500))


def test_event_log_reads_its_lines_twice(spark, tmp_path):
    frame = log(spark, ("a", delta("x"))).select("log", "pos", "line")
    frame.write.parquet(str(tmp_path / "lines"))
    made = event_log.responses(spark.read.parquet(str(tmp_path / "lines")))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Join ") == 1


DIFF = "diff x\n--- a\n+++ b\n@@ -1,2 +1,6 @@\n one\n+two\n+three\n+four\n+five\n six\n"


def patched(spark, diff, start, end):
    frame = spark.createDataFrame([("a", diff)], "path string, diff string")
    return patch.partial_patch(frame, F.lit(start), F.lit(end)).first().patch


def test_partial_patch(spark):
    assert patched(spark, DIFF, 2, 3) == "diff x\n--- a\n+++ b\n@@ -1,0 +2,2 @@\n+two\n+three\n"
    assert patched(spark, DIFF, 100, 200) == ""
    assert patched(spark, "", 1, 2) == ""
    assert patched(spark, DIFF, 1, 6) == DIFF.replace("-1,2 +1,6", "-1,2 +1,6")


def test_partial_patch_keeps_deletions_one_line_further(spark):
    diff = "h\n@@ -1,3 +1,2 @@\n a\n-b\n c\n\\ No newline at end of file\n@@ -20 +19 @@\n-x\n\\ No newline at end of file\n+y\n"
    assert patched(spark, diff, 1, 1) == "h\n@@ -1,2 +1,1 @@\n a\n-b\n\\ No newline at end of file\n"
    assert patched(spark, diff, 19, 19) == "h\n@@ -20,1 +19,1 @@\n-x\n\\ No newline at end of file\n+y\n"


def comments(spark, rows):
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)], schemas.COMMENTS + ", pos bigint"
    )


def test_markdown(spark, tmp_path):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    made = comments(spark, [("b.c", "new", 5, 5, "second"), ("a.c", "old", 7, 9, "two\nlines"), ("b.c", "new", 2, 2, "first")])
    text = "".join(
        r.text for r in report.markdown(files, made).orderBy("section", "path", "kind", "line_start", "pos").collect()
    )
    assert text == (
        "# Code Review\n\n## Summary\n\n- **Files reviewed:** 2\n- **Comments:** 3\n\n## Comments\n\n"
        "### `a.c`\n\n**Lines 7-9** (old):\n> two\n> lines\n\n"
        "### `b.c`\n\n**Line 2** (new):\n> first\n\n**Line 5** (new):\n> second\n\n"
        "---\n*Generated by changelens*\n"
    )
    out = tmp_path / "report"
    report.write_markdown(report.markdown(files, made), str(out))
    assert "".join(p.read_text() for p in sorted(out.glob("part-*"))) == text
    none = report.markdown(files, made.limit(0)).collect()
    assert len(none) == 1 and none[0].text.endswith("*No comments were added during review.*\n")


def test_staged_ranges(spark):
    ranges = spark.createDataFrame(
        [("a", "new", 10, 14), ("a", "new", 20, 22), ("b", "new", 10, 20), ("a", "old", 1, 1)], schemas.STAGED_RANGES
    )
    lines = spark.createDataFrame([("b", "new", n) for n in (9, 10, 20, 21)] + [("b", "old", 10)], "path string, side string, line bigint")
    got = {(r.side, r.line): r.staged for r in S.flag_staged(lines, ranges).collect()}
    assert got == {("new", 9): False, ("new", 10): True, ("new", 20): True, ("new", 21): False, ("old", 10): False}
    counts = {r.path: r.staged_lines for r in S.staged_line_count(ranges.filter("side = 'new'")).collect()}
    assert counts == {"a": 8, "b": 11}


def test_comment_rules(spark):
    def spans(*kinds):
        return [(0, 1, "x", k) for k in kinds]

    cases = [
        (spans("comment"), spans("comment"), "comment", "comment modified"),
        ([], spans("comment"), "comment", "comment added"),
        (spans("comment"), [], "comment", "comment removed"),
        (spans("comment", "novel"), spans("comment"), "semantic", None),
        ([], [], "semantic", None),
    ]
    array = f"array<{schemas.CHANGE}>"
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], f"i int, old_changes {array}, new_changes {array}")
    rows = frame.select("i", E.comment_analysis("old_changes", "new_changes").alias("r"), E.comment_only("old_changes", "new_changes").alias("only"))
    for r in rows.collect():
        assert (r.r.category, r.r.details) == cases[r.i][2:]
        assert r.only is (cases[r.i][2] == "comment")


def test_whitespace_rules(spark):
    def span(text):
        return [] if text is None else [(0, len(text), text, "novel")]

    cases = [
        ("  x", "x", "whitespace", "indentation decreased"),
        (None, " \t", "whitespace", "blank line added"),
        ("", None, "whitespace", "blank line removed"),
        (None, "x", "semantic", None),
        ("a b", "ab", "whitespace", "whitespace changed"),
        ("a", "b", "semantic", None),
    ]
    array = f"array<{schemas.CHANGE}>"
    frame = spark.createDataFrame(
        [(i, span(a), span(b)) for i, (a, b, _, _) in enumerate(cases)], f"i int, old_changes {array}, new_changes {array}"
    )
    for r in frame.select("i", E.whitespace_analysis("old_changes", "new_changes").alias("r")).collect():
        assert (r.r.category, r.r.details) == cases[r.i][2:]


def test_files_as_bytes(spark, tmp_path):
    """Text, invalid UTF-8, a NUL within and beyond the sniffed bytes, and an empty file."""
    made = {"a.txt": "héllo\nline\n".encode(), "b.bin": b"ab\x00cd", "c.txt": b"x" * 9000 + b"\x00", "d.txt": b"bad \xff\xfe end", "e.txt": b""}
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
    rows = {r.path.rsplit("/", 1)[1]: r for r in listing.read_files(spark, str(tmp_path)).collect()}
    assert {n: r.is_binary for n, r in rows.items()} == {"a.txt": False, "b.bin": True, "c.txt": False, "d.txt": False}
    assert rows["a.txt"].content == "héllo\nline\n" and rows["b.bin"].content is None
    assert rows["d.txt"].content == made["d.txt"].decode("utf-8", "replace") and not rows["d.txt"].valid_utf8 and rows["a.txt"].valid_utf8
    whole = {r.path.rsplit("/", 1)[1]: r.content for r in listing.read_text_files(spark, str(tmp_path / "a.txt")).collect()}
    assert whole == {"a.txt": "héllo\nline\n"}
