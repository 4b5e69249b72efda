"""Row building against a plain loop written from the rules, on random diffs."""

import random

import pytest

from changelens import schemas
from changelens.operators import difflines as D
from changelens.operators import entries as E

FILES = schemas.FILES


def side(line, text=None, highlight="novel"):
    changes = [] if text is None else [(0, len(text.encode()), text, highlight)]
    return (line, changes)


def file(path, old, new, chunks, status="changed", binary=False):
    return (path, None, status, binary, "\n".join(old), "\n".join(new), chunks)


def loop_rows(old, new, chunks):
    """(type, old no, new no, content, old content) of the unified view, one entry at a time."""
    rows, mark_old, mark_new, offset = [], 0, 0, 0

    def context(n):
        nonlocal mark_old, mark_new
        if n <= mark_new:
            return
        before = max(n - offset, 0)
        rows.append(("context", before, n, new[n - 1] if n <= len(new) else "", None))
        mark_new, mark_old = n, before

    def text(lines, i):
        return lines[i] if i < len(lines) else ""

    for chunk in chunks:
        olds = [lhs[0] + 1 for lhs, _ in chunk if lhs]
        news = [rhs[0] + 1 for _, rhs in chunk if rhs]
        start = max((min(news) if news else min(olds)) - 3, 1)
        shown = mark_new if news else mark_old
        if shown > 0 and start > shown + 1:
            rows.append(("context", None, None, "...", None))
        if news:
            for n in range(start, min(news)):
                context(n)
        at = start - 1
        order = sorted(range(len(chunk)), key=lambda i: (chunk[i][1] or chunk[i][0])[0])
        for i in order:
            lhs, rhs = chunk[i]
            if rhs:
                for n in range(at + 1, rhs[0] + 1):
                    context(n)
                at = rhs[0] + 1
            if lhs and rhs:
                a, b = text(old, lhs[0]), text(new, rhs[0])
                mark_old, mark_new = max(mark_old, lhs[0] + 1), max(mark_new, rhs[0] + 1)
                if a != b:
                    rows.append(("modification", lhs[0] + 1, rhs[0] + 1, b, a))
                    offset = rhs[0] - lhs[0]
            elif lhs:
                rows.append(("deletion", lhs[0] + 1, None, text(old, lhs[0]), None))
                mark_old = max(mark_old, lhs[0] + 1)
                offset -= 1
            else:
                rows.append(("addition", None, rhs[0] + 1, text(new, rhs[0]), None))
                mark_new = max(mark_new, rhs[0] + 1)
                offset += 1
        if news:
            last = max(news)
            for n in range(last + 1, min(last + 3, len(new)) + 1):
                context(n)
    return rows


def random_file(rng, number):
    """Walk over a made-up alignment and group its changes into chunks."""
    old, new, entries = [], [], []
    for step in range(rng.randrange(1, 70)):
        kind = rng.choices(["same", "mod", "del", "add", "equal"], [8, 2, 2, 2, 1])[0]
        if kind in ("same", "equal"):
            line = f"l{rng.randrange(6)}"
            old.append(line)
            new.append(line)
            if kind == "equal":
                entries.append((step, (side(len(old) - 1), side(len(new) - 1))))
        elif kind == "mod":
            old.append(f"old {step}")
            new.append(f"new {step}")
            entries.append((step, (side(len(old) - 1), side(len(new) - 1))))
        elif kind == "del":
            old.append(f"gone {step}")
            entries.append((step, (side(len(old) - 1, old[-1]), None)))
        else:
            new.append(f"come {step}")
            entries.append((step, (None, side(len(new) - 1, new[-1]))))
    chunks, last, gap = [], None, rng.choice([1, 2, 5, 12])
    for step, entry in entries:
        if last is None or step - last > gap:
            chunks.append([])
        chunks[-1].append(entry)
        last = step
    for chunk in chunks:
        if rng.random() < 0.3:
            rng.shuffle(chunk)
    return file(f"f{number}", old or [""], new or [""], chunks), old or [""], new or [""], chunks


def test_rows_match_the_loop(spark):
    rng = random.Random(11)
    made = [random_file(rng, i) for i in range(400)]
    frame = spark.createDataFrame([m[0] for m in made], FILES)
    got = {}
    for r in D.diff_lines(frame).orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append((r.ord, (r.line_type, r.old_line, r.new_line, r.content, r.old_content)))
    separators = 0
    for (path, *_), old, new, chunks in made:
        expected = loop_rows(old, new, chunks) if chunks else []
        rows = got.get(path, [])
        assert [o for o, _ in rows] == list(range(len(rows)))
        assert [r for _, r in rows] == expected, path
        separators += sum(r[3] == "..." for r in expected)
    assert separators > 50


def test_split_rows_match_the_loop(spark):
    rng = random.Random(12)
    made = [random_file(rng, i) for i in range(150)]
    frame = spark.createDataFrame([m[0] for m in made], FILES)
    got = {}
    for r in D.split_rows(frame).orderBy("path", "ord").collect():
        cells = tuple(None if c is None else (c.line, c.content, c.line_type) for c in (r.left, r.right))
        got.setdefault(r.path, []).append(cells)
    for (path, *_), old, new, chunks in made:
        rows, expected, i = loop_rows(old, new, chunks) if chunks else [], [], 0
        while i < len(rows):
            kind, a, b, content, before = rows[i]
            if kind == "context":
                expected.append(((a, content, kind) if a else None, (b, content, kind) if b else None))
            elif kind == "modification":
                expected.append(((a, before, "deletion"), (b, content, "addition")))
            elif kind == "addition":
                expected.append((None, (b, content, kind)))
            elif i + 1 < len(rows) and rows[i + 1][0] == "addition":
                expected.append(((a, content, kind), (rows[i + 1][2], rows[i + 1][3], "addition")))
                i += 1
            else:
                expected.append(((a, content, kind), None))
            i += 1
        assert got.get(path, []) == expected, path


def test_one_change_in_ten_lines(spark):
    old = [f"line {i}" for i in range(1, 11)]
    new = [*old[:5], "changed", *old[6:]]
    frame = spark.createDataFrame([file("a.zig", old, new, [[(side(5, old[5]), side(5, "changed"))]])], FILES)
    rows = D.diff_lines(frame).orderBy("ord").collect()
    assert [r.line_type for r in rows] == ["context"] * 3 + ["modification"] + ["context"] * 3
    assert [r.new_line for r in rows] == [3, 4, 5, 6, 7, 8, 9]
    assert not rows[3].is_partial_change


def test_inserted_line_shifts_what_follows(spark):
    frame = spark.createDataFrame(
        [file("a.zig", ["a", "b", "c"], ["a", "x", "b", "c"], [[(None, side(1, "x"))]])], FILES
    )
    rows = D.diff_lines(frame).orderBy("ord").collect()
    assert [(r.old_line, r.new_line) for r in rows] == [(1, 1), (None, 2), (2, 3), (3, 4)]


def test_span_fallback_for_pairs_without_tokens(spark):
    frame = spark.createDataFrame(
        [file("a.zig", ["Hello beautiful world"], ["Hello world"], [[(side(0), side(0))]])], FILES
    )
    row = D.diff_lines(frame).first()
    assert [(c.start, c.end, c.highlight) for c in row.old_changes] == [(6, 16, "novel")]
    assert row.changes == [] and row.is_partial_change


@pytest.mark.parametrize(
    "status, kind, numbers",
    [
        ("added", "addition", [(None, 1), (None, 2)]),
        ("removed", "deletion", [(1, None), (2, None)]),
        ("unchanged", "context", [(1, 1), (2, 2)]),
        ("changed", None, []),
    ],
)
def test_files_without_chunks(spark, status, kind, numbers):
    frame = spark.createDataFrame([file("a", ["x", "y"], ["x", "y"], [], status)], FILES)
    rows = D.diff_lines(frame).orderBy("ord").collect()
    assert [(r.old_line, r.new_line) for r in rows] == numbers
    assert all(r.line_type == kind for r in rows)


def test_binary_files_have_no_rows(spark):
    frame = spark.createDataFrame([file("a", ["x"], ["x"], [], "added", binary=True)], FILES)
    assert D.diff_lines(frame).count() == 0


def test_same_versions_give_counts_but_no_rows(spark):
    frame = spark.createDataFrame([file("a", ["x"], ["x"], [[(side(0), side(0))]])], FILES)
    counts = E.line_counts(E.diff_entries(frame)).first()
    assert counts.lines_modified == 1
    assert D.diff_lines(frame).count() == 0


def test_rows_of_a_file_with_many_lines(spark):
    n = 30000
    old = [f"l{i}" for i in range(n)]
    new = [f"l{i}" if i % 10 else f"n{i}" for i in range(n)]
    chunks = [[(side(i), side(i))] for i in range(0, n, 10)]
    frame = spark.createDataFrame([file("big", old, new, chunks)], FILES)
    rows = D.diff_lines(frame)
    assert rows.filter("line_type = 'modification'").count() == n // 10
    offsets = D.line_offsets(frame).orderBy("line").collect()
    assert offsets[-1].byte_offset == sum(len(x) + 1 for x in new[:-1])


def test_plan_has_no_shuffle(spark):
    frame = spark.createDataFrame([file("a", ["x"], ["y"], [[(side(0), side(0))]])], FILES)
    for rows in (D.diff_lines(frame), E.diff_entries(frame), D.line_offsets(frame)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
