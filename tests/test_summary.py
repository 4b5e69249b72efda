"""The summary in a file's row against the one by joins, and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from changelens.operators import constructs as C
from changelens.operators import entries as E
from changelens.operators import outline as O
from changelens.operators import regions as R
from changelens.operators import summary as S
from changelens.operators.difflines import file_rows, split_rows
from changelens.operators.navigation import split_flag_rows
from changelens.schemas import FILES

SCHEMA = (
    FILES + ", regions array<struct<side:string,start_line:bigint,end_line:bigint,header_end_line:bigint,node_type:string,name:string,"
    "collapsed:boolean,level:bigint>>"
)
KINDS = ["function", "struct_", "enum_", "union_", "test_decl", "class", "unheard_of"]


def random_rows(seed, n):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        size = rnd.randint(0, 40)
        chunks, at = [], 0
        while at < size and rnd.random() < 0.9:
            chunk = []
            for _ in range(rnd.randint(1, 4)):
                at += rnd.randint(1, 4)
                span = [(0, 3, rnd.choice(["abc", "  ", "#x"]), rnd.choice(["comment", "novel", "normal"]))]
                lhs = (at, span) if rnd.random() < 0.8 else None
                rhs = (at + rnd.randint(-1, 1) % 3, span) if rnd.random() < 0.8 or lhs is None else None
                chunk.append((lhs, rhs))
            chunks.append(chunk)
        regions = []
        for _ in range(rnd.randint(0, 14)):
            start = rnd.randint(1, 40)
            end = start + rnd.randint(0, 9)
            name = rnd.choice(["", "a", "b", "c", f"u{rnd.randint(0, 30)}"])
            regions.append((rnd.choice(["old", "new"]), start, end, start, rnd.choice(KINDS), name, rnd.random() < 0.5, rnd.randint(1, 2)))
        text = "\n".join(f"line {k}" for k in range(45))
        path = f"p{i}.{rnd.choice(['rs', 'py', 'md'])}"
        rows.append((path, "rust", "changed", False, text, text, chunks if i % 9 else None, regions))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(random_rows(4, 160), SCHEMA).cache()


def tuples(df):
    columns = sorted(df.columns)
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


def test_constructs_and_counters_equal_the_joined_ones(spark, frame):
    regions = frame.select("path", F.inline("regions"))
    lines = E.changed_lines(E.plain_entries(frame))
    assert tuples(S.changed_constructs(frame)) == tuples(C.changed_constructs(regions, lines))
    assert tuples(S.file_summary(frame)) == tuples(C.file_summary(frame, regions)[1])
    plan = S.file_summary(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_many_regions_of_one_name(spark):
    n = 5000
    regions = [(side, 3 * i + 1, 3 * i + 2 + (side == "new" and i == n - 1), 3 * i + 1, "function", "same", True, 1) for i in range(n) for side in ("old", "new")]
    regions += [("old", 1, 2, 1, "function", f"only{i}", True, 1) for i in range(100)]
    chunks = [[(None, (3 * i, [(0, 1, "x", "novel")]))] for i in range(0, n, 10)]
    frame = spark.createDataFrame([("a.rs", "rust", "changed", False, "", "", chunks, regions)], SCHEMA)
    row = S.file_summary(frame).first()
    # Every new region is matched with the last old one of its name, whose size is 1.
    assert (row.functions_modified, row.functions_added, row.functions_deleted) == (n // 10 + 1, 0, 100)
    assert row.lines_added == n // 10


def test_items_and_places(spark, frame):
    rows = S.with_items(frame).cache()
    listed = sorted((r.path, r.line_start, r.change_type, r.name) for r in S.changed_constructs(frame).filter("category = 'semantic'").collect())
    got = rows.select("path", F.posexplode("items").alias("nth", "c")).orderBy("path", "nth").collect()
    assert [(r.path, r.c.line_start, r.c.change_type, r.c.name) for r in got] == listed
    places = spark.range(0, len(listed) + 5, 2).withColumnRenamed("id", "place")
    made = sorted((r.place, r.path, r.construct.line_start, r.construct.change_type, r.construct.name) for r in S.items_at(rows, places).collect())
    assert made == [(k, *listed[k]) for k in range(0, len(listed), 2)]


def test_regions_in_the_row_equal_the_exploded_ones(spark):
    code = "mod a {\n    fn b() {\n        one();\n    }\n}\nfn c() {\n    two();\n}\n"
    rows = [(f"f{i}.rs", "rust" if i else "json", "changed", False, code * (i + 1), None if i == 2 else code, None) for i in range(4)]
    files = spark.createDataFrame(rows, FILES)
    assert tuples(O.with_regions(files).select("path", F.inline("regions"))) == tuples(O.find_regions(files))


def test_flags_of_split_rows_match_the_loop(spark, frame):
    shown = {(r.path, r.ord): r for r in split_flag_rows(file_rows(frame, keep=["regions"])).collect()}
    kept = {(r.path, r.ord) for r in R.visible_split_rows(file_rows(frame, keep=["regions"])).collect()}
    folds = {r.path: [x for x in r.regions if x.collapsed] for r in frame.collect()}
    rows = split_rows(frame).collect()
    assert len(rows) == len(shown) > 500
    for r in rows:
        inside = lambda cell, side: cell is not None and any(x.side == side and x.header_end_line < cell.line <= x.end_line for x in folds[r.path])  # noqa: B023, E731
        visible = not (inside(r.left, "old") or inside(r.right, "new"))
        assert (shown[r.path, r.ord].visible, shown[r.path, r.ord].navigable) == (visible, visible and r.selectable)
        assert ((r.path, r.ord) in kept) == visible
