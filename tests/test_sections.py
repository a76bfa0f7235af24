"""Bracketed sections and objects, worked out by hand."""

from __future__ import annotations

import time

from fathomline.operators.sections import Text, named_objects

SETTINGS = """const levels = [ // not ] yet
  { name: 'A } b', code: "x]", least: 10, deep: { name: 'inner' } },
  /* { name: 'gone' } */
  { "name": `tpl ${a} }`, 'code': y.z },
];
const other = { levels: 3 };
use(levels, [ { name: 'late' } ]);
levels; // levels [ { name: 'no' } ]
"""


def test_strings_and_comments_count_for_nothing():
    t = Text(SETTINGS)
    found = [(name, [(t.line(a), t.line(b), t.properties(a, b)) for a, b in t.objects(first, last)]) for name, first, last in t.sections(["levels"])]
    assert found == [
        ("levels", [(2, 2, {"name": "A } b", "code": "x]", "least": "10"}), (4, 4, {"name": "tpl ${a} }", "code": "y.z"})]),
        ("levels", [(7, 7, {"name": "late"})]),
    ]


def test_unclosed_and_stray_brackets():
    assert list(Text("levels = [ { a: 1 }").sections(["levels"])) == []
    t = Text("} ] levels = [ { a: 1 } ] ]")
    assert [t.properties(a, b) for _, x, y in t.sections(["levels"]) for a, b in t.objects(x, y)] == [{"a": "1"}]
    assert list(Text("levels = [ { a: [1 } ]").sections(["levels"])) == []  # the one bracket that closes belongs to the inner one
    assert list(Text("").sections(["levels"])) == [] and list(Text("sublevels = [ ]; levels2 = []").sections(["levels"])) == []


def test_time_in_proportion():
    def seconds(n):
        text = "levels = [ {\n" * n
        began = time.process_time()
        list(Text(text).sections(["levels"]))
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.01)


def test_rows(spark):
    files = spark.createDataFrame([(1, SETTINGS), (2, None), (3, "nothing")], "file_id int, content string")
    got = named_objects(files, ["file_id"], ["levels", "missing"]).orderBy("section", "place").collect()
    assert [(r.file_id, r.name, r.section, r.place, r.start_line, r.properties["name"]) for r in got] == [(1, "levels", 1, 1, 2, "A } b"), (1, "levels", 1, 2, 4, "tpl ${a} }"), (1, "levels", 2, 1, 7, "late")]
