"""Sentence units in many scripts, and their invariants."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wanderframe.llm import sentences as s

CASES = [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]),
    ("Dr. L. Isterra measured 1.5 s at 5 p.m. on the host. Next.", ["Dr. L. Isterra measured 1.5 s at 5 p.m. on the host.", "Next."]),
    ("It skips blanks, etc. The rest stays.", ["It skips blanks, etc.", "The rest stays."]),
    ("It skips blanks, etc. and goes on.", ["It skips blanks, etc. and goes on."]),
    ('She wrote "stop." on the board. Done.', ['She wrote "stop." on the board.', "Done."]),
    ('The log says: "None left." slot_a counts.', ['The log says: "None left."', "slot_a counts."]),
    ('"Does it stop?" asks the sink, and waits. Yes.', ['"Does it stop?" asks the sink, and waits.', "Yes."]),
    ("(This holds.) score is unsigned. It is (see there.) odd.", ["(This holds.)", "score is unsigned.", "It is (see there.) odd."]),
    ("(This holds.) It does.", ["(This holds.)", "It does."]),
    ("Wait... it is not sorted. Who knows… The end.", ["Wait... it is not sorted.", "Who knows…", "The end."]),
    ("# Head line\nText one.\nText\ntwo.\n\n- item a\n- item b. More.\n1. first", ["Head line", "Text one.", "Text\ntwo.", "item a", "item b.", "More.", "first"]),
    ("Siehe Abb. 132 und Nr. 584. Das gilt z. B. hier. Am 12. März ist Ruhe.", ["Siehe Abb. 132 und Nr. 584.", "Das gilt z. B. hier.", "Am 12. März ist Ruhe."]),
    ("„Ist er fertig?“, fragt er. « Est-ce fini ? » demande-t-il.", ["„Ist er fertig?“, fragt er.", "« Est-ce fini ? » demande-t-il."]),
    ("「終わりましたか？」と尋ねる。記録：「もうない。」次。", ["「終わりましたか？」と尋ねる。", "記録：「もうない。」", "次。"]),
    ("路径很长……但是有效。真的吗？！（成立。）好", ["路径很长……但是有效。", "真的吗？！", "（成立。）", "好"]),
    ("กราฟว่างอยู่ ค่า 2.67 มากเกินไป อย่าลบ a.py ก่อน", ["กราฟว่างอยู่", "ค่า 2.67 มากเกินไป", "อย่าลบ a.py ก่อน"]),
    ("Γιατί σταματά ο γράφος; Δες π.χ. το σχέδιο.", ["Γιατί σταματά ο γράφος;", "Δες π.χ. το σχέδιο."]),
    ("नोड खाली है। क्यों?", ["नोड खाली है।", "क्यों?"]),
    ('An open " quote. Does not swallow.', ['An open " quote.', "Does not swallow."]),
    ("﻿# Title\r\n\r\nA b.\r\nC d", ["Title", "A b.", "C d"]),
    ("", []),
    (" \n\t\n", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert [text[a:b] for a, b in s.sentences(text)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?…\n\"()“”「」。-#1ก;é\r", max_size=80))
def test_offsets_are_ordered_and_cover_the_text(text):
    spans = s.sentences(text)
    assert all(a < b for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


def test_comments_keep_their_place():
    code = 'x = "# no" # First one. Second\n# goes on.\ny = 1\n# Last'
    masked = s.comments_only(code, "python")
    assert len(masked) == len(code)
    assert [code[a:b] for a, b in s.sentences(masked)] == ["First one.", "Second\n# goes on.", "Last"]


def noted(code, language="", path=""):
    masked = s.comments_only(code, language, path)
    assert len(masked) == len(code)
    return [code[a:b] for a, b in s.sentences(masked)]


UNNAMED = [
    ('def f(a):\n    """One. Two."""\n    return a // 2  # Three.\n', "", ["One.", "Two.", "Three."]),
    ("-- One. Two.\nCREATE TABLE t (\n  a BIGINT, -- Three.\n  b DOUBLE\n);\n", "x.txt", ["One.", "Two.", "Three."]),
    ("<!-- One. Two. -->\n<p>No.</p>\n", "", ["One.", "Two."]),
    ('#include <a>\n#define B 1\nint x = 1; // One. Two.\nx--;\n', "x.cpp", ["One.", "Two."]),
    ("#[derive(Debug)]\npub struct A {} /* One. */\n", "x.rs", ["One."]),
    ("# One.\nconstexpr int a = 0;\n", "x.rs", ["One."]),
    ("# One\n<!-- Two. -->\n<p></p>\n", "x.html", ["One", "Two."]),
    ('a = {\n    "b": 1,  # One.\n}\n', "x.py", ["One."]),
    ("0x1 # One.\n\n0x2 // Two.\n\n0x3 -- Three.\n\n<!-- Four. -->\n\n/* Five. */\n\n0x4 http://no\n\n\"\"\"Six.\"\"\"", "", ["One.", "Two.", "Three.", "Four.", "Five.", "Six."]),
]


@pytest.mark.parametrize(("code", "path", "want"), UNNAMED)
@pytest.mark.parametrize("language", ["", "no_such_language"])
def test_comments_of_unnamed_languages(code, path, want, language):
    assert noted(code, language, path) == want


def test_unnamed_language_in_spark(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, '"""A."""\n', None, "b.py"), (2, "-- A.\n0x1", None, "b.sql"), (3, "#define A\n", None, None)], "doc_id long, text string, prog_lang string, path string")
    found = s.split_sentences(df, kind=F.lit("code"), language=F.col("prog_lang"), path=F.col("path"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3, 5), (2, 3, 5)]


def test_in_spark(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "prose"), (1, "A b. C d.", "prose"), (2, None, "prose"), (3, "", "code"), (4, "// One. Two.\nint x;", "code")], "doc_id long, text string, kind string").selectExpr("*", "1 AS sent_start")
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in s.split_sentences(df, kind=F.col("kind")).collect())
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (4, 3, 7), (4, 8, 12)]
    assert s.split_sentences(df.limit(0)).count() == 0
    lists = spark.createDataFrame([(1, LISTS)], "doc_id long, text string")
    assert sorted(r.list_level for r in s.split_sentences(lists, levels=True).collect()) == [0, 0, 1, 1, 1, 1, 2, 2, 2, 3]


@pytest.mark.parametrize("unit", ["路径很长。真的吗！好“对。”", "กราฟว่างอยู่", "a.b", '"a."b', "am 1. ", "1. ", "- x\n", '"!', "(", "\n"])
def test_linear_without_blanks(unit):
    """400,000 characters of any script in one piece take as long as with blanks in them."""
    import time

    text = unit * (400_000 // len(unit))
    began = time.process_time()
    spans = s.sentences(text)
    assert time.process_time() - began < 2
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    if unit[0] == "路":
        assert len(spans) == 2 * (len(text) // len(unit)) + 1


LISTS = "- Top one. Two.\n  - Inner “one. two” here.\n    go on.\n\n    Below inner.\n  - 1. Third.\n\n Behind.\n\nOut.\n# Head\n- Last"


def test_list_levels():
    got = [(LISTS[a:b], n) for a, b, n in s.leveled_sentences(LISTS)]
    assert got == [
        ("Top one.", 1), ("Two.", 1), ("Inner “one. two” here.", 2), ("go on.", 2), ("Below inner.", 2), ("Third.", 3), ("Behind.", 1), ("Out.", 0), ("Head", 0), ("Last", 1),
    ]


def test_a_list_level_is_not_closed_by_marks():
    """Closing marks above an open list level close nothing, and what opened in an item does not reach the next."""
    text = "- A (b.\n- c ) d. Ef\n  - ) F g. “G."
    assert [text[a:b] for a, b in s.sentences(text)] == ["A (b.", "c ) d.", "Ef", ") F g.", "“G."]


def test_very_long_text():
    text = "word " * 200_000 + "end. " + "x" * 300_000
    assert [b - a for a, b in s.sentences(text)] == [1_000_004, 300_000]
