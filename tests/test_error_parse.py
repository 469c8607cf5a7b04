"""The minimum-cost parse against a plain reading of the rules, one character at a time."""

from __future__ import annotations

import random
import re

import numpy as np

from wanderframe.operators import error_parse as e

LAYOUTS = [
    e.Layout(1, " ", ("src", "dst", "weight"), 3, None, 4000),
    e.Layout(2, ",", ("src", "dst"), 2, '"', 1000),
    e.Layout(3, ",", ("src", "dst", "weight"), 3, '"', 1000),
    e.Layout(4, "\t", ("src", "dst", "weight"), 3, None, 1000),
    e.Layout(5, "|", ("src", "dst", "weight", "etype"), 4, '"', 65536),
]


def plain_fields(layout, line):
    """Fields of a line, or None where its quoting is broken."""
    blanks = " \t".replace(layout.separator, "") if layout.separator == "\t" else " \t"
    if layout.separator == " ":
        return line.strip(" \t").replace("\t", " ").split()
    if not layout.quote:
        return [f.strip(blanks) for f in line.split(layout.separator)]
    out, k = [], 0
    while True:
        while k < len(line) and line[k] in blanks:
            k += 1
        if k < len(line) and line[k] == layout.quote:
            k += 1
            text = ""
            while True:
                if k >= len(line):
                    return None
                if line[k] == layout.quote:
                    if line[k + 1 : k + 2] == layout.quote:
                        text += layout.quote
                        k += 2
                        continue
                    break
                text += line[k]
                k += 1
            k += 1
            while k < len(line) and line[k] in blanks:
                k += 1
            if k < len(line) and line[k] != layout.separator:
                return None
        else:
            end = line.find(layout.separator, k)
            end = len(line) if end < 0 else end
            text = line[k:end].strip(blanks)
            if layout.quote in text:
                return None
            k = end
        out.append(text)
        if k >= len(line):
            return out
        k += 1


def plain_reason(layout, line):
    fields = plain_fields(layout, line)
    if fields is None:
        return "quoting"
    if len(fields) != layout.n_columns:
        return "column_count"
    for name, f in zip(layout.columns, fields, strict=True):
        if name in ("src", "dst") and not (re.fullmatch("[0-9]+", f) and int(f) < layout.v_num):
            return name
        if name == "weight" and not (re.fullmatch(r"\+?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", f) and float(f) < float("inf")):
            return "data"
        if name == "etype" and f not in list("01234"):
            return "data"
    return None


def lines_for(layout, rnd, n):
    s = layout.separator
    piece = ["1", "23", "999", "4000", "0007", "1.5", "+2e3", "1e999", ".5", "x", "", " ", "\t", s, s, s, '"', '"', '""', "é", "#"]
    for _ in range(n):
        if rnd.random() < 0.5:
            fields = [rnd.choice(["12", '"34"', ' "5" ', "6 ", '"7', '8"', '"a""b"', "1.25", "3", ""]) for _ in range(rnd.choice([layout.n_columns] * 4 + [1, 5]))]
            yield s.join(fields)
        else:
            yield "".join(rnd.choices(piece, k=rnd.randint(1, 12)))


def read(layout, lines):
    """Rows (reason, quote edits, delimiter edits, edits, src, dst, weight, etype) of lines that are records."""
    raw = [x.encode() for x in lines]
    out = e.Parser(layout).read(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw]))
    return list(zip(*(x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() for x in out.values()), strict=True))


def test_equals_plain_reading():
    rnd = random.Random(11)
    for layout in LAYOUTS:
        lines = [x for x in lines_for(layout, rnd, 6000) if x.strip(" \t") and x.strip(" \t")[0] != "#"]
        for line, got in zip(lines, read(layout, lines), strict=True):
            assert got[0] == plain_reason(layout, line), (layout, line)
            assert (got[1] + got[2] > 0) == (got[0] in ("quoting", "column_count")) == bool(got[3]), (layout, line, got)
            if got[0] is None:
                values = dict(zip(layout.columns, plain_fields(layout, line), strict=True))
                want = [int(values["src"]), int(values["dst"]), float(values["weight"]) if "weight" in values else None, int(values["etype"]) if "etype" in values else None]
                assert list(got[4:]) == want, (layout, line)
            else:
                assert list(got[4:]) == [None] * 4


def repaired(line, edits, layout):
    """The line behind the edits that the parse names."""
    out, k = "", 0
    for op, at in [(x[:2], int(x.rsplit(" ", 1)[1])) for x in (edits or "").split("; ") if x]:
        out += line[k:at] + (op[1] if op[0] == "+" else "")
        k = at + (op[0] == "-")
    return out + line[k:]


def fewest(layout, line, most=4):
    """Least edits, by breadth-first search over inserted and deleted quotes and separators."""
    marks = layout.separator + (layout.quote or "")
    seen, level = {line}, {line}
    for n in range(most):
        if any((f := plain_fields(layout, x)) is not None and len(f) == layout.n_columns for x in level):
            return n
        level = {x[:k] + x[k + 1 :] for x in level for k in range(len(x)) if x[k] in marks} | {x[:k] + c + x[k:] for x in level for k in range(len(x) + 1) for c in marks}
        level -= seen
        seen |= level
    return most


def test_edits_are_the_fewest():
    rnd = random.Random(5)
    for layout in LAYOUTS[1:]:
        q, s = layout.quote or "x", layout.separator
        lines = ["".join(rnd.choices([q, s, "1", "23", " "], [3, 3, 3, 1, 1], k=rnd.randint(1, 7))) for _ in range(60)]
        lines = [x for x in lines if x.strip(" \t")] + [f"{q}1{q} {q}2{q}{s}3", f"{q}1{s}2", f"1{q}2{s}3", f"{q}a{q}{q}b{s}1", "1"]
        for line, got in zip(lines, read(layout, lines), strict=True):
            n = got[1] + got[2]
            assert min(n, 4) == fewest(layout, line), (layout, line, got)
            fields = plain_fields(layout, repaired(line, got[3], layout))
            assert fields is not None and len(fields) == layout.n_columns, (layout, line, got)


def test_a_missing_delimiter_between_quoted_fields():
    assert read(LAYOUTS[2], ['"1" "2",3'])[0][:4] == ("quoting", 0, 1, "+, at 3")


def test_repairs_keep_valid_fields():
    """Among equally many edits the fields of valid form decide, then the fewest quotes."""
    assert read(LAYOUTS[2], ["1,2 3.5", "1,2,,3.5", '1,"2,3.5', "x,1,2,3.5"])[0][3] == "+, at 3"
    got = [r[3] for r in read(LAYOUTS[2], ["1,2,,3.5", '1,"2,3.5', "1,2,3.5,"])]
    assert [repaired(x, k, LAYOUTS[2]) for x, k in zip(["1,2,,3.5", '1,"2,3.5', "1,2,3.5,"], got, strict=True)] == ["1,2,3.5", "1,2,3.5", "1,2,3.5"]


def test_files_separated_by_blanks():
    """A run of blanks is one delimiter, a missing field takes one inserted delimiter."""
    got = read(LAYOUTS[0], ["1 2", "1 2 3 4", " 1\t 2  3 ", "1", "1  2   3    4     5"])
    assert [(r[0], r[1], r[2]) for r in got] == [("column_count", 0, 1), ("column_count", 0, 1), (None, 0, 0), ("column_count", 0, 2), ("column_count", 0, 2)]


def test_patterns_are_forgotten(monkeypatch):
    monkeypatch.setattr(e, "MOST_PATTERNS", 3)
    p = e.Parser(LAYOUTS[1])
    for line, want in [("1,2", None), ("1", "column_count"), ('"1,2', "quoting"), ("x,2", "src"), ("1,x", "dst"), ("1,2", None), ("1", "column_count")] * 3:
        assert p.read(np.frombuffer(line.encode(), np.uint8), np.array([len(line)]))["reason"].to_pylist() == [want]
    assert len(p.known) <= 5


def test_cases_in_spark(spark):
    files = spark.createDataFrame([(1, "a.txt", " ", 3, "src,dst,weight", None, 100), (2, "b.csv", ",", 2, "src,dst", '"', 100)], "file_id int, file_name string, separator string, n_columns int, column_names string, quote_char string, v_num long")
    rows = [
        (1, 1, "1 2 3.5"), (2, 1, None), (3, 1, ""), (4, 1, " \t\r"), (5, 1, "  # note"), (6, 1, "\t07  8\t+1e1 \r"), (7, 1, "1 2 3\r\r"),
        (8, 2, '"1","2"'), (9, 2, '"1,2'), (10, 2, "1,2,3"), (11, 2, "100,2"), (12, 2, "1,x"), (13, 3, "1 2"), (14, 1, "1 2 1e999"), (8, 2, '"1","2"'),
        (15, None, "1 2"), (16, 1, "1 2 " + "9" * 300), (17, 1, "1" * 400 + " 2 3"), (18, 2, '"' + "a" * 500_000 + '",2'),
    ]
    lines = spark.createDataFrame([(*r, "clash") for r in rows], "line_id long, file_id int, line string, src string")
    got = e.parse_lines(lines, files).collect()
    reasons = sorted((r.line_id, r.reason) for r in got if r.reason)
    assert reasons == [(7, "data"), (9, "quoting"), (10, "column_count"), (11, "src"), (12, "dst"), (13, "layout"), (14, "data"), (15, "layout"), (17, "src"), (18, "src")]
    good = sorted((r.line_id, r.src, r.dst, r.weight) for r in got if not r.reason and r.line_id != 16)
    assert good == [(1, 1, 2, 3.5), (6, 7, 8, 10.0), (8, 1, 2, None), (8, 1, 2, None)]
    assert e.parse_lines(lines.limit(0), files).count() == 0


def test_long_patterns_block_by_block(monkeypatch):
    """Followed back in blocks the parse is the same; its memory does not grow with the line."""
    import tracemalloc

    rnd = random.Random(3)
    lines = ["".join(rnd.choices(['"', ",", "1", " ", "x"], k=rnd.randint(20, 60))).strip() or "1" for _ in range(60)]
    want = read(LAYOUTS[2], lines)
    monkeypatch.setattr(e, "LONG_PATTERN", 10)
    monkeypatch.setattr(e.Steps, "BLOCK", 8)
    assert read(LAYOUTS[2], lines) == want
    monkeypatch.undo()
    tracemalloc.start()
    assert read(LAYOUTS[2], ["1," * 20_000])[0][:3] == ("column_count", 2, 0)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_very_long_lines():
    layout = LAYOUTS[2]
    lines = ['"' + "a" * 500_000 + '",2,3', "1" * 500_000 + ",2,3", "a1." * 100_000 + ",2", "0" * 300 + "7,2,3.5", "7,2," + "0" * 399 + "4"]
    got = read(layout, lines)
    assert [r[0] for r in got] == ["src", "src", "column_count", None, None] and got[3][4:7] == (7, 2, 3.5) and got[4][6] == 4.0
    assert read(LAYOUTS[3], ["1\t" * 3000 + "1"])[0][:3] == ("column_count", 0, 2998)
    many = read(layout, ["1," * 3000 + "1", '"' * 3001])
    assert many[0][:3] == ("column_count", 2, 0) and many[1][0] == "quoting"  # two quotes make text of the fields between them
