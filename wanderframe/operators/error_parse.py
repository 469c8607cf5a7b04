"""Minimum-cost error parse of delimited text lines.

A grammar says what a well-formed line of a layout is: so many fields, blanks
around them, fields in quotation marks, separators between them.  A parse
state holds the place in that grammar, the column, and how far the field is on
its way through the form of its type.  Dynamic programming over the characters
finds the least number of quotes and delimiters to insert or delete that leads
to the end of the last column, among these repairs the one with the most
fields of valid form, and among those the one with the fewest quote edits.
Following it back gives the edit operations and the fields.

A line that needs no edit and whose fields have valid form and value loads.
Otherwise the reason is the first grammar in a nest that the line is outside
of: well quoted lines of any number of columns (`quoting`), of the declared
number (`column_count`), with valid fields (`src`, `dst`, `data`).

What decides the parse is the sequence of character classes, in which a run
of one class counts as two characters: the edits inside a run cost the same
from its second character on.  Lines share few such patterns, so a worker
parses each pattern once and remembers it, and the fields of all lines are cut
out and read in NumPy.  In files separated by blanks a run of blanks is one
delimiter, and a field that is missing takes one inserted delimiter.

Results by case: null lines, empty or blank lines and comments are no records
and give no row; lines of a file without a layout give the reason `layout`;
lines of any length are parsed whole; repeated lines give repeated rows; an
empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# classes of characters; those up to OTHER are plain text
LOW, HIGH, DOT, PLUS, MINUS, EXPONENT, OTHER, BLANK, SEPARATOR, QUOTE = range(10)
START, OPEN, GAP, QUOTED, CLOSING, AFTER = range(6)
#: Costs of an edit, of a field without valid form, and of a quote edit over a delimiter edit.
EDIT, FORM, MARK = 1 << 12, 1 << 6, 1
FAR = 1 << 30
#: Costs (patterns x characters x states) that one pass holds.
CELLS = 1 << 22
#: Patterns of more characters are followed back block by block, so that their costs take no memory by their length.
LONG_PATTERN = 1 << 13
#: Patterns that a worker remembers for a layout before it starts afresh.
MOST_PATTERNS = 100_000
#: Plain text of more characters than this in one piece is no number, whatever it holds.
LONG_TEXT = 400
#: Layouts are one for each file and go to all tasks; more are refused.
MOST_LAYOUTS = 100_000

OUT = "line_id long, file_id int, reason string, quote_edits int, delimiter_edits int, edits string, src long, dst long, weight double, etype int"
SCHEMA = pa.schema(
    [("line_id", pa.int64()), ("file_id", pa.int32()), ("reason", pa.string()), ("quote_edits", pa.int32()), ("delimiter_edits", pa.int32()), ("edits", pa.string())]
    + [("src", pa.int64()), ("dst", pa.int64()), ("weight", pa.float64()), ("etype", pa.int32())]
)

# forms of fields: for each form its moves (place, class) -> place, its accepting places, and the place of no return
DIGITS = (LOW, HIGH)
FORMS: dict[str, tuple[dict[tuple[int, int], int], set[int], int]] = {
    "id": ({(p, c): 1 for p in (0, 1) for c in DIGITS}, {1}, 2),
    "etype": ({(0, LOW): 1}, {1}, 2),
    "weight": (
        {(p, c): to for p, to in ((0, 2), (1, 2), (2, 2), (3, 4), (4, 4), (5, 7), (6, 7), (7, 7)) for c in DIGITS}
        | {(0, PLUS): 1, (2, DOT): 3, (2, EXPONENT): 5, (4, EXPONENT): 5, (5, PLUS): 6, (5, MINUS): 6},
        {2, 4, 7},
        8,
    ),
    "any": ({}, {0}, 0),
}
FORM_OF = {"src": "id", "dst": "id", "weight": "weight", "etype": "etype"}


@dataclass(frozen=True)
class Layout:
    file_id: int
    separator: str
    columns: tuple[str, ...]
    n_columns: int
    quote: str | None
    v_num: int

    @property
    def by_runs(self) -> bool:
        return self.separator == " "

    def form(self, column: int) -> str:
        return FORM_OF.get(self.columns[column], "any") if column < len(self.columns) else "any"


State = tuple[int, int, int]  # mode, column, place in the column's form


@dataclass
class Grammar:
    """States of a layout and the edges between them: edges[class] and inserts as (from, to, cost, operation) in arrays ordered by `to`."""

    layout: Layout
    states: dict[State, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        queue = deque([(START, 0, 0)])
        self.states[START, 0, 0] = 0
        moves, inserts = [], []
        while queue:
            s = queue.popleft()
            found = [(c, to, cost, "") for c in range(10) if (m := self.free(s, c)) for to, cost in [m]]
            found += [(c, s, EDIT + MARK * (c == QUOTE), "-" + self.sign(c)) for c in (SEPARATOR, QUOTE, BLANK) if self.deletable(c)]
            moves += [(s, *x) for x in found]
            added = list(self.inserted(s))
            inserts += [(s, *x) for x in added]
            for to in [x[1] for x in found] + [x[0] for x in added]:
                if to not in self.states:
                    self.states[to] = len(self.states)
                    queue.append(to)
        at = self.states
        self.edges = [self.table([(at[s], at[to], cost, op) for s, own, to, cost, op in moves if own == c]) for c in range(10)]
        self.inserts = self.table([(at[s], at[to], cost, op) for s, to, cost, op in inserts])
        self.arrays = [self.as_arrays(e) for e in self.edges]
        self.insert_arrays = self.as_arrays(self.inserts)
        self.into = [self.by_target(e) for e in self.edges]
        self.put_into = self.by_target(self.inserts)
        self.named = list(self.states)
        self.ending = np.array([self.end_cost(s) for s in self.named])

    @staticmethod
    def table(edges: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
        return sorted(edges, key=lambda e: e[1])

    @staticmethod
    def as_arrays(edges: list[tuple[int, int, int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, cost, first edge of each target, the targets)"""
        s, to, cost = (np.array([e[k] for e in edges], np.int64) for k in range(3))
        first = np.flatnonzero(np.diff(to, prepend=-1))
        return s, cost, first, to[first]

    @staticmethod
    def by_target(edges: list[tuple[int, int, int, str]]) -> dict[int, list[tuple[int, int, str]]]:
        out: dict[int, list[tuple[int, int, str]]] = {}
        for s, to, cost, op in edges:
            out.setdefault(to, []).append((s, cost, op))
        return out

    def sign(self, c: int) -> str:
        return self.layout.quote if c == QUOTE else self.layout.separator

    def deletable(self, c: int) -> bool:
        return c == SEPARATOR and not self.layout.by_runs or c == QUOTE and bool(self.layout.quote) or c == BLANK and self.layout.by_runs

    def invalid(self, column: int, place: int) -> int:
        """What a field costs that ends at this place of its form."""
        return 0 if place in FORMS[self.layout.form(column)][1] else FORM

    def step(self, column: int, place: int, c: int) -> int:
        moves, _, lost = FORMS[self.layout.form(column)]
        return moves.get((place, c), lost)

    def closed(self, column: int, place: int) -> tuple[State, int] | None:
        """Behind the delimiter of a column.  In files separated by blanks the last column may have one as well."""
        last = self.layout.n_columns - (0 if self.layout.by_runs else 1)
        return ((START, column + 1, 0), self.invalid(column, place)) if column < last else None

    def free(self, s: State, c: int) -> tuple[State, int] | None:
        mode, column, place = s
        runs, full = self.layout.by_runs, s[1] >= self.layout.n_columns
        if c == SEPARATOR and runs:
            return None
        if mode == QUOTED:
            return ((CLOSING, column, place) if c == QUOTE else (QUOTED, column, self.step(column, place, c))), 0
        if c == SEPARATOR:
            return self.closed(column, place)
        if c == BLANK:
            if mode == START:
                return s, 0
            return self.closed(column, place) if runs else (({OPEN: GAP, CLOSING: AFTER}.get(mode, mode), column, place), 0)
        if full:
            return None
        if c == QUOTE:
            if mode == START:
                return (QUOTED, column, 0), 0
            return ((QUOTED, column, self.step(column, place, c)), 0) if mode == CLOSING else None
        if mode in (START, OPEN):
            return (OPEN, column, self.step(column, place, c)), 0
        return ((OPEN, column, self.step(column, place, BLANK)), 0) if mode == GAP else None

    def inserted(self, s: State) -> Iterator[tuple[State, int, str]]:
        mode, column, place = s
        if self.layout.quote and column < self.layout.n_columns and mode in (START, QUOTED, CLOSING):
            to = (QUOTED, column, 0) if mode == START else (CLOSING, column, place) if mode == QUOTED else (QUOTED, column, self.step(column, place, QUOTE))
            yield to, EDIT + MARK, "+" + self.layout.quote
        if mode != QUOTED and column < self.layout.n_columns and (behind := self.closed(column, place)):
            yield behind[0], EDIT + behind[1], "+" + self.layout.separator

    def end_cost(self, s: State) -> int:
        mode, column, place = s
        if self.layout.by_runs and mode == START:
            return 0 if column == self.layout.n_columns else FAR
        return self.invalid(column, place) if mode != QUOTED and column == self.layout.n_columns - 1 else FAR


@dataclass
class Parse:
    """The parse of a pattern: its edits as (operation, character), and with none the fields' ends and whether their forms are valid."""

    reason: str | None
    quote_edits: int
    delimiter_edits: int
    edits: list[tuple[str, int]]
    spans: list[tuple[int, int]]
    valid: list[bool]


def relaxed(best: np.ndarray, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    """Least cost of each state over the edges into it; FAR for states without any."""
    s, cost, first, to = edges
    out = np.full(best.shape, FAR)
    if len(s):
        out[:, to] = np.minimum(FAR, np.minimum.reduceat(best[:, s] + cost, first, axis=1))
    return out


def with_inserts(best: np.ndarray, g: Grammar) -> np.ndarray:
    if not len(g.insert_arrays[0]):
        return best
    while True:
        more = np.minimum(best, relaxed(best, g.insert_arrays))
        if (more == best).all():
            return best
        best = more


class Steps:
    """Costs before and behind inserts at each character of one long pattern: those at every BLOCK-th are kept, the others come again."""

    BLOCK = 1 << 10

    def __init__(self, g: Grammar, pattern: bytes) -> None:
        self.g, self.pattern, self.marks, self.held = g, pattern, [], {}
        best = np.full((1, len(g.named)), FAR, np.int64)
        best[:, 0] = 0
        for j in range(len(pattern) + 1):
            if j % self.BLOCK == 0:
                self.marks.append(best)
            full = with_inserts(best, g)
            if j < len(pattern):
                best = relaxed(full, g.arrays[pattern[j]])
        self.last = full[0]

    def __getitem__(self, j: int) -> tuple[list[int], list[int]]:
        if j not in self.held:
            block = j // self.BLOCK
            best = self.marks[block]
            self.held = {}
            for k in range(block * self.BLOCK, min((block + 1) * self.BLOCK, len(self.pattern) + 1)):
                full = with_inserts(best, self.g)
                self.held[k] = best[0].tolist(), full[0].tolist()
                if k < len(self.pattern):
                    best = relaxed(full, self.g.arrays[self.pattern[k]])
        return self.held[j]


class Parser:
    """Parses the patterns of one layout and remembers them."""

    def __init__(self, layout: Layout) -> None:
        self.layout, self.grammar = layout, Grammar(layout)
        self.loose = Grammar(Layout(0, layout.separator, (), 1, layout.quote, 0))
        self.known: dict[bytes, int] = {}
        self.parses: list[Parse] = []
        table = np.full(256, OTHER, np.uint8)
        for chars, c in (("01234", LOW), ("56789", HIGH), (".", DOT), ("+", PLUS), ("-", MINUS), ("eE", EXPONENT), (" \t", BLANK)):
            table[[ord(x) for x in chars]] = c
        if not layout.by_runs:
            table[ord(layout.separator)] = SEPARATOR
        if layout.quote:
            table[ord(layout.quote)] = QUOTE
        self.classes = table

    def well_quoted(self, pattern: bytes) -> bool:
        """Whether the pattern reads without edits, whatever the number of columns and the form of fields."""
        mode = START
        for c in pattern:
            to = self.loose.free((mode, 0, 0), c)
            if to is None and c == SEPARATOR or c == BLANK and self.layout.by_runs and mode != QUOTED:
                mode = START
            elif to is None:
                return False
            else:
                mode = to[0][0]
        return mode != QUOTED

    def parse(self, patterns: list[bytes]) -> None:
        """Adds patterns that are not known yet.  They advance together, in order of length, so those still on their way are the last."""
        g = self.grammar
        order = sorted(patterns, key=len)
        while order and len(order[-1]) > LONG_PATTERN:
            p = order.pop()
            steps = Steps(g, p)
            self.known[p] = len(self.parses)
            self.parses.append(self.followed(p, steps, int((steps.last + g.ending).argmin())))
        k = 0
        while k < len(order):
            stop = k + 1
            while stop < len(order) and (stop + 1 - k) * (len(order[stop]) + 1) * len(g.named) < CELLS:
                stop += 1
            own = order[k:stop]
            k = stop
            size = np.array([len(p) for p in own])
            begin = np.cumsum(size) - size
            codes = np.frombuffer(b"".join(own), np.uint8)
            best = np.full((len(own), len(g.named)), FAR, np.int64)
            best[:, 0] = 0
            done, steps = 0, []  # steps[j] holds the costs of the patterns from `done` on, before and behind inserts
            for j in range(int(size[-1]) + 1):
                full = with_inserts(best, g)
                steps.append((done, best.astype(np.int32), full.astype(np.int32)))
                ended = int(np.searchsorted(size[done:], j, "right"))
                for i in range(ended):
                    costs = [(a[done + i - d].tolist(), b[done + i - d].tolist()) for d, a, b in steps]
                    self.known[own[done + i]] = len(self.parses)
                    self.parses.append(self.followed(own[done + i], costs, int((full[i] + g.ending).argmin())))
                done += ended
                live = codes[begin[done:] + j]
                best = np.empty((len(own) - done, len(g.named)), np.int64)
                for c in np.unique(live):
                    rows = np.flatnonzero(live == c)
                    best[rows] = relaxed(full[ended + rows], g.arrays[c])

    def followed(self, pattern: bytes, costs: list[tuple[list[int], list[int]]] | Steps, state: int) -> Parse:
        """Back from the end of the cheapest parse."""
        g = self.grammar
        edits, path = [], []
        j = len(pattern)
        while True:
            before, full = costs[j]
            while full[state] != before[state]:
                state, op = next((s, op) for s, cost, op in g.put_into[state] if full[s] + cost == full[state])
                edits.append((op, j))
            path.append(state)
            if not j:
                break
            j -= 1
            target, reached = before[state], costs[j][1]
            state, op = next((s, op) for s, cost, op in g.into[pattern[j]][state] if reached[s] + cost == target)
            if op:
                edits.append((op, j))
        edits.reverse()
        path.reverse()
        n_quotes = sum(op[1:] == self.layout.quote for op, _ in edits)
        if edits:
            reason = "column_count" if self.well_quoted(pattern) else "quoting"
            return Parse(reason, n_quotes, len(edits) - n_quotes, edits, [], [])
        spans, valid = [], []
        for column in range(self.layout.n_columns):
            # the states behind each character of the column's text; the text of a quoted field is between its marks
            inside = [k for k in range(1, len(path)) if g.named[path[k]][1] == column and g.named[path[k]][0] in (OPEN, QUOTED, CLOSING)]
            quoted = bool(inside) and g.named[path[inside[0]]][0] == QUOTED
            spans.append((inside[0] - (not quoted), inside[-1] - quoted) if inside else (0, 0))
            valid.append(not g.invalid(column, g.named[path[inside[-1]]][2] if inside else 0))
        return Parse(None, 0, 0, [], spans, valid)

    def patterns(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parse of each line, where each line's characters begin in `kept`, kept); kept: the characters that patterns hold."""
        cls = self.classes[data]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        first = np.zeros(len(cls) + 1, bool)
        first[begins] = True
        first = first[:-1]
        # a piece of plain text too long for a number is of one class, and a digit with another beside it is any digit
        plain = cls <= OTHER
        edge = np.ones(len(cls), bool)
        edge[1:] = (plain[1:] != plain[:-1]) | first[1:]
        at = np.flatnonzero(edge)
        length = np.diff(np.append(at, len(cls)))
        if (long := plain[at] & (length > LONG_TEXT)).any():
            cls = np.where(np.repeat(long, length), OTHER, cls).astype(np.uint8)
        digit = cls <= HIGH
        beside = np.zeros(len(cls), bool)
        beside[1:] |= digit[:-1] & ~first[1:]
        beside[:-1] |= digit[1:] & ~first[1:]
        cls[digit & beside] = LOW
        if "etype" not in self.layout.columns:
            cls[digit] = LOW
        repeats = (cls == BLANK) | (cls <= OTHER)
        same = np.zeros(len(cls), bool)
        same[1:] = repeats[1:] & (cls[1:] == cls[:-1]) & ~first[1:]
        drop = same.copy()
        if not self.layout.by_runs:
            drop[1:] &= same[:-1]
        else:  # a run of blanks is one delimiter
            drop[1:] &= same[:-1] | (cls[1:] == BLANK)
        kept = np.flatnonzero(~drop)
        codes = cls[kept].tobytes()
        upto = np.searchsorted(kept, ends).tolist()
        starts = [0, *upto[:-1]]
        own = [codes[a:b] for a, b in zip(starts, upto, strict=True)]
        if len(self.known) > MOST_PATTERNS:
            self.known.clear()
            self.parses.clear()
        if fresh := set(own) - self.known.keys():
            self.parse(list(fresh))
        return np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)), np.array(starts, np.int64), kept

    def read(self, data: np.ndarray, sizes: np.ndarray) -> dict[str, list | np.ndarray]:
        """Columns of OUT from `reason` on, for lines that stand one after another in data."""
        which, starts, kept = self.patterns(data, sizes)
        n, columns = len(sizes), self.layout.columns[: self.layout.n_columns]
        ends = np.cumsum(sizes)
        used, index = np.unique(which, return_inverse=True)
        parses = [self.parses[k] for k in used]
        reason = np.array([p.reason for p in parses], object)[index]
        out = {"quote_edits": np.array([p.quote_edits for p in parses])[index], "delimiter_edits": np.array([p.delimiter_edits for p in parses])[index]}
        out |= {"edits": np.full(n, None, object), "src": np.zeros(n, np.int64), "dst": np.zeros(n, np.int64), "weight": np.zeros(n), "etype": np.zeros(n, np.int64)}
        place = np.append(kept, len(data))
        begins = ends - sizes
        edited = np.array([bool(p.edits) for p in parses], bool)
        for r in np.flatnonzero(edited[index]):
            out["edits"][r] = "; ".join(f"{op} at {min(place[starts[r] + j], ends[r]) - begins[r]}" for op, j in parses[index[r]].edits)
        good = np.flatnonzero(reason == None)  # noqa: E711
        spans = np.array([p.spans or [(0, 0)] * self.layout.n_columns for p in parses], np.int64).reshape(len(parses), -1, 2)[index[good]]
        valid = np.array([p.valid or [False] * self.layout.n_columns for p in parses], bool).reshape(len(parses), -1)[index[good]]
        at = np.minimum(place[np.minimum(starts[good][:, None, None] + spans, len(kept))], ends[good][:, None, None])
        failed: dict[str, np.ndarray] = {}
        for name in ("src", "dst", "weight", "etype"):
            if name not in columns:
                failed[name] = np.full(len(good), name in ("src", "dst"))
                continue
            c = columns.index(name)
            ok = valid[:, c].copy()
            rows = np.flatnonzero(ok)
            value = FIELD_READERS[name](data, at[rows, c, 0], at[rows, c, 1], self.layout)
            ok[rows] = value[1]
            out[name][good[rows]] = value[0]
            failed[name] = ~ok
        for names, text in ((("weight", "etype"), "data"), (("dst",), "dst"), (("src",), "src")):
            for name in names:
                reason[good[failed[name]]] = text
        bad = np.array([r is not None for r in reason], bool)
        missing = {name: bad | (name not in columns) for name in ("src", "dst", "weight", "etype")}
        return {"reason": pa.array(reason, pa.string()), "quote_edits": out["quote_edits"], "delimiter_edits": out["delimiter_edits"], "edits": pa.array(out["edits"], pa.string())} | {
            name: pa.array(out[name], SCHEMA.field(name).type, mask=gone) for name, gone in missing.items()
        }


def identifiers(data: np.ndarray, begin: np.ndarray, end: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Values of digit strings, and whether they are below v_num."""
    size = end - begin
    value = np.zeros(len(begin), np.int64)
    for j in range(min(18, int(size.max(initial=0)))):
        more = np.flatnonzero((size > j) & (size <= 18))
        value[more] = value[more] * 10 + (data[begin[more] + j] - 48)
    ok = value < layout.v_num
    for i in np.flatnonzero(size > 18):
        digits = data[begin[i] : end[i]].tobytes().lstrip(b"0") or b"0"
        ok[i] = len(digits) <= 19 and int(digits) < layout.v_num
        value[i] = int(digits) if ok[i] else 0
    return value, ok


def weights(data: np.ndarray, begin: np.ndarray, end: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    text = data.tobytes()
    value = np.array([float(text[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.float64)
    return value, np.isfinite(value)


def etypes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    return data[begin].astype(np.int64) - 48, np.ones(len(begin), bool)


FIELD_READERS = {"src": identifiers, "dst": identifiers, "weight": weights, "etype": etypes}


@lru_cache(maxsize=1024)
def parser(layout: Layout) -> Parser:
    """One for each layout that a worker meets; Spark reuses its workers."""
    return Parser(layout)


def layouts_of(files: DataFrame) -> dict[int, Layout]:
    """The layout table is one row for each file; it is refused beyond MOST_LAYOUTS."""
    rows = files.select("file_id", "separator", "n_columns", "column_names", "quote_char", "v_num").limit(MOST_LAYOUTS + 1).collect()
    if len(rows) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} layouts")
    out = {}
    for r in rows:
        for c in (r.separator, r.quote_char or '"'):
            if len(c) != 1 or not c.isascii():
                raise ValueError(f"separators and quotes must be one ASCII character, not {c!r}")
        out[r.file_id] = Layout(r.file_id, r.separator, tuple(c.strip() for c in r.column_names.split(",")), r.n_columns, r.quote_char, r.v_num)
    return out


def records(lines: DataFrame) -> DataFrame:
    """(line_id, file_id, line) of the lines that are records, without one carriage return at their end."""
    cut = F.when(F.col("line").endswith("\r"), F.substring("line", F.lit(1), F.length("line") - 1)).otherwise(F.col("line"))
    rows = lines.select(F.col("line_id").cast("long"), F.col("file_id").cast("int"), cut.alias("line"))
    begin = F.expr("ltrim(' \t', line)")
    return rows.where(F.col("line").isNotNull() & (begin != "") & ~begin.startswith("#"))


def parse_batch(b: pa.RecordBatch, layouts: dict[int, Layout]) -> Iterator[pa.RecordBatch]:
    files = b.column(1).fill_null(-1).to_numpy()
    nulls = b.column(1).is_null().to_numpy(zero_copy_only=False)
    for f in np.unique(files):
        rows = np.flatnonzero((files == f) & ~nulls)
        own = b.take(pa.array(rows))
        if int(f) in layouts and len(rows):
            lines = own.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(lines.buffers()[1], np.int64, len(lines) + 1, lines.offset * 8)
            data = np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(x, SCHEMA.field(c).type) if isinstance(x, np.ndarray) else x for c, x in parser(layouts[int(f)]).read(data, np.diff(offsets)).items())], schema=SCHEMA)
        for gone in [own] * (int(f) not in layouts) + [b.take(pa.array(np.flatnonzero((files == f) & nulls)))]:
            if gone.num_rows:
                zeros = pa.array(np.zeros(gone.num_rows, np.int32))
                empty = [pa.nulls(gone.num_rows, SCHEMA.field(c).type) for c in ("edits", "src", "dst", "weight", "etype")]
                yield pa.RecordBatch.from_arrays([gone.column(0), gone.column(1), pa.array(["layout"] * gone.num_rows), zeros, zeros, *empty], schema=SCHEMA)


def parse_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each record of `lines` (line_id, file_id, line); reason is null for those that load.

    edits names what the cheapest repair inserts (+) and deletes (-), with the character it does so at.
    """
    layouts = layouts_of(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from parse_batch(b, layouts)

    return records(lines).mapInArrow(run, OUT)
