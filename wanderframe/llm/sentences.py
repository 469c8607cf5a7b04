"""Sentence units across languages and scripts.

A pushdown automaton reads each text once.  Its stack begins with the open
list levels, by indent: marks push and pop them, and blank lines, headings and
list items bound the blocks in between.  Above them it holds open quotations
and brackets with the place where they opened; terminators of all scripts end
a sentence only where none is open, or where the outermost quotation closes
and the sentence does not go on behind it.  A full stop first passes the
abbreviation trie, which is walked backwards from the stop.  Words that are
looked up ahead are searched once each, so the time is linear in the text,
with or without blanks in it.  The result is offsets, so no text is copied.

Results by case: a null, empty or white-space text has no sentences; a cut
text ends its last sentence where it ends; a quotation or bracket that never
closes in its block is ordinary text; texts are read whole, whatever their
length; repeated documents give repeated rows; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL = "。｡！？．।॥።፧؟۔׃។៕၊။։᠃᠉"
SOFT = ".!?…;;"
QUOTES = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "｢": "｣", "‘": "’", "‚": "‘", '"': '"', "〝": "〞"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "《": "》", "〈": "〉"}
OPENERS = QUOTES | BRACKETS
CLOSERS = set(OPENERS.values())
GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
CJK = re.compile(r"[⺀-⿿぀-ヿ㄀-ㄯㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff]")
THAI = "฀-๿"

#: Abbreviations behind which a sentence never ends.
BOUND = (
    "dr mr mrs ms prof st fig figs sec secs no nos vol ch eq eqs ref refs app cf vs viz e.g i.e approx resp gen col capt lt sgt rev hon "
    "nr abb abs bd bzw ca d.h evtl ggf hr fr inkl s.o s.u sog tab vgl z.b ziff kap art "
    "p pp p.ex m mm mme mlle env éd chap fasc c.-à-d n° "
    "sr sra srta ud uds núm pág págs p.ej ej dra cap vols avda "
    "см стр рис табл т.е т.к напр г ул им гл п пп проф акад "
    "π.χ σελ βλ κ κα δηλ αρ κεφ εικ "
    "д-р д डॉ श्री प्रो सं क्र पृ د م أ ص ج ዶ/ር ወ/ሮ"
).split()
#: Abbreviations that end a sentence if the next one begins.
LOOSE = "etc al a.m p.m min max sec hrs hr hours est inc ltd corp co jr sr bros dept usw u.a u.ä o.ä uvm u.s.w т.д т.п др пр κ.λπ κτλ κ.ά ff dgl ibid seq std mio mrd tel".split()
#: Words in front of an ordinal number such as the German `am 12. März`.
ORDINAL = set("der die das den dem des am im vom zum zur beim ab bis seit ein eine einen einem einer jeder jede jedes ihr ihre sein seine".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())
LIST_OR_HEADING = re.compile(r"(?:[^\S\n\r]|\ufeff)*(?:(#{1,6})(?=\s|$)|([-*](?=\s)|\d{1,9}[.)](?=\s)))")
WHITE = "﻿​"
#: Kind of a frame that holds a list level.
LIST = "list"


@lru_cache(maxsize=1)
def abbreviations() -> frozenset[str]:
    return frozenset(BOUND + LOOSE)


#: No word in front of an inner stop of an abbreviation is longer.
LONGEST = max(map(len, BOUND + LOOSE))


@lru_cache(maxsize=1)
def trie() -> dict:
    """Abbreviations backwards; the key "" holds the kind: 1 bound, 2 loose."""
    root: dict = {}
    for kind, words in ((2, LOOSE), (1, BOUND)):
        for w in words:
            node = root
            for ch in reversed(w):
                node = node.setdefault(ch, {})
            node[""] = kind if node.get("") != 2 or w not in LOOSE else 2
    return root


@lru_cache(maxsize=1)
def scanner() -> re.Pattern:
    stops = re.escape(FULL + SOFT + "".join(OPENERS) + "".join(CLOSERS))
    return re.compile(rf"[{stops}]|(?<=[{THAI}])\s+(?=[{THAI}])")


def white(ch: str) -> bool:
    return ch.isspace() or ch in WHITE


def abbreviation(text: str, lo: int, dot: int) -> int:
    """Kind of the abbreviation that ends at `dot`; one blank may follow its inner stops."""
    node, at, found = trie(), dot - 1, 0
    while True:
        kind = node.get("")
        if kind and (at < lo or not (text[at].isalnum() or text[at] == ".")):
            found = kind
        if at < lo:
            return found
        step = node.get(text[at].lower())
        if step is None and text[at].isspace() and at > lo and text[at - 1] == "." and "." in node:
            step, at = node["."], at - 1
        if step is None:
            return found
        node, at = step, at - 1


def word_before(text: str, lo: int, at: int) -> str:
    k = at
    while k > lo and not white(text[k - 1]):
        k -= 1
    return text[k:at]


class Ahead:
    """Where the run of characters of one kind that holds a place ends.

    Places are asked for from left to right and a run is searched once, so a word of any length costs its length
    in all, however many terminators stand in it.
    """

    def __init__(self, text: str, pattern: re.Pattern) -> None:
        self.text, self.pattern, self.begin, self.end = text, pattern, 0, 0

    def __call__(self, at: int, hi: int) -> int:
        if not self.begin <= at < self.end:
            self.begin, self.end = at, self.pattern.match(self.text, at).end()
        return min(self.end, hi)


WORD = re.compile(rf"[^\s{WHITE}]*")
LETTERS = re.compile(r"(?:[^\W\d_]|[-'’])*")
#: Marks that may stand behind the letters of a word.
BEHIND = re.compile(r"[.,;:!?…)\]}\"'”’»]*")
OPENING = re.compile(f"[{re.escape(''.join(OPENERS))}]*")


class Reader:
    """A text with what the automaton looks up ahead of its place."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.word_end, self.letters_end, self.marks_end, self.openers_end = (Ahead(text, x) for x in (WORD, LETTERS, BEHIND, OPENING))

    def skip(self, at: int, hi: int) -> int:
        while at < hi and white(self.text[at]):
            at += 1
        return at

    def word(self, at: int, hi: int) -> str:
        """The word that begins at `at`; only for words behind white space, each of which is cut out once."""
        return self.text[at : self.word_end(at, hi)]

    def begins_sentence(self, at: int, hi: int) -> bool:
        """Whether the word at `at` looks like a first word: a capital, an identifier, an opening mark, or nothing."""
        end = self.word_end(at, hi)
        core = self.openers_end(at, end)
        if core >= end or not self.text[core].islower():
            return True
        behind = self.letters_end(core, end)
        return self.marks_end(behind, end) < end if behind < end else False


def blocks(text: str) -> Iterator[tuple[int, int, list[int]]]:
    """Stretches that no sentence crosses, without their marks: paragraphs, headings, list items.

    Each comes with the open list levels, as the indents of their items.  A mark closes the levels that are
    indented as far or farther and opens its own, several marks on a line open one level each; a paragraph
    closes the levels whose items it is not indented behind, a line that goes on in a paragraph closes none.
    """
    begin = None
    at = 0
    last = 0
    levels: list[int] = []
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        blank = not line.strip() or not line.strip().strip(WHITE)
        m = None if blank else LIST_OR_HEADING.match(text, at, end)
        if blank or m:
            if begin is not None:
                yield begin, last, levels.copy()
            begin = None
        if m and m.group(1):
            levels.clear()
            yield m.end(), end, []
        elif m:
            close(levels, m.start(2) - at)
            levels.append(m.start(2) - at)
            while inner := LIST_OR_HEADING.match(text, m.end(), end):
                if inner.group(1):
                    break
                m = inner
                close(levels, m.start(2) - at)
                levels.append(m.start(2) - at)
            begin, last = m.end(), end
        elif not blank:
            if begin is None:
                begin = at
                indent = len(line) - len(line.lstrip())
                close(levels, indent)
            last = end
        at = end
    if begin is not None:
        yield begin, last, levels.copy()


def close(levels: list[int], indent: int) -> None:
    while levels and levels[-1] >= indent:
        levels.pop()


def stop_ends(r: Reader, lo: int, run: int, after: int, hi: int) -> bool:
    """Whether the terminators text[run:after] end a sentence, at an empty stack."""
    text = r.text
    marks = text[run:after]
    at = r.skip(after, hi)
    if at >= hi:
        return True
    if any(c in FULL for c in marks):
        return True
    glued = at == after
    if marks in (";", ";"):
        return not glued
    if marks.strip(".") == "…" * marks.count("…") and len(marks.replace("…", "...")) >= 2:
        if glued:
            return False
        core = r.openers_end(at, hi)
        return text[at].isupper() or (core < r.word_end(at, hi) and text[core].isupper())
    if glued:
        return bool(CJK.match(text[at])) and marks[-1] in "!?"
    if marks != ".":
        return True
    kind = abbreviation(text, lo, run)
    if kind == 1:
        return False
    if kind == 2:
        return r.begins_sentence(at, hi) and not text[at].isdigit()
    before, word = word_before(text, lo, run), r.word(at, hi)
    bare = before.lstrip("".join(OPENERS))
    if len(bare) <= LONGEST and f"{bare}.{word.rstrip('.,;:)').lower()}".lower() in abbreviations():
        return False
    if len(bare) == 1 and bare.isalpha() and bare.isupper():
        return not word[0].isupper() or CJK.match(word) is not None
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", bare) and word[0].islower():
        return False
    if bare.isdigit() and len(bare) <= 4:
        head = run - len(bare)
        while head > lo and white(text[head - 1]):
            head -= 1
        if word_before(text, lo, head).lower() in ORDINAL or word.rstrip(".,").lower() in MONTHS:
            return False
    return True


def goes_on(r: Reader, frame: tuple[int, str], first: int, after: int, hi: int) -> bool:
    """Whether a sentence continues behind the quotation or bracket that closed before `after`."""
    text = r.text
    at = r.skip(after, hi)
    if at >= hi:
        return False
    ch = text[at]
    if ch in ",;:，、；：—–-؛،·)]}）」』”»…":
        return True
    begin, opener = frame
    if ch in OPENERS or (opener in BRACKETS and begin == first):
        return False
    k = begin - 1
    while k >= first and white(text[k]):
        k -= 1
    told = k >= first and text[k] in ":："
    if told and opener in QUOTES:
        return ch == "と" and at == after
    if ch.islower() or ch.isupper():
        return not r.begins_sentence(at, hi)
    if not ch.isalpha():
        return False
    return True


def block_sentences(r: Reader, lo: int, hi: int, levels: list[int]) -> Iterator[tuple[int, int]]:
    """The automaton over one block.  Its stack holds the open list levels, then open quotations and brackets.

    Only what opened in the block can close in it, so `floor`, the number of list levels, is the empty stack of a sentence.
    """
    text = r.text
    while hi > lo and white(text[hi - 1]):
        hi -= 1
    first = r.skip(lo, hi)
    stack: list[tuple[int, str]] = [(indent, LIST) for indent in levels]
    floor = len(stack)
    stopped = False  # the last thing seen inside the stack was a terminator
    at = first
    for_next = scanner().search
    closing: dict[str, int] = {}
    while at < hi and (m := for_next(text, at, hi)):
        k = m.start()
        ch = text[k]
        if stopped and any(not white(c) for c in text[at:k]):
            stopped = False
        at = k + 1
        inside = len(stack) > floor
        if ch.isspace():
            at = m.end()
            if not inside:
                yield first, k
                first = at
                stopped = False
        elif inside and ch == OPENERS[stack[-1][1]]:
            frame = stack.pop()
            inside = len(stack) > floor
            if not inside and stopped:
                while at < hi and text[at] in ".!?" + FULL:
                    at += 1
                if not goes_on(r, frame, first, at, hi):
                    yield first, at
                    first = r.skip(at, hi)
                    at, stopped = first, False
            elif not inside:
                stopped = False
        elif ch in OPENERS:
            want = OPENERS[ch]
            if closing.get(ch, -1) <= k:
                far = text.find(want, k + 1, hi)
                closing[ch] = far if far >= 0 else hi
            if ch == "‘" and k > lo and text[k - 1].isalnum():
                continue
            if closing[ch] < hi:
                stack.append((k, ch))
                stopped = False
        elif ch in CLOSERS:
            stopped = stopped and inside
        else:
            if ch in ";;" and not (k > lo and GREEK.match(text[k - 1])):
                continue
            while at < hi and text[at] in FULL + ".!?…":
                at += 1
            if inside:
                stopped = ch in FULL or ch in "!?…" or not text[at : at + 1].isalnum()
            elif stop_ends(r, first, k, at, hi):
                while at < hi and text[at] in CLOSERS and text[at] not in OPENERS:
                    at += 1
                yield first, at
                first = r.skip(at, hi)
                at = first
    if first < hi:
        yield first, hi


def leveled_sentences(text: str) -> Iterator[tuple[int, int, int]]:
    """(begin, end, number of list levels) of every sentence."""
    r = Reader(text)
    for lo, hi, levels in blocks(text):
        for a, b in block_sentences(r, lo, hi, levels):
            while b > a and white(text[b - 1]):
                b -= 1
            if b > a:
                yield a, b, len(levels)


def sentences(text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b, _ in leveled_sentences(text)]


SLASH = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
DOC = r'"""(?:\\.|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)'
HASH = r"#[^\n]*"
DASH = r"--[^\n]*"
ANGLE = r"<!--.*?(?:-->|\Z)"
#: A line of the C preprocessor, which a `#` begins as well.
DIRECTIVE = r"#(?:include|define|undef|ifn?def|if|el(?:if|se)|endif|pragma|error|warning|line|import)\b|#[^\S\n]+(?:include[^\S\n]*[<\"]|(?:define|undef|ifn?def)[^\S\n]+[A-Z_]|pragma\b|endif\b)"
#: Comment syntax by language family.
FAMILIES = {
    **dict.fromkeys(("python",), (DOC, HASH)),
    **dict.fromkeys(("shell", "bash", "sh", "yaml", "toml", "ruby", "perl", "r", "make", "makefile", "cmake", "dockerfile", "ini"), ("", HASH)),
    **dict.fromkeys(("sql", "lua", "haskell"), ("", DASH + r"|/\*.*?(?:\*/|\Z)")),
    **dict.fromkeys(("html", "xml", "markdown"), ("", ANGLE)),
    **dict.fromkeys(("json", "csv", "text"), ("", r"(?!)")),
    **dict.fromkeys("c cpp c++ cuda objective-c csharp c# java kotlin scala groovy javascript typescript jsx tsx rust go swift dart css scss less proto".split(), ("", SLASH)),
    "php": ("", SLASH + "|" + HASH),
}
#: All forms at once, for a text whose language nothing tells.
ANY = (DOC, rf"(?<!:)//[^\n]*|/\*.*?(?:\*/|\Z)|{ANGLE}|(?<![\w$&{{])(?!{DIRECTIVE})#(?!!?\[)[^\n]*|(?<!\S)--(?!\S)[^\n]*")
#: Forms of other families that stand alone; a guessed language keeps them, as headers of another language are common.
FOREIGN = rf"(?<!\S)(?!{DIRECTIVE})#+(?!\S)[^\n]*|(?m:^)[^\S\n]*(?://+(?!\S)[^\n]*|--(?!\S)[^\n]*|/\*.*?(?:\*/|\Z)|{ANGLE})"
EXTENSIONS = {
    **dict.fromkeys("py pyi pyw".split(), "python"),
    **dict.fromkeys("sh bash zsh ksh yml yaml toml ini cfg rb pl pm r mk cmake makefile dockerfile".split(), "shell"),
    **dict.fromkeys("sql lua hs".split(), "sql"),
    **dict.fromkeys("html htm xhtml xml svg".split(), "html"),
    **dict.fromkeys("c h cc cpp cxx hh hpp hxx cu m cs java kt scala groovy js jsx mjs cjs ts tsx rs go swift dart css scss less proto".split(), "cpp"),
    "php": "php",
}
#: Lines by which a text tells its family.
SIGNS = {
    "python": r"^[^\S\n]*(?:(?:async )?def \w+\(|(?:class \w.*|elif .*|else|try|finally|except\b.*|with .*|(?:for|while|if) .*):[^\S\n]*(?:#.*)?$|from [\w.]+ import |import [\w.]+(?: as \w+)?[^\S\n]*$)|^#!.*python",
    "shell": r"^#!.*sh\b|^[^\S\n]*(?:fi|done|esac)\b|^[^\S\n]*(?:export|local) \w+=|;\s*(?:do|then)[^\S\n]*$|^[^\S\n]*(?:set -|echo )|^[^\S\n]*(?:- )?[\w.-]+:(?:[^\S\n]+[^\s{].*[^\s;,{(]|[^\S\n]+[^\s;,{(]|[^\S\n]*)$",
    "sql": r"^[^\S\n]*(?:(?i:select\b|create (?:or replace )?(?:table|view|index)\b|insert into\b|delete from\b|alter table\b|drop table\b|group by\b|(?:left |right |inner |cross )?join\b|order by\b)|(?:FROM|WHERE|UPDATE)\b)",
    "html": r"^[^\S\n]*</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>|^[^\S\n]*<(?:!DOCTYPE|\?xml)\b",
    "cpp": r"^[^\S\n]*#\s*(?:include|define|undef|ifn?def|endif|pragma)\b|(?:;|\}\)|[\w)>][^\S\n]*\{)[^\S\n]*(?://.*|/\*.*)?$|^[^\S\n]*(?:package \w+|import \"|func |fn |pub |use [\w:]+|#!?\[)|=>|:=|\bstd::",
}


@lru_cache(maxsize=1)
def signs() -> dict[str, re.Pattern]:
    return {family: re.compile(pattern, re.MULTILINE) for family, pattern in SIGNS.items()}


def guessed(text: str, path: str) -> str:
    """The family that most lines show; the name's last known extension decides between equals, and "" stands for none."""
    score: dict[str, float] = {family: sum(1 for _ in sign.finditer(text)) for family, sign in signs().items()}
    parts = re.split(r"[./\\]", path.lower())
    named = next((EXTENSIONS[x] for x in reversed(parts) if x in EXTENSIONS), "")
    if named:
        score[named] = score.get(named, 0) + (score.get("cpp", 0) if named == "php" else 0) + 0.5
    best = max(score.values())
    top = [family for family, n in score.items() if n == best]
    return top[0] if best and len(top) == 1 else ""


@lru_cache(maxsize=64)
def comment_pattern(language: str, sure: bool = True) -> re.Pattern:
    doc, line = FAMILIES.get(language, ANY)
    if not sure and language:
        line = f"{line}|{FOREIGN}"
    parts = ([f"(?P<doc>{doc})"] if doc else []) + [f"(?P<note>{line})", STRINGS]
    return re.compile("|".join(parts), re.DOTALL)


MARKS = re.compile(r"(?m)^[^\S\n]*(?://[/!]*|#+!?|--+|/\*+!?|\*+(?!/)|<!--)|\*+/|-->|\"\"\"|\'\'\'")


def comments_only(text: str, language: str, path: str = "") -> str:
    """The text with all but its comments blanked, character for character.

    Code becomes an empty line between comments, so that it bounds sentences;
    comment marks become blanks, so that one comment over several lines reads on.
    A language that FAMILIES does not name is guessed from the text and the path.
    """
    pieces, at, before = [], 0, ""
    sure = language in FAMILIES
    for m in comment_pattern(language if sure else guessed(text, path), sure).finditer(text):
        if not (m.groupdict().get("doc") or m.group("note")):
            continue
        gap = text[at : m.start()]
        bound = bool(gap.strip()) or gap.count("\n") > 1
        pieces.append(blank_line(len(gap)) if bound else gap)
        note = MARKS.sub(lambda x: " " * len(x.group()), m.group())
        mark = m.group().lstrip()[:1]
        # a guessed language may have comments of two kinds on neighbouring lines, which are two comments
        pieces.append(note if sure or mark == before else "\n" + note[1:])
        at, before = m.end(), mark
    pieces.append(blank_line(len(text) - at))
    return "".join(pieces)


def blank_line(n: int) -> str:
    """n characters that bound what stands before and behind them."""
    return "\n" + " " * (n - 2) + "\n" if n > 1 else "\n" * n


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text", kind: Column | None = None, language: Column | None = None, path: Column | None = None, levels: bool = False) -> DataFrame:
    """(key, sent_start, sent_end) of every sentence, with levels=True also list_level; texts of kind `code` give those of their comments."""
    kind = F.lit("prose") if kind is None else kind
    language, path = (F.lit("") if c is None else F.coalesce(c, F.lit("")) for c in (language, path))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), kind.alias("kind"), F.lower(language).alias("language"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, spans = [], []
            for i, (t, k, lang, name) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True)):
                found = list(leveled_sentences(comments_only(t, lang, name) if k == "code" else t))
                owner += [i] * len(found)
                spans += found
            at = np.array(spans, np.int64).reshape(-1, 3)
            keys = b.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(at[:, c]) for c in range(len(names)))], [key, *names])

    names = ["sent_start", "sent_end", *["list_level"] * levels]
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names))
