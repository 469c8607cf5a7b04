"""Corpus encoding with a public byte-level BPE vocabulary.

The stage is map-only: each task pre-tokenises its Arrow batches with NumPy,
reduces them to distinct words, and hands the words it has not met before to
an in-process DuckDB, where one recursive query contracts them.  The query
holds one row per (word, token position), joins neighbouring tokens with the
merge table, contracts each word's minimum-rank pairs from the left and
repeats with the words that changed until none does.  It is keyed by (word,
position), so a pass replaces the rows it changes and its memory is the words'
length, not length times passes; a token that was merged into its left
neighbour stays as -1.  An ordered aggregation turns the rest into id lists.

A word may be as long as its text, as in scripts without blanks.  Every token
of a contraction, final or not, is a vocabulary entry that stands in the text
at its place, so a boundary that no entry found in the word spans is never
crossed.  Long words are cut at these boundaries, which an Aho-Corasick
automaton over the vocabulary finds in one pass, and the pieces are contracted
and remembered like words of their own.  A piece may still be long, as a line of
one letter is; it is contracted part by part.  Tokens are the contraction of
what they spell if and only if each two neighbours are that of theirs, so a part
is cut behind one of its tokens, and the cut stands if the token and the first
one of the rest, contracted together, come out unchanged.

Results by case: a null or empty text gives an empty list; a white-space text
is encoded like any other; a text of any length is encoded whole; strings that
look like special tokens are ordinary text; repeated rows give repeated rows;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER, LETTER, NUMBER, SPACE = range(4)
APOSTROPHE, BLANK = ord("'"), ord(" ")
#: Text bytes that are pre-tokenised at once; one longer text makes a chunk alone.
CHUNK_BYTES = 4 << 20
#: Distinct words a worker remembers before it starts afresh.
CACHE_WORDS = 400_000
#: Token-position rows given to one recursive query.
QUERY_ROWS = 300_000

#: Bytes of a word that one query contracts; longer ones are contracted in parts that are then proved to fit together.
PART = 1 << 16
#: Words above this many bytes are cut where no vocabulary entry can reach across.
LONG = 256

CONTRACT = """
WITH RECURSIVE pass(w, p, t) USING KEY (w, p) AS (
    SELECT w, p, t FROM seed
    UNION ALL (
    WITH here AS (
        SELECT w, p, t,
               lead(t) OVER (PARTITION BY w ORDER BY p) AS after,
               lead(p) OVER (PARTITION BY w ORDER BY p) AS q,
               row_number() OVER (PARTITION BY w ORDER BY p) AS k
        FROM recurring.pass SEMI JOIN (SELECT DISTINCT w FROM pass) USING (w)
        WHERE t >= 0),
    pair AS (
        SELECT here.w, here.p, here.q, here.k, m.rank, m.made
        FROM here JOIN merges m ON here.t = m.a AND here.after = m.b
        QUALIFY m.rank = min(m.rank) OVER (PARTITION BY here.w)),
    hit AS (SELECT *, k - row_number() OVER (PARTITION BY w ORDER BY k) AS run FROM pair),
    chosen AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY w, run ORDER BY k) % 2 = 1)
    SELECT w, p, made FROM chosen
    UNION ALL
    SELECT w, q, -1 FROM chosen)
)
SELECT w, list(t ORDER BY p) AS ids FROM pass WHERE t >= 0 GROUP BY w ORDER BY w
"""


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point under the pattern's \\p{L}, \\p{N} and \\s."""
    import regex

    points = np.delete(np.arange(0x110000, dtype=np.uint32), slice(0xD800, 0xE000))
    text = points.tobytes().decode("utf-32-le")
    table = np.zeros(0x110000, np.uint8)
    for code, name in ((LETTER, "L"), (NUMBER, "N"), (SPACE, "White_Space")):
        for m in regex.finditer(r"\p{%s}+" % name, text):
            table[points[m.start() : m.end()]] = code
    return table


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Flags the code points at which a pre-token begins; texts never share one.

    Runs of letters, numbers or other marks are words and take one blank in
    front; a white-space run gives up its last character to what follows; an
    apostrophe that stands alone pulls the seven English clitics to itself.
    """
    n = len(points)
    cls = char_classes()[points]
    first = np.zeros(n, bool)
    first[text_starts[text_starts < n]] = True
    run = first.copy()
    run[1:] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    start = run.copy()
    before = np.zeros(n, bool)  # previous character belongs to the same text and is white space
    before[1:] = space[:-1]
    before &= ~first
    blank = np.zeros(n, bool)
    blank[1:] = points[:-1] == BLANK
    lead = run & ~space & before  # a run right behind white space
    start[lead & blank] = False
    start[np.flatnonzero(lead) - 1] = True
    ends = np.ones(n + 1, bool)
    ends[:n] = run
    alone = np.flatnonzero(run & (points == APOSTROPHE) & ends[1:] & ~(before & blank))
    if len(alone):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        edge = np.concatenate([first, np.ones(3, bool)])
        a, b = padded[alone + 1], padded[alone + 2]
        inside, inside2 = ~edge[alone + 1], ~edge[alone + 2]
        one = inside & np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(alone), bool)
        for x, y in ("re", "ve", "ll"):
            two |= inside & inside2 & (a == ord(x)) & (b == ord(y))
        start[alone[one | two] + 1] = False
        after = np.concatenate([alone[one] + 2, alone[two] + 3])
        start[after[after < n]] = True
    return start


@dataclass
class Encoder:
    """A worker's merge table, connection and memory of encoded words."""

    path: str
    memory: str = "200MB"
    known: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        import duckdb

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        letters = {chr(b): b for b in shown}
        letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters.values())}
        vocab = model["vocab"]
        self.single = np.zeros(256, np.int32)
        for ch, b in letters.items():
            self.single[b] = vocab[ch]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        table = pa.table(
            {
                "a": pa.array([vocab[x] for x, _ in pairs], pa.int32()),
                "b": pa.array([vocab[y] for _, y in pairs], pa.int32()),
                "rank": pa.array(range(len(pairs)), pa.int32()),
                "made": pa.array([vocab[x + y] for x, y in pairs], pa.int32()),
            }
        )
        as_bytes = {ord(c): chr(b) for c, b in letters.items()}
        self.entries = [(x + y).translate(as_bytes) for x, y in pairs]
        #: Bytes that each id stands for.
        self.lengths = np.ones(1 + max(vocab.values()), np.int64)
        self.lengths[[vocab[x + y] for x, y in pairs]] = list(map(len, self.entries))
        # a chunk fits in memory by its size; without a folder for spills nothing is written beside the worker
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": self.memory, "temp_directory": ""})
        self.db.register("arrow_merges", table)
        self.db.execute("CREATE TABLE merges AS FROM arrow_merges")
        self.db.unregister("arrow_merges")
        self.forget()

    @cached_property
    def automaton(self):  # noqa: ANN202
        import ahocorasick

        out = ahocorasick.Automaton()
        for e in self.entries:
            out.add_word(e, len(e))
        out.make_automaton()
        return out

    def barriers(self, word: bytes) -> np.ndarray:
        """Places inside the word that no vocabulary entry in it spans."""
        open_at = np.zeros(len(word) + 1, np.int64)
        matches = self.automaton.iter(word.decode("latin-1"))
        while some := list(islice(matches, 100_000)):  # a long word has many times as many
            last, n = np.array(some, np.int64).T
            np.add.at(open_at, last - n + 2, 1)
            np.add.at(open_at, last + 1, -1)
        return np.flatnonzero(np.cumsum(open_at)[1 : len(word)] == 0) + 1

    def forget(self) -> None:
        self.known.clear()
        self.ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.at = [np.zeros(0, np.int64)]
        self.n = [np.zeros(0, np.int64)]
        self.total = 0

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has."""
        long = [k for k, w in enumerate(words) if len(w) > PART]
        if not long:
            return self.contract_whole(words)
        parts, at = [], 0
        for k in [*long, len(words)]:
            if k > at:
                parts.append(self.contract_whole(words[at:k]))
            if k < len(words):
                ids = self.contract_in_parts(words[k])
                parts.append((ids, np.array([len(ids)])))
            at = k + 1
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def contract_in_parts(self, word: bytes) -> np.ndarray:
        out: list[np.ndarray] = []
        at, part = 0, PART
        ids, _ = self.contract_whole([word[:part]])
        while at + part < len(word):
            size = self.lengths[ids]
            ends = np.cumsum(size)
            # behind one of its last tokens, but not at the end, which the cut has made
            for k in range(int(np.searchsorted(ends, part * 3 // 4)), len(ids) // 2, -1):
                cut = at + int(ends[k])
                rest, _ = self.contract_whole([word[cut : cut + part]])
                both = word[cut - int(size[k]) : cut + int(self.lengths[rest[0]])]
                if self.contract_whole([both])[0].tolist() == [ids[k], rest[0]]:
                    out.append(ids[: k + 1])
                    at, ids = cut, rest
                    break
            else:  # no cut of the last tokens stands: take more of the word at once
                part *= 2
                ids, _ = self.contract_whole([word[at : at + part]])
        return np.concatenate([*out, ids])

    def contract_whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        out, counts, k = [], [], 0
        while k < len(words):
            base = ends[k] - sizes[k]
            stop = max(k + 1, int(np.searchsorted(ends, base + QUERY_ROWS, "right")))
            own = sizes[k:stop]
            w = np.repeat(np.arange(stop - k, dtype=np.int32), own)
            p = (np.arange(len(w)) - np.repeat(np.cumsum(own) - own, own)).astype(np.int32)
            seed = pa.table({"w": w, "p": p, "t": flat[base : base + len(w)]})
            self.db.register("seed", seed)
            got = self.db.sql(CONTRACT).to_arrow_table()["ids"].combine_chunks()
            self.db.unregister("seed")
            out.append(got.flatten().to_numpy(zero_copy_only=False))
            counts.append(np.diff(got.offsets.to_numpy()))
            k = stop
        return np.concatenate(out).astype(np.int32), np.concatenate(counts).astype(np.int64)

    def learn(self, words: list[bytes]) -> None:
        ids, counts = self.contract(words)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ids.append(ids)
        self.n.append(counts)
        self.at.append(self.total + np.cumsum(counts) - counts)
        self.total += len(ids)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all remembered ids, where each word's ids begin, how many they are)."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        fresh = [w for w in words if w not in self.known]
        if fresh:
            self.learn(fresh)
        if len(self.ids) > 1:
            self.ids, self.at, self.n = [np.concatenate(self.ids)], [np.concatenate(self.at)], [np.concatenate(self.n)]
        where = np.fromiter((self.known[w] for w in words), np.int64, len(words))
        return self.ids[0], self.at[0][where], self.n[0][where]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary; Spark reuses its workers."""
    return Encoder(path)


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices at[0], at[0]+1, … n[0] of them, then those of the next."""
    ends = np.cumsum(n)
    return np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def encode_chunk(enc: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of non-null texts one after another, and the number of each."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8))
    lo = np.frombuffer(texts.buffers()[1], np.int64, 1, texts.offset * 8)[0]
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    data = texts.buffers()[2].slice(lo, total)
    raw = np.frombuffer(data, np.uint8)
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(data.to_pybytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_at = np.concatenate([[0], np.cumsum(sizes)])
    begins = np.searchsorted(heads, byte_at[:-1])
    start = word_starts(points, begins)
    cuts = heads[start]
    lengths = np.diff(np.append(cuts, total))
    if (lengths > LONG).any():
        more = [at + enc.barriers(raw[at : at + n].tobytes()) for at, n in zip(cuts[lengths > LONG], lengths[lengths > LONG], strict=True)]
        cuts = np.sort(np.concatenate([cuts, *more]))
    offsets = np.append(cuts, total).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), data]).dictionary_encode()
    ids, at, n = enc.encode(words.dictionary.to_pylist())
    index = words.indices.to_numpy()
    n = n[index]
    out = ids[spread(at[index], n)]
    words_before = np.searchsorted(cuts, byte_at)
    tokens_before = np.concatenate([[0], np.cumsum(n)])
    return out, np.diff(tokens_before[words_before])


def encode_array(enc: Encoder, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, ids, counts) of chunks of bounded size."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    k = 0
    while k < len(texts):
        stop = min(len(texts), max(k + 1, int(np.searchsorted(ends, ends[k] + CHUNK_BYTES, "right")) - 1))
        yield k, stop, *encode_chunk(enc, texts.slice(k, stop - k))
        k = stop


def vocabulary(path: str | None = None) -> str:
    """The vocabulary file; by default byte_bpe_50k of the installed public set."""
    if path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row (key, ids) for each row of df."""
    path = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for lo, hi, ids, n in encode_array(enc, b.column(1)):
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row (key, n_tokens) for each row of df; no ids leave the worker."""
    path = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for lo, hi, _, n in encode_array(enc, b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n)], [key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def decode_ids(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds `decoded`, the text that the ids stand for (the inverse of encode_corpus)."""
    path = vocabulary(path)

    @F.pandas_udf("string")
    def decoded(lists):  # noqa: ANN001, ANN202
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        letters = {chr(b): b for b in shown}
        letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters.values())}
        tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        return lists.map(lambda x: b"".join(tokens[i] for i in x).decode("utf-8"))

    return df.withColumn("decoded", decoded(F.col(ids)))
