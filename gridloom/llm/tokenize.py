"""Byte-level BPE encoding and decoding of a text column (problem 6).

Each pre-token is merged by a priority queue of merge ranks over a doubly
linked list of symbols; queue entries whose symbols changed meanwhile are stale
and skipped, so a run of n symbols costs O(n log n) however long it is. Ids of
chunks already met are kept in a bounded memo per worker process.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pre-tokenization pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_DIR = "/opt/tokenizers"
#: Chunks kept per worker and generation, and the longest kept (in characters).
MEMO_ENTRIES, MEMO_CHARS = 250_000, 64
ROWS_AT_ONCE = 256
SPACE_AFTER_SPACE = re.compile(r"\s ")
#: The characters with the Unicode property White_Space.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The same pattern where letters are a-z, digits 0-9 and white space ASCII.
ASCII_PATTERN = r"""(?: ?[A-Za-z]+)|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary.

    Printable Latin-1 bytes stand for themselves, the others take the
    characters from U+0100 on in ascending order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """Vocabulary and merges of one tokenizer file, with a memo of pre-tokens."""

    def __init__(self, path: str, text: bytes | None = None):
        model = json.loads(_content(path) if text is None else text)["model"]
        symbols, vocab = byte_symbols(), model["vocab"]
        self.byte_id = [vocab[s] for s in symbols]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.first, self.second = [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs]
        self.merged = [vocab[a + b] for a, b in pairs]
        self.ranks = {pair: rank for rank, pair in enumerate(zip(self.first, self.second))}
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        self.split = Splitter()
        self.words: dict[str, bytes] = {}
        self.whole, self.spaced = _Memo(self, ""), _Memo(self, " ")

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token. A queue entry is rank * width + position."""
        ids = [self.byte_id[b] for b in word.encode("utf-8")]
        width = n = len(ids)
        if n < 2:
            return ids
        rank_of, a_of, b_of, new_of = self.ranks.get, self.first, self.second, self.merged
        queue = [r * width + i for i, r in enumerate(map(rank_of, zip(ids, ids[1:]))) if r is not None]
        if not queue:
            return ids
        heapify(queue)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            rank, i = divmod(heappop(queue), width)
            j = right[i]
            if j == n or ids[i] != a_of[rank] or ids[j] != b_of[rank]:
                continue  # stale: one of the two symbols was merged since
            new = ids[i] = new_of[rank]
            ids[j] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank_of((new, ids[k]))) is not None:
                    heappush(queue, r * width + i)
            h = left[i]
            if h >= 0 and (r := rank_of((ids[h], new))) is not None:
                heappush(queue, r * width + h)
        return [t for t in ids if t >= 0]

    def pack(self, chunk: str) -> bytes:
        """Ids of a text as packed int32, by pre-token, without the memo of chunks."""
        words = self.words
        if len(words) > MEMO_ENTRIES:
            words.clear()
        out = b""
        for w in (chunk,) if chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk.isalpha()) else self.split(chunk):
            got = words.get(w)
            if got is None:
                got = array("i", self.merge(w)).tobytes()
                if len(w) <= MEMO_CHARS:
                    words[w] = got
            out += got
        return out

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a whole text as packed int32.

        A single space that follows no white space always begins a pre-token,
        so a text without white space before a space may be cut at its spaces;
        otherwise runs of white space and of anything else are the chunks.
        """
        if not text:
            return b""
        if SPACE_AFTER_SPACE.search(text):
            memo = self.whole
            return b"".join([memo[c] for c in CHUNKS.findall(text)])
        first, *rest = text.split(" ")
        memo = self.spaced
        return self.whole[first] + b"".join([memo[c] for c in rest])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int] | None) -> str:
        """Concatenate the vocabulary strings; broken UTF-8 becomes U+FFFD."""
        if ids is None:
            return ""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", errors="replace")


class _CharClass(dict):
    """Code point -> an ASCII character of the same class in PATTERN."""

    def __init__(self):
        import regex

        super().__init__({c: c for c in range(128)})
        self.kinds = [(regex.compile(p), ord(c)) for p, c in ((r"\p{L}", "x"), (r"\p{N}", "0"), (r"\s", "\t"))]

    def __missing__(self, code: int) -> int:
        self[code] = next((c for p, c in self.kinds if p.match(chr(code))), ord("!"))
        return self[code]


class Splitter:
    """Pre-tokens of a text: the pieces that PATTERN finds, one after another.

    The pattern covers every character, so the pieces of a text whose
    non-ASCII characters are replaced by ASCII ones of equal class have the
    lengths of the true pieces; plain ASCII then needs no Unicode tables.
    """

    def __init__(self):
        self.find, self.classes = re.compile(ASCII_PATTERN).findall, _CharClass()

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text)
        ends = list(accumulate(map(len, self.find(text.translate(self.classes)))))
        return [text[a:b] for a, b in zip([0, *ends], ends)]


class _Memo(dict):
    """Chunk -> its ids as packed int32, in two generations of bounded size."""

    def __init__(self, bpe: ByteBpe, lead: str):
        super().__init__()
        self.bpe, self.lead, self.old = bpe, lead, {}

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = self.bpe.pack(self.lead + chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[chunk] = got
        return got


#: Bytes that a tokenizer file may have to be sent to the executors.
FILE_BYTES = 64_000_000
_LOADED: dict[str, ByteBpe] = {}


def load(path: str, text: bytes | None = None) -> ByteBpe:
    """The tokenizer of ``path`` (whose content is ``text``), read once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path, text)
        gc.freeze()  # the vocabulary stays; collections need not walk it again
    return _LOADED[path]


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _sent(df: DataFrame, path: str):
    """The tokenizer file, read by the driver and sent to the executors, which need no copy of it."""
    if os.path.getsize(path) > FILE_BYTES:
        raise ValueError(f"{path} has more than {FILE_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(_content(path))


def tokenizer_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """Parameter > environment variable GRIDLOOM_TOKENIZERS > default folder."""
    return os.path.join(folder or os.environ.get("GRIDLOOM_TOKENIZERS", DEFAULT_DIR), f"{name}.json")


def encode_column(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``(id_col, ids)``: the token ids of every row's whole text.

    A null or empty text gives an empty list, special-token strings are plain
    text, ids keep their null if null, repeated rows stay repeated, an empty
    table gives an empty one; other columns, whatever their names, are not read.
    A narrow map without shuffle: only the two columns are scanned, the text is
    handled in small slices so that a batch of long texts stays small.
    """
    kind, sent = df.schema[id_col].dataType.simpleString(), _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = [bpe.encode_packed(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                flat = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["k", "ids"])

    out = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", id_col)


def decode_column(df: DataFrame, id_col: str, ids_col: str, path: str) -> DataFrame:
    """``(id_col, text)``: the text of each row's ids; null ids give ``''``."""
    kind, sent = df.schema[id_col].dataType.simpleString(), _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, sent.value)
        for batch in batches:
            text = pa.array([bpe.decode(i.as_py()) for i in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=["k", "text"])

    out = df.select(F.col(id_col).alias("k"), F.col(ids_col).alias("i")).mapInArrow(run, f"k {kind}, text string")
    return out.withColumnRenamed("k", id_col)
