"""Evaluation items whose passages stand in corpus documents (problem 7).

A document and an item are a case if ``run`` consecutive words of the item's
text stand in the document. Seen as sets of ``SHINGLE``-word shingles, a window
of ``run`` words must be contained entirely, so of its ``run - SHINGLE + 1``
shingles, ordered by rarity in the corpus, a prefix of one suffices to find it:
the rarest. One pass over the texts counts the item shingles and keeps the runs
of words that are long enough to hold a window and consist of item shingles
alone; these are joined with the rarest shingles only, and a hit is verified
word by word over the window that its positions in item and document allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.typeset import words
from gridloom.session import cut

SHINGLE = 5
#: Item words that one broadcast holds at most (some 60 bytes each with index).
BLOCK_WORDS = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the shingle at each position."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = (out ^ ids[k : k + n].astype(np.uint64)) * _PRIME
            out ^= out >> np.uint64(29)
    return out


class ItemIndex:
    """Words and shingles of a block of items."""

    def __init__(self, items: list[tuple[object, list[str]]], run: int):
        self.run = run
        self.keys = [k for k, _ in items]
        self.vocabulary: dict[str, int] = {}
        take = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.ids = [np.array([take(w) for w in ws], dtype=np.int64) for _, ws in items]
        hashed = [_hashes(i) for i in self.ids]
        self.known = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, dtype=np.uint64)
        self.places = [np.searchsorted(self.known, h) for h in hashed]

    def encode(self, text: list[str]) -> np.ndarray:
        """Item-vocabulary ids of a text's words, 0 for every other word."""
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in text], dtype=np.int64)

    def hits(self, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose shingle is in the sorted ``known``, and where in it."""
        none = np.zeros(0, dtype=np.int64)
        if len(ids) < self.run or not len(known):
            return none, none
        inside = ids > 0
        full = np.flatnonzero(np.convolve(inside, np.ones(SHINGLE, dtype=np.int64), "valid") == SHINGLE)
        if not len(full):
            return none, none
        h = _hashes(ids)[full]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        ok = known[at] == h
        return full[ok], at[ok]

    def runs(self, ids: np.ndarray, full: np.ndarray) -> list[np.ndarray]:
        """Word runs over consecutive positions in ``full``, as many as a window of ``run`` words has, or more."""
        if not len(full):
            return []
        ends = np.flatnonzero(np.r_[np.diff(full) > 1, True])
        starts = np.r_[0, ends[:-1] + 1]
        return [ids[full[a] : full[b] + SHINGLE] for a, b in zip(starts, ends) if b - a >= self.run - SHINGLE]

    def prefixes(self, counts: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Rarest shingle of every window -> the item positions it stands at."""
        width = self.run - SHINGLE + 1
        out: dict[int, list[tuple[int, int]]] = {}
        for item, place in enumerate(self.places):
            chosen = set()
            for at in range(len(place) - width + 1):
                window = place[at : at + width]
                k = min(range(width), key=lambda j: (counts[window[j]], window[j]))
                chosen.add(at + k)
            for at in chosen:
                out.setdefault(int(place[at]), []).append((item, at))
        return out


def _verified(ids: np.ndarray, at: int, item: np.ndarray, offset: int, run: int) -> bool:
    """Do ``run`` consecutive words around the hit agree?"""
    left = min(at, offset, run - SHINGLE)
    a, b = ids[at - left : at + run], item[offset - left : offset + run]
    n = min(len(a), len(b))
    if n < run:
        return False
    same = (a[:n] == b[:n]) & (a[:n] > 0)
    ends = np.flatnonzero(np.diff(np.r_[0, same, 0]))
    return bool((ends[1::2] - ends[::2] >= run).any())


def _blocks(items: Iterator[tuple[object, list[str]]]) -> Iterator[list]:
    block, size = [], 0
    for item in items:
        if block and size + len(item[1]) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    if block:
        yield block


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 12) -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds ``run`` words of an item in a row.

    The items are the stated query set: their words are read in blocks of
    bounded size, and every block meets all documents. The texts are cleaned
    once; with several blocks their plain words are written for the blocks to
    read. A block's pass leaves one row per task and item shingle, counted over
    all documents, and one per word run that may hold a window, which verified
    copies and near misses have alone. Null, empty and short texts on either
    side make no case; repeated rows give one case; null ids are kept as null.
    If both tables call their id the same, that of the items is returned as
    ``<name>_item``. Other columns are not read.
    """
    spark = docs.sparkSession
    named = f"{item_id}_item" if item_id == doc_id else item_id
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, `{named}` {items.schema[item_id].dataType.simpleString()}"
    source, split = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), words
    blocks = _blocks(_item_words(items, item_id, item_text, run))
    block, later = next(blocks, None), next(blocks, None)
    if later is not None:
        source, split = cut(source.mapInArrow(_cleaned, f"d {kind}, t string"), "p7-words"), str.split
    found = None
    while block is not None:
        index = ItemIndex(block, run)
        sent = spark.sparkContext.broadcast(index)
        met = cut(source.mapInArrow(_scan(sent, split), f"place int, n bigint, d {kind}, ids array<int>"), "p7-runs")
        rows = met.filter("place is not null").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(index.known), dtype=np.int64)
        counts[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
        prefix = spark.sparkContext.broadcast(index.prefixes(counts))
        one = met.filter("place is null").select("d", "ids").mapInArrow(_joiner(sent, prefix, to_arrow_type(items.schema[item_id].dataType)), schema)
        found = one if found is None else found.unionByName(one)
        block, later = later, next(blocks, None)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.distinct()


def _item_words(items: DataFrame, item_id: str, item_text: str, run: int) -> Iterator[tuple]:
    """Items of at least ``run`` words, cleaned by the tasks and streamed to the driver part by part."""
    kind = items.schema[item_id].dataType.simpleString()
    plain = items.select(F.col(item_id).alias("d"), F.col(item_text).alias("t")).distinct().mapInArrow(_cleaned, f"d {kind}, t string")
    for row in plain.filter(F.size(F.split("t", " ")) >= run).toLocalIterator():
        yield row.d, row.t.split(" ")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(words(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["d", "t"])


def _scan(sent, split):
    """Rows (place, n, null, null) of the item shingles met, and (null, null, d, ids) of the word runs kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = sent.value
        counts, kind = np.zeros(len(index.known), dtype=np.int64), None

        def rows(places: np.ndarray, d: list, kept: list) -> pa.RecordBatch:
            none = len(places)
            return pa.RecordBatch.from_arrays([
                pa.array([*places.tolist(), *[None] * len(d)], pa.int32()), pa.array([*counts[places].tolist(), *[None] * len(d)], pa.int64()),
                pa.array([*[None] * none, *d], kind), pa.array([*[None] * none, *kept], pa.list_(pa.int32())),
            ], names=["place", "n", "d", "ids"])

        for batch in batches:
            kind, d, kept = batch.column(0).type, [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = index.encode(split(t) if t else [])
                full, at = index.hits(ids, index.known)
                if len(at):
                    counts += np.bincount(at, minlength=len(counts))
                    for one in index.runs(ids, full):
                        d.append(key)
                        kept.append(one.astype(np.int32))
            if d:
                yield rows(np.zeros(0, dtype=np.int64), d, kept)
        if kind is not None:
            yield rows(np.flatnonzero(counts), [], [])

    return run


def _joiner(sent, prefix, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = sent.value
        at_items = prefix.value
        places = np.array(sorted(at_items), dtype=np.int64)
        known = index.known[places]
        for batch in batches:
            out: list[tuple] = []
            for d, kept in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = kept.values.to_numpy().astype(np.int64)
                met: set[int] = set()
                for at, k in zip(*(x.tolist() for x in index.hits(ids, known))):
                    for item, offset in at_items[int(places[k])]:
                        if item not in met and _verified(ids, at, index.ids[item], offset, index.run):
                            met.add(item)
                out += [(d, index.keys[i]) for i in met]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], batch.column(0).type), pa.array([i for _, i in out], kind)], names=["d", "i"])

    return run
