"""Benchmark passages in documents, found by pigeonhole edit matching.

A test item that occurs with at most k edits keeps one of k + 1 pieces of it unchanged. An automaton finds
all exact pieces in a text, each hit fixes where the item must lie, and Myers' bit-parallel distance verifies that window.
Letters and digits are compared in lower case, everything else counts as one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import whole_text

#: edits allowed for each character of an item
EDIT_RATE = 0.06
#: characters of test items that one pass over the documents searches for
BLOCK_CHARS = 4_000_000
MATCH = "doc_id long, item_id long, distance int, start int, occurrences int"
OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return f" {OTHER.sub(' ', text.lower()).strip()} "


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly equal length, with their places."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letter_masks(pattern: str) -> dict[str, int]:
    """For each letter of the pattern a bit for each of its places."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_ending(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and any substring of the text, and where the first such one ends.

    Myers' recurrence: vertical differences of a column are two bit vectors, updated with a few operations a
    letter.
    """
    high, all_bits = 1 << (m - 1), (1 << m) - 1
    plus, minus, score = all_bits, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (all_bits & ~(diagonal | plus)), plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & all_bits, down << 1 & all_bits
        vertical = eq | minus
        plus, minus = down | (all_bits & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, i + 1
            if not best:
                break
    return best, end


def spans(starts: set[int], length: int, budget: int, limit: int) -> list[tuple[int, int]]:
    """The stretches of a text in which an item may lie that starts near one of the places; windows that overlap are one stretch,
    so that no match is cut off by the end of a window."""
    merged: list[tuple[int, int]] = []
    for start in sorted(starts):
        low, high = max(0, start - budget), min(limit, start + length + budget)
        if merged and low < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


class Finder:
    """The pieces of a block of test items, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            pattern = normal(text)
            if pattern.strip():
                budget = int(len(pattern) * rate)
                self.items.append((item_id, pattern, budget, letter_masks(pattern)))
                for offset, piece in pieces(pattern, budget):
                    at.setdefault(piece, []).append((len(self.items) - 1, offset))
        self.pieces = ahocorasick.Automaton()
        for piece, places in at.items():
            self.pieces.add_word(piece, (len(piece), places))
        if self.items:
            self.pieces.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, least distance, start of the first match at it, number of separate stretches that match) of each item."""
        if not self.items:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.pieces.iter(text):
            for k, offset in places:
                starts.setdefault(k, set()).add(end + 1 - length - offset)
        found = []
        for k, where in starts.items():
            item_id, pattern, budget, masks = self.items[k]
            m, hits = len(pattern), []
            for low, high in spans(where, m, budget, len(text)):
                at = text.find(pattern, low, high)
                if at >= 0:
                    hits.append((0, at))
                else:
                    distance, end = best_ending(masks, m, text[low:high])
                    if distance <= budget:
                        hits.append((distance, max(0, low + end - m)))
            if hits:
                distance, start = min(hits)
                found.append((item_id, distance, start, len(hits)))
        return found


def match_batches(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], rate: float) -> Iterator[pa.RecordBatch]:
    finder = Finder(items, rate)
    names = [f.strip().split()[0] for f in MATCH.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            rows += [(doc_id, *hit) for hit in finder.search(text.as_py())]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The distinct test items in blocks of bounded size. The blocks travel with the plan, so the driver holds the test
    items, which do not grow with the documents."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).distinct()
    block, held = [], 0
    for r in rows.toLocalIterator():
        block.append((r.item_id, r.text))
        held += len(r.text)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, occurrences) of every test item that a document holds within its edit budget
    of ``rate`` times its length.

    The items are the stated query set: they go to the tasks in blocks of at most ``BLOCK_CHARS`` characters, each of which
    costs one pass over the documents; documents are never shuffled. Whole texts are searched. ``start`` is a place in the
    normalised text. Items and texts without a letter or digit match nothing; rows with a null id keep it;
    repeated documents give repeated rows, repeated items do not.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = None
    for block in item_blocks(items):
        part = texts.mapInArrow(lambda it, block=block: match_batches(it, block, rate), MATCH)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], MATCH) if found is None else found


def clean_batches(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], rate: float) -> Iterator[pa.RecordBatch]:
    finder = Finder(items, rate)
    for batch in batches:
        yield batch.filter(pa.array([not finder.search(str(t.as_py() or "")) for t in batch.column("text")], pa.bool_()))


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The documents that hold no test item, columns as they came; each block of items is a pass, without a shuffle."""
    for block in item_blocks(items):
        docs = docs.mapInArrow(lambda it, block=block: clean_batches(it, block, rate), docs.schema)
    return docs
