"""Token ids in Re-Pair compressed shards with random access.

Documents are encoded in ascending doc_id order and gathered into shards of about ``SHARD_TOKENS`` ids. In each shard
frequent pairs of neighbouring symbols are replaced by nonterminals, round after round, until none occurs ``LEAST_USES``
times. A shard stores its rules, the expansion length of every rule, the symbols in as few bits as they need, and for
each document the place of its first symbol; so one document is decoded by expanding its own symbols, and one token by skipping symbols by their
lengths.

Shards are rows of a Parquet table, which any store that Spark writes to can hold and whose files appear only
when a task has succeeded. All numbers are little-endian.

    shard        first shard number is (partition << 32); shards in ascending order hold ascending doc_ids
    n_docs, n_tokens, n_symbols, n_terminals, bits
    doc_ids      int64 for each document; doc_null  one byte for each, 1 where the id is null
    doc_tokens   uint32 ids of each document      doc_symbols  uint32 symbols of each document
    alphabet     uint32 id of each terminal symbol: the ids that the shard uses, ascending
    rules        uint32 pairs; rule r is symbol n_terminals + r and uses smaller symbols only
    lengths      uint32 expansion length of each rule
    symbols      n_symbols numbers of ``bits`` bits, packed from the lowest bit up
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored, whole_text

SHARD_TOKENS = 1 << 20
#: a pair is worth a rule when it occurs this often in its shard
LEAST_USES = 32
#: a round replaces the pairs at least this share as frequent as the most frequent one
ROUND_SHARE = 0.2
END_ID = 1
#: after so many encoded words, or runs, a worker starts remembering anew; those before are kept until it does so again
REMEMBERED = 200_000
#: texts that are read together, so that a word they share is looked up once, and the bytes of these
TOGETHER, TOGETHER_BYTES = 2048, 1 << 23
#: ASCII signs that may end a simple word, and the letter whose lower case depends on its place
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SIGMA = "\u03a3"
SHARD = (
    "shard long, n_docs int, n_tokens long, n_symbols int, n_terminals int, bits int, doc_ids binary, doc_null binary,"
    " doc_tokens binary, doc_symbols binary, alphabet binary, rules binary, lengths binary, symbols binary"
)
NAMES = [f.split()[0] for f in SHARD.split(", ")]
NUMBERS = NAMES[:6]


# --- encoding ---


@cache
def encoder(path: str):
    """The tokenizer, and what is remembered of it: ids by word, and by run of letters or signs."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), Memory(), Memory()


class Memory:
    """Ids by word or run. What is not looked up again while as many others come goes, what is in use stays, so a batch with more words
    than are remembered does not cost the frequent ones."""

    def __init__(self) -> None:
        self.recent: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.recent) > REMEMBERED:
            self.recent, self.before = {}, self.recent


@cache
def byte_letters() -> dict[int, str]:
    """The letters by which a byte-level vocabulary spells bytes: printable ones themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + rest.index(b)) for b in rest}


def simple_runs(word: str) -> tuple[str, str] | None:
    """A word's letters and the ASCII signs after them, where the tokenizer's normalisation and split can do nothing else with
    it: lower-case letters throughout, then signs without an apostrophe. Otherwise None."""
    low = word.lower()
    letters = low.rstrip(SIGNS)
    if letters and letters.isalpha() and (low.isascii() or SIGMA not in word and unicodedata.is_normalized("NFC", word)):
        return letters, low[len(letters) :]
    return None


def word_ids(path: str, words: list[str]) -> list[bytes]:
    """The ids of each word as bytes. Strings of special tokens, which hold signs before letters, get the ids of the tokens. Runs of letters and of signs, which the tokenizer splits first of all, go straight to its
    model, each once; other words go through the whole tokenizer."""
    tokenizer, _, memory = encoder(path)
    model, table, out, odd = tokenizer.model, byte_letters(), [], []
    memory.turn()
    runs, before = memory.recent, memory.before
    for i, word in enumerate(words):
        simple = simple_runs(word)
        if simple is None:
            odd.append(i)
            out.append(b"")
            continue
        ids = b""
        for run in simple:
            if run:
                found = runs.get(run)
                if found is None:
                    found = before.get(run)
                    if found is None:
                        spelled = run if run.isascii() else run.encode().decode("latin-1").translate(table)
                        found = array("I", [t.id for t in model.tokenize(spelled)]).tobytes()
                    runs[run] = found
                ids += found
        out.append(ids)
    for k in range(0, len(odd), 4096):
        part = odd[k : k + 4096]
        for i, e in zip(part, tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
    return out


def encoded(path: str, texts: pa.StringArray) -> list[np.ndarray]:
    """The ids of each text. The tokenizer drops white space and never looks across it, so a text's ids are those
    of its words; each distinct word is encoded once and remembered."""
    _, memory, _ = encoder(path)
    memory.turn()
    known = memory.recent
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    new = [w for w in words if w not in known]
    old = [w for w in new if w in memory.before]
    known.update(zip(old, map(memory.before.__getitem__, old)))
    new = [w for w in new if w not in known]
    known.update(zip(new, word_ids(path, new)))
    each = list(map(known.__getitem__, words))
    sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
    at = coded.indices.to_numpy()
    runs = sizes[at]
    before = np.append(0, np.cumsum(runs))
    kind = np.int32 if max(before[-1], sizes.sum()) < 1 << 31 else np.int64
    starts = (np.cumsum(sizes) - sizes).astype(kind)
    source = np.repeat(starts[at] - before[:-1].astype(kind), runs)
    source += np.arange(before[-1], dtype=kind)
    ids = np.frombuffer(b"".join(each), np.uint32)[source]
    stops = before[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))]
    return np.split(ids, stops[1:-1]) if len(texts) else []


# --- Re-Pair ---


def compressed(symbols: np.ndarray, ends: np.ndarray, terminals: int, least: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, symbol count of each document) of a shard whose terminals are 0 to ``terminals`` - 1.

    ``ends`` marks each document's last id; no pair crosses it. A round counts all pairs of the shard, takes those with ``least`` uses
    and ``share`` of the most frequent one's, and replaces them from left to right; of overlapping occurrences the first of
    a run, the third and so on are replaced.
    """
    symbols, rules, top, last = symbols.astype(np.uint32), [], terminals, ends.copy()
    while len(symbols) > 1:
        keys = pair_keys(symbols[:-1], symbols[1:], top)
        inside = ~last[:-1]
        order = np.sort(keys[inside])
        edges = np.flatnonzero(np.append(True, order[1:] != order[:-1])) if len(order) else np.zeros(0, np.int64)
        counts = np.diff(np.append(edges, len(order)))
        if not len(counts) or counts.max() < least:
            break
        chosen = order[edges[counts >= max(least, int(counts.max() * share))]]
        bits = max(12, (len(chosen) * 16).bit_length())
        holds = np.zeros(1 << bits, bool)
        holds[slots(chosen, bits)] = True
        at = np.flatnonzero(inside & holds[slots(keys, bits)])
        rank = np.minimum(np.searchsorted(chosen, keys[at]), len(chosen) - 1)
        hit = chosen[rank] == keys[at]
        at, rank = at[hit], rank[hit]
        run = np.flatnonzero(np.append(True, np.diff(at) != 1))
        even = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        at, rank = at[even], rank[even]
        uses = np.bincount(rank, minlength=len(chosen)) > 0
        rules.append(np.stack([symbols[at[first := first_of(rank, uses)]], symbols[at[first] + 1]], axis=1))
        symbols[at] = top + (np.cumsum(uses) - 1)[rank]
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        top += int(uses.sum())
    pairs = np.concatenate(rules).astype("<u4") if rules else np.zeros((0, 2), "<u4")
    return symbols, pairs, np.diff(np.append(-1, np.flatnonzero(last)))


def pair_keys(left: np.ndarray, right: np.ndarray, top: int) -> np.ndarray:
    """A number for each pair, in 32 bits while symbols take 16."""
    if top <= 1 << 16:
        return left << np.uint32(16) | right
    return left.astype(np.uint64) << np.uint64(32) | right


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """A multiplicative hash of each key."""
    kind = keys.dtype.type
    return keys * kind(0x9E3779B97F4A7C15 >> (64 - keys.itemsize * 8) | 1) >> kind(keys.itemsize * 8 - bits)


def first_of(rank: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Where each used rank occurs."""
    place = np.zeros(len(uses), np.int64)
    place[rank] = np.arange(len(rank))
    return place[uses]


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """The expansion length of each rule. A rule uses symbols made before it only."""
    lengths = [1] * len(rules)
    for r, (a, b) in enumerate(rules.tolist()):
        lengths[r] = (lengths[a - terminals] if a >= terminals else 1) + (lengths[b - terminals] if b >= terminals else 1)
    return np.array(lengths, "<u4")


def expanded(symbols: np.ndarray, alphabet: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: each symbol's expansion is spelled once, then copied to where it belongs."""
    n = len(alphabet)
    spelled = [alphabet[k : k + 1].tobytes() for k in range(n)]
    for a, b in rules.tolist():
        spelled.append(spelled[a] + spelled[b])
    sizes = np.concatenate([np.ones(n, np.int64), lengths])
    starts = np.cumsum(sizes) - sizes
    runs = sizes[symbols]
    before = np.cumsum(runs) - runs
    source = np.arange(int(runs.sum())) + np.repeat(starts[symbols] - before, runs)
    return np.frombuffer(b"".join(spelled), "<u4")[source]


def packed(symbols: np.ndarray, bits: int) -> bytes:
    """Each run of 32 symbols takes exactly ``bits`` 32-bit words, so symbol k of every run meets the same shifts."""
    x = np.zeros(-(-len(symbols) // 32) * 32, np.uint64)
    x[: len(symbols)] = symbols
    x, words = x.reshape(-1, 32), np.zeros((len(x) // 32, bits + 1), np.uint64)
    for k in range(32):
        word, shift = divmod(k * bits, 32)
        v = x[:, k] << np.uint64(shift)
        words[:, word] |= v & np.uint64(0xFFFFFFFF)
        words[:, word + 1] |= v >> np.uint64(32)
    return np.ascontiguousarray(words[:, :bits].astype("<u4")).tobytes()


def unpacked(data: bytes, bits: int, n: int) -> np.ndarray:
    words = np.frombuffer(data, "<u4").reshape(-1, bits).astype(np.uint64)
    words = np.concatenate([words, np.zeros((len(words), 1), np.uint64)], axis=1)
    out = np.empty((len(words), 32), np.uint32)
    for k in range(32):
        word, shift = divmod(k * bits, 32)
        both = words[:, word] | words[:, word + 1] << np.uint64(32)
        out[:, k] = both >> np.uint64(shift) & np.uint64((1 << bits) - 1)
    return out.ravel()[:n]


# --- shards ---


def shard_row(number: int, ids: list[int | None], tokens: list[np.ndarray], least: int, share: float) -> dict:
    flat = np.concatenate(tokens)
    sizes = np.array([len(t) for t in tokens])
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(sizes) - 1] = True
    present = np.bincount(flat) > 0
    alphabet, place = np.flatnonzero(present).astype("<u4"), np.cumsum(present) - 1
    symbols, rules, counts = compressed(place[flat], ends, len(alphabet), least, share)
    bits = max(1, int(symbols.max()).bit_length())
    return {
        "shard": number, "n_docs": len(ids), "n_tokens": len(flat), "n_symbols": len(symbols), "n_terminals": len(alphabet), "bits": bits,
        "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "doc_null": np.array([i is None for i in ids]).tobytes(),
        "doc_tokens": sizes.astype("<u4").tobytes(), "doc_symbols": counts.astype("<u4").tobytes(), "alphabet": alphabet.tobytes(),
        "rules": rules.tobytes(), "lengths": rule_lengths(rules, len(alphabet)).tobytes(), "symbols": packed(symbols, bits),
    }


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices whose texts are read together: ``TOGETHER`` rows, or fewer where these have over ``TOGETHER_BYTES``."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
    i = 0
    while i < len(batch):
        most = np.searchsorted(ends, TOGETHER_BYTES + (ends[i - 1] if i else 0), "right")
        j = max(i + 1, min(i + TOGETHER, int(most)))
        yield batch.slice(i, j - i)
        i = j


def shard_batches(batches: Iterator[pa.RecordBatch], path: str, size: int, least: int, share: float) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    end = np.array([END_ID], np.uint32)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()] + [pa.binary()] * 8
    ids: list[int | None] = []
    tokens: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        row = shard_row(number, ids, tokens, least, share)
        return pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(NAMES, kinds)], NAMES)

    for batch in batches:
        for part in parts_of(batch):
            for doc_id, found in zip(part.column("doc_id").to_pylist(), encoded(path, part.column("text"))):
                ids.append(doc_id)
                tokens.append(np.concatenate([found, end]))
                held += len(tokens[-1])
                if held >= size:
                    yield flush()
                    ids, tokens, held, number = [], [], 0, number + 1
    if ids:
        yield flush()


def shards(docs: DataFrame, tokenizer: str, size: int = SHARD_TOKENS, least: int = LEAST_USES, share: float = ROUND_SHARE) -> DataFrame:
    """Shard rows of all documents in ascending doc_id order (nulls first, ties by text), each ended by id 1.

    Documents are range-partitioned by id and sorted; a task turns them into shards as they stream by, so it holds one
    shard and one document at most. Null texts are empty; an empty table has no shard; other columns are ignored.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(lambda it: shard_batches(it, tokenizer, size, least, share), SHARD)


def document_ids(shard: dict, k: int) -> np.ndarray:
    """The ids of the shard's k-th document, from its own symbols only."""
    counts = np.frombuffer(shard["doc_symbols"], "<u4")
    first, n = int(counts[:k].sum()), int(counts[k])
    run = first // 32
    data = shard["symbols"][run * shard["bits"] * 4 :]
    symbols = unpacked(data[: -(-(first % 32 + n) // 32) * shard["bits"] * 4], shard["bits"], first % 32 + n)[first % 32 :]
    return expanded(symbols, *grammar(shard))


def grammar(shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alphabet, rules and rule lengths of a shard."""
    return np.frombuffer(shard["alphabet"], "<u4"), np.frombuffer(shard["rules"], "<u4").reshape(-1, 2), np.frombuffer(shard["lengths"], "<u4")


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            flat = expanded(unpacked(row["symbols"], row["bits"], row["n_symbols"]), *grammar(row))
            sizes = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
            stops = np.cumsum(sizes)
            data = flat.tobytes()
            crcs = [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), sizes.tolist())]
            ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_null"], bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * len(sizes), pa.int64()), ids, pa.array(stops - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                ["shard", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def shard_starts(written: DataFrame) -> DataFrame:
    """(shard, start): ids in all earlier shards, from the counts alone. Totals of each writing task come first, so no
    sort sees more rows than there are tasks, or shards of one task."""
    counts = written.select("shard", "n_tokens", F.shiftright("shard", 32).alias("part"))
    totals = counts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = "coalesce(sum({}) OVER ({} ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    totals = totals.select("part", F.expr(before.format("n", "", "part")).alias("earlier"))
    within = counts.select("shard", "part", F.expr(before.format("n_tokens", "PARTITION BY part", "shard")).alias("here"))
    return within.join(totals, "part").select("shard", (F.col("earlier") + F.col("here")).cast("long").alias("start"))


def written_and_read(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from shards written to the shared folder."""
    written = stored(shards(docs, tokenizer, **how), "token-shards")
    made = written.mapInArrow(digest_batches, "shard long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return made.join(shard_starts(written), "shard").select(
        "doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
