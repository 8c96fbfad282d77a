"""Masked pseudo-likelihood of documents.

Every token is predicted from two tokens on either side by a small network that never sees the token itself. The network predicts a
word's class; a word's share of its class comes from counts over the whole corpus, and words it does not hold are spelled. The sum of these
conditional log-probabilities scores a document.

The corpus is counted in full; the network is trained in numpy inside the tasks, every document once. Training goes in rounds over
disjoint parts of the documents, chosen by hash: each task continues from the same network on its share, and the
networks are averaged by tokens. The driver sees the counts of ``KNOWN_WORDS`` frequent words and networks of some 15,000 numbers.
Tasks look these words up; all other words of a text are joined with the written counts, however many there are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored, whole_text

#: words with a class of their own; the others share ``ENDINGS`` classes by their last two letters
OWN, ENDINGS = 64, 64
CLASSES = OWN + ENDINGS
EDGE = CLASSES
#: frequent words, whose counts travel to the tasks; the others' are joined
KNOWN_WORDS = 20_000
WINDOW, HIDDEN, BATCH, RATE = 2, 24, 4096, 0.08
OFFSETS = [k for k in range(-WINDOW, WINDOW + 1) if k]
#: the part of all documents, in sixteenths, up to which each round has trained
ROUNDS = (2, 7, 16)
#: an unseen word's letters and its end are equally likely among so many
LETTERS = 32
LETTER_COST = float(np.log(LETTERS))
COUNTED_WORDS = 250_000
#: rows of a batch whose words are looked up together
TOGETHER = 1024


@dataclass
class Words:
    """What the counts say: each frequent word's class and log share of it, each class's log share of all words the corpus does
    not hold, and the counts of all words."""

    known: dict[str, tuple[int, float]]
    unseen: list[float]
    counts: DataFrame | None = None

    def lookup(self, word: str) -> tuple[int, float]:
        """A frequent word's class and log share; of another word what holds if the corpus does not have it."""
        found = self.known.get(word)
        if found is None:
            k = ending_class(word)
            found = k, self.unseen[k] - (len(word) + 1) * LETTER_COST
        return found

    def local(self) -> Words:
        """What travels to the tasks."""
        return replace(self, counts=None)

    def shares(self, rows: DataFrame) -> DataFrame:
        """Rows with a column ``word``, none of them frequent, and the word's log share of its class. Every word of the corpus has the
        share of its count; others are spelled."""
        unseen = F.array(*map(F.lit, self.unseen))[word_class()]
        spelled = -(F.length("word") + 1) * F.lit(LETTER_COST)
        counts = self.counts.select("word", F.col("n").alias("in_corpus"))
        return rows.join(counts, "word", "left").withColumn("share", unseen + F.coalesce(F.log("in_corpus"), spelled))


def ending_class(word: str) -> int:
    return class_of_ending(word[-2:])


@lru_cache(1 << 16)
def class_of_ending(letters: str) -> int:
    return OWN + zlib.crc32(letters.encode()) % ENDINGS


def word_class() -> Column:
    """``ending_class`` of the column ``word``."""
    return (F.crc32(F.substring("word", -2, 2)) % ENDINGS + OWN).cast("int")


def split_words(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-case words of all texts in order, and the number of them in each text."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat, sizes = split.flatten(), pc.list_value_length(split).to_numpy()
    filled = pc.not_equal(flat, "")
    if not pc.all(filled, min_count=0).as_py():
        owner = np.repeat(np.arange(len(sizes)), sizes)[filled.to_numpy(zero_copy_only=False)]
        sizes, flat = np.bincount(owner, minlength=len(sizes)), flat.filter(filled)
    return flat.dictionary_encode(), sizes


# --- counts ---


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for i in range(0, len(batch), TOGETHER):
            coded, _ = split_words(batch.column("text").slice(i, TOGETHER))
            words = coded.dictionary.to_pylist()
            for word, n in zip(words, np.bincount(coded.indices.to_numpy(), minlength=len(words)).tolist()):
                seen[word] += n
        if len(seen) > COUNTED_WORDS:
            yield counted(seen)
            seen = Counter()
    if seen:
        yield counted(seen)


def counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])


def word_statistics(texts: DataFrame) -> Words:
    """Counts every word of the corpus; the most frequent ones and the sums by class are collected."""
    counts = texts.select("text").mapInArrow(count_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "lm-words")
    # counts fall into a few hundred steps; words below the step of the last one wanted need not be ranked
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    least, found = 0, 0
    for least, words in steps:
        found += words
        if found >= KNOWN_WORDS:
            break
    top = counts.where(F.floor(F.log2("n") * 8) >= least).orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).collect()
    ends = word_class().alias("class")
    total = np.zeros(CLASSES)
    for k, n in counts.groupBy(ends).agg(F.sum("n")).collect():
        total[k] = n
    known, own = {}, {}
    for rank, (word, n) in enumerate(top):
        if rank < OWN:
            total[ending_class(word)] -= n
            own[word] = rank, 0.0
        else:
            known[word] = n
    share = {w: (k, float(np.log(n / (total[k] + 1)))) for w, n in known.items() for k in [ending_class(w)]}
    return Words(own | share, (-np.log(np.maximum(total, 0) + 1)).tolist(), counts)


def placed(at: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words with edges around each text, and where the words are."""
    places = np.arange(len(at)) + np.repeat((np.arange(len(sizes)) + 1) * WINDOW, sizes)
    ids = np.full(len(at) + (len(sizes) + 1) * WINDOW, EDGE, np.uint8)
    ids[places] = classes[at] if len(at) else 0
    return ids, places


def coded_classes(texts: pa.StringArray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """``placed`` for all texts: what training needs."""
    coded, sizes = split_words(texts)
    vocabulary = coded.dictionary.to_pylist()
    classes = np.array([f[0] if f else class_of_ending(w[-2:]) for w, f in zip(vocabulary, map(words.known.get, vocabulary))], np.uint8)
    return placed(coded.indices.to_numpy(), sizes, classes)


def coded_texts(texts: pa.StringArray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """``placed`` for all texts, and the words' log shares of their classes, 0 for words
    that are not frequent; these are listed for each text with their counts."""
    coded, sizes = split_words(texts)
    vocabulary = coded.dictionary.to_pylist()
    found = list(map(words.known.get, vocabulary))
    frequent = np.array([f is not None for f in found], bool)
    classes = np.array([f[0] if f else class_of_ending(w[-2:]) for w, f in zip(vocabulary, found)], np.uint8)
    shares = np.array([f[1] if f else 0.0 for f in found], np.float64)
    at = coded.indices.to_numpy()
    other = np.flatnonzero(~frequent[at]) if len(at) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)[other]
    pairs, times = np.unique(owner.astype(np.int64) * max(len(vocabulary), 1) + at[other], return_counts=True)
    text, word = np.divmod(pairs, max(len(vocabulary), 1))
    items = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word)), pa.array(times, pa.int64())], ["word", "times"])
    others = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32()), items)
    return *placed(at, sizes, classes), shares[at] if len(at) else np.zeros(0), others


# --- the network ---

SHAPES = [(len(OFFSETS), CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
SIZE = sum(int(np.prod(s)) for s in SHAPES)


def parts_of(flat: np.ndarray) -> list[np.ndarray]:
    """Views of a flat vector: input tables by offset, hidden constants, output weights and constants."""
    out, at = [], 0
    for s in SHAPES:
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def fresh() -> np.ndarray:
    return (np.random.default_rng(3).standard_normal(SIZE) * 0.1).astype(np.float32)


def hidden(net: list[np.ndarray], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = net[1] + net[0][0][ids[at + OFFSETS[0]]]
    for k, o in enumerate(OFFSETS[1:], 1):
        h += net[0][k][ids[at + o]]
    return np.tanh(h, out=h)


def chances(net: list[np.ndarray], ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hidden values, and for each place the weight of every class and their sum; a class's chance is its share."""
    h = hidden(net, ids, at)
    z = h @ net[2]
    z += net[3]
    z -= z.max()
    e = np.exp(z, out=z)
    return h, e, e @ np.ones(CLASSES, e.dtype)


def log_chances(net: list[np.ndarray], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of each place's own class, given its neighbours."""
    _, e, total = chances(net, ids, at)
    return np.log(e[np.arange(len(at)), ids[at]]) - np.log(total)


def step(flat: np.ndarray, squares: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
    """One Adagrad step on the tokens at these places."""
    net, grad = parts_of(flat), np.zeros_like(flat)
    tables, bias, out, free = parts_of(grad)
    h, d, total = chances(net, ids, at)
    d *= (1 / (total * len(at)))[:, None]
    d[np.arange(len(at)), ids[at]] -= d.dtype.type(1 / len(at))
    np.matmul(h.T, d, out=out)
    np.matmul(np.ones(len(at), d.dtype), d, out=free)
    dh = d @ net[2].T
    h *= h
    dh *= np.subtract(1, h, out=h)
    np.matmul(np.ones(len(at), d.dtype), dh, out=bias)
    for k, o in enumerate(OFFSETS):
        seen = ids[at + o]
        order = np.argsort(seen, kind="stable")
        counts = np.bincount(seen, minlength=CLASSES + 1)
        own = np.flatnonzero(counts)
        first = (np.cumsum(counts) - counts)[own]
        tables[k][own] = np.add.reduceat(dh[order], first, axis=0)
    squares += grad * grad
    flat -= flat.dtype.type(RATE) * grad / (np.sqrt(squares) + flat.dtype.type(1e-4))


def trained_batches(batches: Iterator[pa.RecordBatch], words: Words, start: np.ndarray, squares: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Trains on all tokens that come by, in shuffled order within some thousand documents; yields the network weighted by
    tokens."""
    flat, own, n, rng = start.copy(), squares.copy(), 0, np.random.default_rng(1)
    for batch in batches:
        for i in range(0, len(batch), TOGETHER):
            ids, places = coded_classes(batch.column("text").slice(i, TOGETHER), words)
            places = rng.permutation(places)
            for j in range(0, len(places), BATCH):
                step(flat, own, ids, places[j : j + BATCH])
            n += len(places)
    if n:
        weights = np.concatenate([flat, own, [1.0]]).astype(np.float64) * n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights))), pa.array(weights)], ["at", "weight"])


def train(docs: DataFrame) -> tuple[Words, np.ndarray]:
    """Counts and network of a corpus. Every document is counted, and trained on in exactly one round."""
    texts = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS[-1])).alias("turn"), whole_text().alias("text"))
    words = word_statistics(texts)
    local = words.local()
    flat, squares, low = fresh(), np.full(SIZE, 1e-3, np.float32), 0
    for high in ROUNDS:
        part = texts.where(f"turn >= {low} AND turn < {high}").select("text")
        made = part.mapInArrow(lambda it, flat=flat, squares=squares: trained_batches(it, local, flat, squares), "at long, weight double")
        total = np.zeros(2 * SIZE + 1)
        for at, weight in made.groupBy("at").agg(F.sum("weight").alias("weight")).collect():  # 2 * SIZE + 1 sums
            total[at] = weight
        if total[-1]:
            flat, squares = ((total[a : a + SIZE] / total[-1]).astype(np.float32) for a in (0, SIZE))
        low = high
    return words, flat


# --- scores ---

SCORES = "row long, doc_id long, n_tokens long, partial double, others array<struct<word: string, times: long>>"


def score_batches(batches: Iterator[pa.RecordBatch], words: Words, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    net = parts_of(flat)
    for batch in batches:
        for i in range(0, len(batch), TOGETHER):
            part = batch.slice(i, TOGETHER)
            ids, places, shares, others = coded_texts(part.column("text"), words)
            logs = shares.copy()
            for j in range(0, len(places), BATCH):
                at = places[j : j + BATCH]
                logs[j : j + BATCH] += log_chances(net, ids, at)
            # a text's places follow its edges, so its number is how many edges precede
            owner = (places - np.arange(len(places))) // WINDOW - 1
            n = np.bincount(owner, minlength=len(part))
            sums = np.bincount(owner, weights=logs, minlength=len(part))
            columns = [part.column("row"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), others]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "partial", "others"])


def scored(docs: DataFrame, model: tuple[Words, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every row, whole texts. Null and blank texts have no token, a
    sum of 0 and a null mean; repeated rows repeat; an empty table gives none."""
    words, flat = model
    local = words.local()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    made = stored(rows.mapInArrow(lambda it: score_batches(it, local, flat), SCORES), "lm-scores")
    shares = words.shares(made.select("row", F.inline("others")))
    rest = shares.groupBy("row").agg(F.sum(F.col("times") * F.col("share")).alias("rest"))
    total = F.col("partial") + F.coalesce("rest", F.lit(0.0))
    return made.join(rest, "row", "left").select(
        "doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood")
    )
