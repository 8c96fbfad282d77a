"""Toxicity by weak supervision.

Sixteen voters look at a text: a fixed insult list, spellings that hide insults, shouting, and lexicons of word beginnings that
labelled rows tie to toxic texts. A generative label model is fitted by expectation-maximisation to how often every combination of votes
occurs in all documents, together with the labelled rows as one more noisy voter: it estimates each voter's accuracy, joins
voters that stay correlated within a class into one, and gives posterior labels. A linear classifier over counts of word
beginnings is trained on those posteriors and scores every text.

Combinations of votes number 65,536 at most, whatever the corpus; the driver sees their counts, counts of candidate
beginnings with enough support, and the features of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import whole_text

#: labelled rows that the models are fitted on, those with the smallest hashes
MOST_LABELLED = 20_000
#: word beginnings that the classifier knows
MOST_FEATURES = 1024
LENGTHS = range(3, 9)
LONGEST = 24
#: labelled toxic documents in which a beginning must occur
LEAST_SUPPORT = 6
#: and at least so many of them for each clean document that has it
LEAST_RATIO = 0.4
MINED_VOTERS = 11
VOTERS = 16

# Insults that one voter looks for.
INSULTS = (
    "clown", "cretin", "disgusting", "dumb", "filth", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic",
    "scum", "stupid", "trash", "vermin", "worthless",
)
DISGUISES = str.maketrans("013457@$!", "oieastasi")
INSULT_SET = frozenset(INSULTS)
YOU = frozenset(("you", "your", "you're", "u"))
WATCHED = INSULT_SET | YOU
WORDS = re.compile(r"\w+")
STYLE = 4
#: beginnings that a task counts before it passes them on
HELD = 100_000
#: texts that are read together
TOGETHER = 1024


@dataclass
class Model:
    """What scoring needs; a few thousand numbers."""

    features: dict[str, int]
    voters: list[list[tuple[str, int]]]
    weights: np.ndarray
    scale: tuple[np.ndarray, np.ndarray]


def beginnings(word: str) -> list[str]:
    """The word itself and its beginnings of a few letters."""
    return [word[:LONGEST], *(word[:k] for k in LENGTHS if k < len(word))]


def words_in(text: str) -> list[str]:
    return WORDS.findall(text.lower())


# --- labelled rows ---


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold, a bounded number of them."""
    known = labels.where("toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))  # 20,000 pairs of numbers at most


def support_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings with the labelled documents that hold them, counted for each few documents and added up later, so a task holds
    about ``HELD`` beginnings however many rows and words it gets."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    total = [0, 0]

    def flush() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array([*names, ""], pa.string()), *(pa.array([*map(counts[y].__getitem__, names), total[y]], pa.int64()) for y in (1, 0))]
        for y in (0, 1):
            counts[y].clear()
            total[y] = 0
        return pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "clean"])

    for batch in batches:
        for i in range(0, len(batch), 64):
            part = batch.slice(i, 64)
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                total[toxic] += 1
                counts[toxic].update({b for w in set(words_in(text)) for b in beginnings(w)})
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield flush()
    yield flush()


def count_batches(batches: Iterator[pa.RecordBatch], features: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Of each labelled row the features and their counts, the fixed votes and the style numbers."""
    for batch in batches:
        for part in parts_of(batch):
            counts, fixed, style = read(part.column("text"), features)
            row, ids = counts.nonzero()
            ends = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
            rest = pa.array(np.append(fixed, style, axis=1).tolist(), pa.list_(pa.float64()))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, counts[row, ids].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), *lists, rest], ["toxic", "ids", "counts", "rest"])


def chosen_features(support: list, toxic: int, clean: int) -> list[str]:
    """The beginnings whose presence tells most about the label, by likelihood ratio; of those in equal rows the shortest."""
    a, b = np.array([r[1] for r in support], float), np.array([r[2] for r in support], float)
    names = [r[0] for r in support]

    def part(x, n):
        return x * np.log(np.maximum(x, 1e-9) / n)

    def total(x, y):
        return part(x, x + y + 1e-9) + part(y, x + y + 1e-9)

    gain = total(a, b) + total(toxic - a, clean - b) - total(np.float64(toxic), np.float64(clean))
    order = sorted(range(len(names)), key=lambda i: (-gain[i], len(names[i]), names[i]))
    seen, out = set(), []
    for i in order:
        key = (names[i][:3], a[i], b[i])
        if key not in seen:
            seen.add(key)
            out.append(names[i])
        if len(out) == MOST_FEATURES:
            break
    return out


def mined_voters(counts: np.ndarray, toxic: np.ndarray, names: list[str]) -> list[list[tuple[str, int]]]:
    """Lexicons of (beginning, least count): each next entry covers most uncovered toxic rows against clean ones; entries are dealt
    to the voters in turn."""
    levels = (1, 2, 3, 5)
    entries = [(n, level) for level in levels for n in range(len(names))]
    marked = counts[toxic == 1]
    covered = np.concatenate([marked >= level for level in levels], axis=1)
    clean = np.zeros(len(entries), np.int64)
    for i in range(0, len(counts), TOGETHER):
        part = counts[i : i + TOGETHER][toxic[i : i + TOGETHER] == 0]
        clean += np.concatenate([(part >= level).sum(0) for level in levels])
    allowed = clean <= 0.15 * covered.sum(0)
    left = np.ones(len(covered), bool)
    voters: list[list[tuple[str, int]]] = [[] for _ in range(MINED_VOTERS)]
    for turn in range(8 * MINED_VOTERS):
        gain = np.where(allowed, covered[left].sum(0) - 3.0 * clean, -np.inf)
        best = int(gain.argmax()) if len(gain) else -1
        if best < 0 or gain[best] < 3:
            if left.all():
                break
            left[:] = True  # cover again with other entries, so that voters overlap and can be compared
            if turn == 0:
                break
            gain = np.where(allowed, covered.sum(0) - 3.0 * clean, -np.inf)
            best = int(gain.argmax())
            if gain[best] < 3:
                break
        name, level = entries[best]
        voters[turn % MINED_VOTERS].append((names[name], level))
        allowed[best] = False
        left &= ~covered[:, best]
    return voters


# --- reading texts ---


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, TOGETHER) for i in range(0, len(batch), TOGETHER))


def disguised() -> tuple[frozenset[str], frozenset[str]]:
    """The signs that a hidden insult may begin and end with."""
    letters = {chr(k): chr(v) for k, v in DISGUISES.items()}
    return tuple(frozenset(ends) | {k for k, v in letters.items() if v in ends} for ends in ({w[0] for w in INSULTS}, {w[-1] for w in INSULTS}))


DISGUISED_FIRST, DISGUISED_LAST = disguised()


def hides_insult(word: str) -> bool:
    """A lower-case word that reads as an insult once its signs are taken as letters."""
    return word[0] in DISGUISED_FIRST and word[-1] in DISGUISED_LAST and word.isascii() and not word.isalpha() and word.translate(DISGUISES) in INSULT_SET


def finder(features: dict[str, int]):
    """A function that adds the known ones of a run's ``beginnings`` to a list."""
    start: dict[str, list[tuple[str, int]]] = {}
    for name, k in features.items():
        start.setdefault(name[: LENGTHS[0]], []).append((name, k))

    def add(run: str, out: list[int]) -> None:
        for name, k in start.get(run[: LENGTHS[0]], ()):
            if run.startswith(name) if len(name) in LENGTHS else name == run[:LONGEST]:
                out.append(k)

    return frozenset(start), add


def read(texts: pa.Array, features: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the counts of the known beginnings, the votes of the voters that are not mined, and style numbers.

    Each distinct word is looked at once; nothing that is looked for holds white space, so a text's numbers are sums over its words.
    """
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    at, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    ends = pa.array([0, len(coded.dictionary)], pa.int32())
    # words hold no line break, so one text of them all is taken apart again without a loop
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, coded.dictionary), "\n")[0].as_py()
    words = joined.split("\n") if len(coded.dictionary) else []
    lows = joined.lower().split("\n")[: len(words)]
    upper = np.array(list(map(str.isupper, words)), np.int32)
    letters = np.array(list(map(str.isalpha, lows)), bool)
    pieces, you = np.ones(len(words), np.int32), np.zeros(len(words), np.int32)
    plain, hidden = np.zeros(len(words), bool), np.zeros(len(words), bool)
    starts, add = finder(features)
    holder: list[int] = []
    held: list[int] = []

    def note(i: int, run: str) -> None:
        add(run, held)
        holder.extend([i] * (len(held) - len(holder)))

    for i, low in enumerate(lows):
        if low[: LENGTHS[0]] in starts and letters[i]:
            note(i, low)
        if low in WATCHED:
            plain[i], you[i] = low in INSULT_SET, low in YOU
    for i in np.flatnonzero(~letters).tolist():
        for run in WORDS.findall(lows[i]):
            note(i, run)
            if run in INSULT_SET:
                plain[i] = True
        parts = lows[i].split()
        if len(parts) != 1:  # white space beyond ASCII
            pieces[i], you[i] = len(parts), sum(x in YOU for x in parts)
            upper[i] = sum(map(str.isupper, words[i].split()))
        if any(map(hides_insult, parts)):
            hidden[i] = True

    def total(of: np.ndarray) -> np.ndarray:
        return np.bincount(owner, of[at], minlength=len(texts)).astype(np.int64)

    n_words, n_chars = total(pieces), pc.utf8_length(texts).to_numpy().astype(np.int64) + 1
    shouts, asks, doubled = (pc.count_substring(texts, x).to_numpy().astype(np.int64) for x in ("!", "?", "!!"))
    fixed = np.stack(
        [total(plain) > 0, total(hidden) > 0, total(upper) * 2 > n_words, doubled * 20 > n_words + 20, total(you) * 25 > n_words + 25], axis=1
    )
    style = np.stack([np.log1p(n_chars), shouts / n_chars, asks / n_chars, n_words / n_chars], axis=1)

    # every occurrence of a word counts for all beginnings that it holds
    order = np.argsort(np.array(holder, np.int64), kind="stable")
    each = np.bincount(np.array(holder, np.int64), minlength=len(words))
    first = np.cumsum(each) - each
    useful = each[at] > 0
    own, times = at[useful], each[at[useful]]
    ends = np.cumsum(times)
    source = np.arange(int(times.sum())) + np.repeat(first[own] - (ends - times), times)
    cells = np.repeat(owner[useful] * len(features), times) + np.array(held, np.int64)[order][source]
    counts = np.bincount(cells, minlength=len(texts) * len(features)).reshape(len(texts), len(features)).astype(np.float32)
    return counts, fixed, style


# --- votes ---


def mined_votes(counts: np.ndarray, features: dict[str, int], voters: list[list[tuple[str, int]]]) -> np.ndarray:
    none = np.zeros(len(counts), bool)
    return np.stack([np.any([counts[:, features[b]] >= k for b, k in lexicon], axis=0) if lexicon else none for lexicon in voters], axis=1)


def vote_batches(batches: Iterator[pa.RecordBatch], voters: list[list[tuple[str, int]]]) -> Iterator[pa.RecordBatch]:
    names = dict.fromkeys(n for lexicon in voters for n, _ in lexicon)
    features = {n: i for i, n in enumerate(names)}
    seen = np.zeros(1 << VOTERS, np.int64)
    for batch in batches:
        for part in parts_of(batch):
            counts, fixed, _ = read(part.column("text"), features)
            codes = np.append(mined_votes(counts, features, voters), fixed, axis=1) @ (1 << np.arange(VOTERS))
            seen += np.bincount(codes, minlength=1 << VOTERS)
    votes = np.flatnonzero(seen)
    if len(votes):
        yield pa.RecordBatch.from_arrays([pa.array(votes, pa.int32()), pa.array(seen[votes])], ["votes", "n"])


# --- the label model ---


def label_model(all_votes: dict[int, int], labelled: list[tuple[int, int]]) -> tuple[np.ndarray, float]:
    """(log odds of toxic for each combination of votes, label accuracy) by expectation-maximisation.

    Labelled rows weigh as much as all documents together. Voters whose votes stay correlated within the classes become one
    voter with a joint table.
    """
    gold = Counter(labelled)
    patterns = sorted({0, *all_votes, *(v for v, _ in gold)})
    at = {p: i for i, p in enumerate(patterns)}
    free = np.array([all_votes.get(p, 0) for p in patterns], float)
    marked = np.zeros((len(patterns), 2))
    for (p, y), n in gold.items():
        marked[at[p], y] += n
    marked *= max(1.0, free.sum()) / max(1.0, marked.sum())
    bits = np.array(patterns)[:, None] >> np.arange(VOTERS) & 1
    groups = [[i] for i in range(VOTERS)]
    prior, right = (marked.sum(0) + 1) / (marked.sum() + 2), 0.97
    soft = np.stack([marked[:, 0] * right + marked[:, 1] * (1 - right), marked[:, 1] * right + marked[:, 0] * (1 - right)], axis=1)
    for round_ in range(24):
        odds = np.full(len(patterns), np.log(prior[1] / prior[0]))
        for group in groups:
            code = bits[:, group] @ (1 << np.arange(len(group)))
            table = np.zeros((1 << len(group), 2))
            np.add.at(table, code, soft)
            total = soft.sum(0) + 1e-9
            table = (table + 0.5 * total / total.sum()) / (total + 0.5 * len(table) * total / total.sum())
            odds += np.log(table[code, 1] / table[code, 0])
        odds = np.clip(odds, -12, 12)
        shift = np.log(right / (1 - right))
        parts = [(free, sigmoid(odds)), (marked[:, 1], sigmoid(odds + shift)), (marked[:, 0], sigmoid(odds - shift))]
        toxic = sum(n * q for n, q in parts)
        soft = np.stack([sum(n for n, _ in parts) - toxic, toxic], axis=1)
        prior = (soft.sum(0) + 1) / (soft.sum() + 2)
        agree = marked[:, 1] @ parts[1][1] + marked[:, 0] @ (1 - parts[2][1])
        right = float(np.clip(agree / max(1.0, marked.sum()), 0.8, 0.99))
        if round_ == 11:
            groups = joined(bits, soft)
    return np.stack([np.array(patterns), odds]), right


def joined(bits: np.ndarray, soft: np.ndarray, least: float = 0.3, widest: int = 6) -> list[list[int]]:
    """Groups of voters whose votes correlate beyond what the classes explain."""
    covariance = np.zeros((VOTERS, VOTERS))
    for y in (0, 1):
        w = soft[:, y] / max(soft[:, y].sum(), 1e-9)
        x = bits - w @ bits
        covariance += soft[:, y].sum() * (x * w[:, None]).T @ x
    sd = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
    phi = np.abs(covariance / np.outer(sd, sd))
    groups = [[i] for i in range(VOTERS)]
    for i, j in sorted(((i, j) for i in range(VOTERS) for j in range(i)), key=lambda p: -phi[p]):
        a, b = next(g for g in groups if i in g), next(g for g in groups if j in g)
        if phi[i, j] >= least and a is not b and len(a) + len(b) <= widest:
            groups.remove(b)
            a += b
    return groups


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


# --- the classifier ---


def fitted(x: np.ndarray, q: np.ndarray, steps: int = 400, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights for soft labels q; Adam on the full sample. The last column of x is the constant's, all ones."""
    w, m, v = np.zeros(x.shape[1], np.float32), 0.0, 0.0
    for t in range(1, steps + 1):
        g = x.T @ (sigmoid(x @ w) - q).astype(np.float32) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - np.float32(0.05) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the voters, the label model over all documents and the classifier. Without labelled rows of both classes, only
    the fixed voters speak."""
    rows = training_rows(docs, labels)
    support = rows.mapInArrow(support_batches, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    found = support.where(f"t >= {LEAST_SUPPORT} OR feature = ''").where(f"t > {LEAST_RATIO} * c OR feature = ''")
    found = found.orderBy(F.desc(F.expr("feature = ''")), F.desc(F.expr("t - 0.1 * c")), "feature").limit(40_000).collect()
    totals = next(((r.t, r.c) for r in found if r.feature == ""), (0, 0))
    names = chosen_features([(r.feature, r.t, r.c) for r in found if r.feature], *totals) if min(totals) else []
    features = {n: i for i, n in enumerate(names)}
    sample = rows.mapInArrow(lambda it: count_batches(it, features), "toxic int, ids array<int>, counts array<int>, rest array<double>").toArrow()
    n = len(sample)
    # the only matrix of its size that the driver holds: first counts, then the classifier's input, changed in place
    x = np.zeros((n, len(names) + VOTERS + STYLE + 1), np.float32)
    counts = x[:, : len(names)]
    fill_counts(counts, sample)
    toxic = sample.column("toxic").to_numpy()
    rest = np.array(sample.column("rest").to_pylist(), np.float32).reshape(n, VOTERS - MINED_VOTERS + STYLE)
    voters = mined_voters(counts, toxic, names) if min(totals) else [[] for _ in range(MINED_VOTERS)]
    bits = np.append(mined_votes(counts, features, voters), rest[:, :-STYLE] > 0, axis=1)
    codes = bits @ (1 << np.arange(VOTERS))
    texts = docs.select(whole_text().alias("text"))
    everywhere = texts.mapInArrow(lambda it: vote_batches(it, voters), "votes int, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    (patterns, odds), right = label_model({r.votes: r.n for r in everywhere}, list(zip(codes.tolist(), toxic.tolist())))
    posterior = dict(zip(patterns.astype(int).tolist(), odds.tolist()))
    shift = np.log(right / (1 - right))
    q = sigmoid(np.array([posterior[c] for c in codes.tolist()]) + np.where(toxic == 1, shift, -shift))
    np.log1p(counts, out=counts)
    x[:, len(names) : len(names) + VOTERS] = bits
    x[:, len(names) + VOTERS : -1] = rest[:, -STYLE:]
    x[:, -1] = 1
    mean, sd = scale_of(x[:, :-1])
    mean[: len(names) + VOTERS] = 0  # an absent word says nothing
    x[:, :-1] -= mean
    x[:, :-1] /= sd
    weights = fitted(x, q) if n else np.where(np.arange(x.shape[1]) == len(names) + MINED_VOTERS, 4, np.where(np.arange(x.shape[1]) == x.shape[1] - 1, -2, 0)).astype(np.float32)
    return Model(features, voters, weights, (mean, sd))


def fill_counts(counts: np.ndarray, sample: pa.Table) -> None:
    """Writes the rows' counts into a matrix of zeros."""
    done = 0
    for batch in sample.select(["ids", "counts"]).to_batches(max_chunksize=TOGETHER):
        row = np.repeat(done + np.arange(len(batch)), pc.list_value_length(batch.column("ids")).to_numpy())
        counts[row, batch.column("ids").flatten().to_numpy()] = batch.column("counts").flatten().to_numpy()
        done += len(batch)


def scale_of(x: np.ndarray, columns: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the columns, a few at a time."""
    if not len(x):
        return np.zeros(x.shape[1], np.float32), np.ones(x.shape[1], np.float32)
    parts = [x[:, i : i + columns] for i in range(0, x.shape[1], columns)]
    return np.concatenate([p.mean(0) for p in parts]), np.concatenate([p.std(0) for p in parts]) + np.float32(1e-3)


def classifier_input(counts: np.ndarray, bits: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.concatenate([np.log1p(counts), bits, shape], axis=1, dtype=np.float32)


def scores_of(texts: pa.Array, model: Model) -> np.ndarray:
    counts, fixed, style = read(texts, model.features)
    bits = np.append(mined_votes(counts, model.features, model.voters), fixed, axis=1)
    x = (classifier_input(counts, bits, style.astype(np.float32)) - model.scale[0]) / model.scale[1]
    return sigmoid((x @ model.weights[:-1] + model.weights[-1]).astype(np.float64))


def score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores_of(part.column("text"), model))], ["doc_id", "score"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null texts count as empty, repeated rows repeat."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    made = texts.mapInArrow(lambda it: score_batches(it, model), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return made.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch):
            texts = pc.fill_null(part.column("text").cast(pa.string()), "")
            yield part.filter(pa.array(scores_of(texts, model) < 0.5))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, columns as they came; no shuffle."""
    return docs.mapInArrow(lambda it: clean_batches(it, model), docs.schema)
