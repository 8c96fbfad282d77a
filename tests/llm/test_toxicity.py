"""Accuracy on a held-out fold, the label model on simulated voters, and odd tables."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.llm import toxicity as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdeghilnorst", k=rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 120))
        toxic = int(rng.random() < 0.15)
        if toxic:
            bad = rng.choice([["idiot", "loser"], ["zurk" + rng.choice(plain)], ["vexi" + rng.choice(plain)]])
            for w in bad * rng.randint(1, 3):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words).capitalize(), "en", "s", 0))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, DOCS)
    model = T.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in T.scored(d, model).collect()}
    truth = {i: t for i, _, t in labels}
    assert {i for i, r in got.items() if r.held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.98 * len(held)
    assert sum(got[i].predicted for i in held if truth[i]) >= 0.9 * sum(truth[i] for i in held)
    kept = {r.doc_id for r in T.without_toxic(d, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = corpus(400)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    d = spark.createDataFrame(docs, DOCS)
    a, b = (T.train(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert list(a.features) == list(b.features)
    assert np.allclose(a.weights, b.weights)


def test_label_model_finds_accuracies_and_joins_copies():
    rng = np.random.default_rng(1)
    y = (rng.random(40_000) < 0.2).astype(int)
    hit, false = np.linspace(0.9, 0.5, 16), np.linspace(0.02, 0.1, 16)
    votes = rng.random((len(y), 16)) < np.where(y[:, None] == 1, hit, false)
    votes[:, 3] = votes[:, 2]  # a copy adds nothing
    codes = votes @ (1 << np.arange(16))
    patterns, n = np.unique(codes, return_counts=True)
    marked = list(zip(codes[:500].tolist(), y[:500].tolist()))
    (p, odds), right = T.label_model(dict(zip(patterns.tolist(), n.tolist())), marked)
    of = dict(zip(p.astype(int).tolist(), odds.tolist()))
    guess = np.array([of[c] > 0 for c in codes.tolist()])
    assert (guess == y).mean() > 0.97
    assert right > 0.95
    assert any({2, 3} <= set(g) for g in T.joined(votes.astype(int), np.stack([1 - y, y], axis=1).astype(float)))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "e", "s", 0), (1, "", "e", "s", 0), (None, "you idiot " * 50_000, "e", "s", 0)], DOCS)
    docs = docs.withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.train(docs, none)
    got = T.scored(docs, model).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert T.without_toxic(docs, model).columns == docs.columns
    assert T.scored(docs.limit(0), model).count() == 0
    assert T.without_toxic(docs.limit(0), T.train(docs.limit(0), none)).count() == 0


def test_reading_word_by_word_agrees_with_reading_texts_whole():
    odd = ["", " ", "You IDIOT!! you're a l0ser, U m0r0n", "\u039f\u0394\u039f\u03a3 \u0130stanbul STRASSE_x", "a\u00a0b YOU\u2003ARE\u00a0YOU scum.", "x\x1cy 1d10t idi0t!"]
    odd += ["zurk" * 9 + " zurk zu z? ?!", "\u00e9t\u00e9 " * 30 + "tra$h", "!!!! !! !", "you u " * 9]
    names = ["zurk", "zu", "z", "id", "idi", "idiot", "zurkzurkz", "zurk" * 6, "\u00e9t\u00e9", "str", "\u03bf\u03b4\u03bf", "los"]
    features = {n: i for i, n in enumerate(names)}
    counts, fixed, style = T.read(pa.array(odd), features)
    for text, c, votes, numbers in zip(odd, counts, fixed.tolist(), style.tolist()):
        low, n = text.lower(), len(text) + 1
        words = low.split()
        found = [b for w in T.words_in(text) for b in T.beginnings(w)]
        assert c.tolist() == [found.count(x) for x in names]
        hidden = any(w.translate(T.DISGUISES) in T.INSULT_SET for w in words if w.isascii() and not w.isalpha())
        upper, you = sum(w.isupper() for w in text.split()), sum(w in T.YOU for w in words)
        doubled = text.count("!!") * 20 > len(words) + 20
        assert votes == [any(w in T.INSULT_SET for w in T.words_in(text)), hidden, upper * 2 > len(words), doubled, you * 25 > len(words) + 25]
        assert np.allclose(numbers, [np.log1p(n), text.count("!") / n, text.count("?") / n, len(words) / n])
    assert T.read(pa.array([], pa.string()), features)[0].shape == (0, len(names))
    assert T.read(pa.array(odd), {})[0].shape == (len(odd), 0)


def test_a_task_holds_a_bounded_number_of_beginnings(monkeypatch):
    monkeypatch.setattr(T, "HELD", 50)
    rows = [(f"word{i} other{i % 7} same", i % 2) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["text", "toxic"])
    made = list(T.support_batches(iter([batch])))
    assert len(made) > 1 and max(map(len, made)) <= 50 + 3 * 7 + 1
    sums = pa.Table.from_batches(made).group_by("feature").aggregate([("toxic", "sum"), ("clean", "sum")]).to_pylist()
    got = {r["feature"]: (r["toxic_sum"], r["clean_sum"]) for r in sums}
    assert got[""] == got["same"] == got["word"] == (100, 100)
    assert got["word199"] == (1, 0) and got["other6"] == (14, 14)


def test_the_driver_holds_one_matrix_of_the_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "LEAST_SUPPORT", 1)  # so that the matrix is wide
    monkeypatch.setattr(T, "LEAST_RATIO", 0.0)
    docs, labels = corpus(4000)
    d = spark.createDataFrame(docs, DOCS).cache()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    features = T.train(d, marks).features
    tracemalloc.start()
    T.train(d, marks)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in labels)
    assert len(features) > 300
    assert most < 2.5 * 4 * n * (len(features) + 21)


def test_scale_by_few_columns_is_that_of_all():
    x = np.random.default_rng(3).random((700, 150), np.float32) * 9
    mean, sd = T.scale_of(x[:, :-1], 64)
    assert (mean == x[:, :-1].mean(0)).all() and (sd == x[:, :-1].std(0) + np.float32(1e-3)).all()
    assert mean.dtype == sd.dtype == np.float32
