"""Gradients, probabilities that sum to one, and scores that tell order from disorder."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.llm import pseudo_likelihood as P


def sentences(n, seed):
    rng = random.Random(seed)
    nouns, verbs = [f"noun{i}ka" for i in range(30)], [f"verb{i}to" for i in range(30)]
    return [" ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} of a" for _ in range(rng.randint(3, 30))) for _ in range(n)]


def shuffled(text, seed=1):
    words = text.split()
    random.Random(seed).shuffle(words)
    return " ".join(words)


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, P.CLASSES + 1, 60).astype(np.uint8)
    at = np.array([i for i in range(2, 58) if ids[i] != P.EDGE])
    flat = P.fresh().astype(np.float64)

    def loss(x):
        return -P.log_chances(P.parts_of(x), ids, at).mean()

    squares = np.zeros_like(flat)
    after = flat.copy()
    P.step(after, squares, ids, at)
    grad = np.sqrt(squares)
    for i in rng.choice(np.flatnonzero(grad > 1e-4), 25):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert abs(abs(slope) - grad[i]) < 1e-5
        assert (after[i] < flat[i]) == (slope > 0)


def test_chances_sum_to_one_and_ignore_the_token_itself():
    ids = np.arange(40, dtype=np.uint8)
    at = np.arange(2, 38)
    net = P.parts_of(P.fresh())
    _, e, total = P.chances(net, ids, at)
    assert np.allclose((e / total[:, None]).sum(1), 1, atol=1e-5)
    assert np.allclose(np.log(e / total[:, None])[np.arange(36), ids[at]], P.log_chances(net, ids, at), atol=1e-5)
    changed = ids.copy()
    changed[20] = 99
    _, e2, total2 = P.chances(net, changed, at)
    assert np.allclose(e[18] / total[18], e2[18] / total2[18])  # place 20 itself
    assert not np.allclose(e[17] / total[17], e2[17] / total2[17])


def test_held_out_order_scores_above_disorder(spark):
    train = spark.createDataFrame([(i, t) for i, t in enumerate(sentences(3000, 2))], "doc_id long, text string").repartition(3)
    model = P.train(train)
    fresh = sentences(50, 3)
    rows = [(i, t) for i, t in enumerate(fresh)] + [(100 + i, shuffled(t)) for i, t in enumerate(fresh)]
    got = {r.doc_id: r for r in P.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i].n_tokens == len(fresh[i].split()) for i in range(50))
    assert all(got[i].mean_log_likelihood > got[100 + i].mean_log_likelihood + 0.5 for i in range(50))
    # what a network that knows the pattern can reach: 30 nouns and verbs, everything else certain
    best = 2 * np.log(30) / 5
    assert -sum(got[i].log_likelihood for i in range(50)) / sum(got[i].n_tokens for i in range(50)) < best + 0.35


def test_counts_cover_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(P, "KNOWN_WORDS", 70)
    texts = [" ".join(f"w{i % 90}x{j}" for j in range(i % 7)) for i in range(500)] + ["a  b\tA", ""]
    words = P.word_statistics(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert len(words.known) == 70
    coded, sizes = P.split_words(pa.array(texts))
    assert sizes.tolist() == [len(t.split()) for t in texts]
    assert [coded.dictionary[i].as_py() for i in coded.indices.to_pylist()] == [w.lower() for t in texts for w in t.split()]
    assert all(np.isfinite(words.lookup(w)[1]) for w in ("never", "", "w1x1"))


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, " \n "), (4, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("turn", F.lit("x")).withColumn("n_tokens", F.lit(0))
    got = P.scored(df, P.train(df)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.mean_log_likelihood is None) for r in got) == [(0, 0, True), (1, 0, True), (1, 0, True), (2, 0, True), (4, 50_000, False)]
    assert P.scored(df.limit(0), P.train(df.limit(0))).count() == 0


def test_words_beyond_the_frequent_ones_keep_their_counts(spark, monkeypatch):
    monkeypatch.setattr(P, "KNOWN_WORDS", 70)
    fill = " ".join(f"f{i}" for i in range(80)) + " "
    texts = [fill * 3] * 30 + ["seenxyz"] * 40 + ["oncexyz", "caf\u00e9xyz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words, net = P.train(docs)
    asked = ["seenxyz", "oncexyz", "missxyz"]
    assert not set(asked) & set(words.known)
    rows = spark.createDataFrame([(i, f"f1 {w} f2") for i, w in enumerate(asked)] + [(0, "f1 seenxyz f2 seenxyz")], "doc_id long, text string")
    got = sorted(P.scored(rows, (words, net)).collect(), key=lambda r: (r.n_tokens, r.doc_id))
    seen, once, miss = (r.log_likelihood for r in got[:3])
    assert abs(seen - once - np.log(40)) < 1e-5  # equal neighbours, class and length: only the counts differ
    assert abs(once - miss - 8 * P.LETTER_COST) < 1e-5
    assert abs(got[0].mean_log_likelihood - seen / 3) < 1e-9 and got[3].n_tokens == 4
    ends = P.ending_class("seenxyz")
    share = {r.word: r.share for r in words.shares(words.counts.select("word")).collect() if P.ending_class(r.word) == ends and r.word not in words.known}
    known = [s for k, s in words.known.values() if k == ends]
    assert abs(sum(map(np.exp, [*share.values(), *known, words.unseen[ends]])) - 1) < 1e-9


def test_training_looks_up_classes_alone():
    """The same classes and places as scoring has, without the lists of other words and their counts."""
    texts = pa.array(["the noun1ka Café the x", "", None, "rare 世界 the"]).fill_null("")
    words = P.Words({"the": (0, 0.0), "noun1ka": (P.ending_class("noun1ka"), -1.5)}, [-2.0] * P.CLASSES)
    ids, places, shares, others = P.coded_texts(texts, words)
    alone = P.coded_classes(texts, words)
    assert len(alone) == 2 and (alone[0] == ids).all() and (alone[1] == places).all()
    flat = "the noun1ka café the x rare 世界 the".split()
    assert ids[places].tolist() == [words.lookup(w)[0] for w in flat]
    assert shares.tolist() == [0, -1.5, 0, 0, 0, 0, 0, 0]
    assert [sorted(o["word"] for o in t) for t in others.to_pylist()] == [["café", "x"], [], [], ["rare", "世界"]]
