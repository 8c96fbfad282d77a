"""Edit matches against a plain dynamic programme over every place of every text."""

import random

from pyspark.sql import functions as F

from tallyforge.llm import decontaminate as D


def least_distance(pattern, text):
    column = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, column[0] = column[0], i
        for j, c in enumerate(text, 1):
            last, column[j] = column[j], min(last + (p != c), column[j] + 1, column[j - 1] + 1)
    return min(column)


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("xyz") + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def sentences(rng, n, words):
    return [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(words)) for _ in range(n)]


def test_distance_is_the_least_over_substrings():
    rng = random.Random(1)
    for _ in range(60):
        pattern = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc", k=40)) + edited(rng, pattern + "b", 3) + "cab"
        best, end = D.best_ending(D.letter_masks(pattern), len(pattern), text)
        assert best == least_distance(pattern, text)
        assert 0 <= end <= len(text)


def test_matches_equal_brute_force(spark):
    rng = random.Random(2)
    items = list(enumerate(sentences(rng, 12, 18)))
    docs = []
    for i in range(60):
        text = sentences(rng, 1, 40)[0]
        item = items[i % 12][1]
        text = text[:100] + "\n" + edited(rng, item.upper().replace(" ", "!! "), i // 6) + " " + text[100:]
        docs.append((i, text))
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in got.collect()}
    want = {}
    for d, text in docs:
        for k, item in items:
            pattern = D.normal(item)
            distance = least_distance(pattern, D.normal(text))
            if distance <= int(len(pattern) * D.EDIT_RATE):
                want[d, k] = distance
    assert len(want) >= 30
    assert got == want


def test_items_that_repeat_a_phrase(spark):
    item = "one two six ten abc one two six ten abcd " * 6
    text = "xxxxx " + item + "and more"
    got = D.matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [(r.distance, D.normal(text)[r.start :].startswith(D.normal(item))) for r in got.collect()] == [(0, True)]

    rng = random.Random(3)
    for n in range(60):
        phrase = sentences(rng, 1, 3)[0] + " "
        item = phrase * 3 + edited(rng, phrase, 1) * rng.randint(1, 3) + phrase
        text = phrase * rng.randint(0, 4) + edited(rng, item, n % 6) + phrase * rng.randint(0, 3)
        pattern = D.normal(item)
        distance = least_distance(pattern, D.normal(text))
        found = [hit[1] for hit in D.Finder([(1, item)], D.EDIT_RATE).search(text)]
        assert found == ([distance] if distance <= int(len(pattern) * D.EDIT_RATE) else [])


def test_separate_copies_are_counted():
    item, gap = "who wrote the first of these long books", " and " * 20
    assert D.Finder([(1, item)], D.EDIT_RATE).search(gap.join([item] * 3)) == [(1, 0, 0, 3)]


def test_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 10)
    items = spark.createDataFrame([(1, "Who wrote it?"), (1, "Who wrote it?"), (2, None), (3, " ?! "), (None, "Another one")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x who WROTE it y"), (1, "x who WROTE it y"), (2, None), (3, ""), (None, "another, one"), (5, "a " * 200_000 + "Who wrote it")],
        "doc_id long, text string",
    ).withColumn("row", F.lit(7)).withColumn("item_id", F.lit("k"))
    got = sorted((r.doc_id or -1, r.item_id or -1, r.distance) for r in D.matches(docs, items).collect())
    assert got == [(-1, -1, 0), (1, 1, 0), (1, 1, 0), (5, 1, 0)]
    kept = D.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert D.without_leaks(docs, items.limit(0)).count() == 6
    assert D.matches(docs.limit(0), items).count() == D.matches(docs, items.limit(0)).count() == 0
