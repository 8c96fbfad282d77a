"""The audit against applying the filters one after the other to whole texts."""

import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import filter_audit as A

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_failures(docs):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": text in least and (i is None or i > least[text]),
        }
        yield i, lang or "", {f for f, failed in fails.items() if failed}


def plain_audit(docs, labels):
    rows = list(plain_failures(docs))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    out = {}
    for part in {p for _, p, _ in rows}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in rows if p == part]
            whole = list(left)
            for step, letter in enumerate(order, 1):
                removed = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                total[letter] += len(removed)
                out[part, order, step] = [
                    len(left), len(removed), sum(letter in f for _, f in whole) - len(removed), sum(f == {letter} for _, f in whole),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed),
                ]
        for key in out:
            if key[0] == part:
                out[key].append(total[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    rows = A.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows
    }


def invented(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, rng.choice([20, 400]), rng.integers(0, 420))]
        text = rng.choice([" ", "\n", "\t\x0b "]).join(words)
        text = text.upper() if rng.random() < 0.3 else text
        rows.append((i, text + rng.choice(["", "#", " é| "]), str(rng.choice(["en", "fr"]))))
    return rows


def test_audit_equals_applying_all_orders(spark):
    docs = invented(120, 1)
    docs += [(200 + i, docs[i % 7][1], "en") for i in range(60)] + [(i, docs[3][1], "fr") for i in (-1, 300)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 250)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_nulls_repeated_rows_and_labels(spark):
    docs = [(1, None, None), (2, "", "en"), (2, "", "en"), (3, "a b", ""), (None, "a b", "en"), (None, "a b", "en"), (3, "a b", "")]
    docs += [(5, "x" * 300_000 + " y" * 70_000, "en"), (5, "x", "de"), (6, "  \t\n ", "en")]
    labels = [(1, None, 1), (1, 1, None), (2, 0, 0), (2, 1, 0), (None, 1, 1), (99, 1, 1)]
    got = audited(spark, docs, labels)
    want = plain_audit(docs, labels)
    # a null id has no label
    assert {k[0] for k in got} == {"", "en", "de"}
    assert {k: v[:4] + v[6:] for k, v in got.items()} == {k: v[:4] + v[6:] for k, v in want.items()}
    assert got["", "ABCDE", 1][4:6] == (1, 1) and got["en", "ABCDE", 1][4:6] == (2, 0)


def test_empty_tables_and_clashing_columns(spark):
    docs, labels = invented(10, 2), [(i, 1, 0) for i in range(5)]
    assert audited(spark, [], labels) == {}
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(7) for c in ("part", "failed", "good", "toxic", "n", "digest", "words", "step")})
    known = spark.createDataFrame(labels, LABELS).withColumns({c: F.lit(7) for c in ("text", "good", "part", "lang")})
    got = {(r.part, r.filter_order, r.step): r.kept for r in A.audit(frame, known).collect()}
    assert got == {k: v[0] for k, v in plain_audit(docs, labels).items()}
    assert audited(spark, docs, []) == plain_audit(docs, [])


def test_transducer_counts():
    texts = ["", " ", "Ab cd\x0bcd é x 漢字 𝒳", "a" * 17 + " " + "a" * 17 + " " + "a" * 16 + "b", "\x00 \x00\x00", "#$%&*|", "tail ", "next"]
    got = A.measured([t.encode() for t in texts])
    assert got["words"].tolist() == [len(WORD.findall(t)) for t in texts]
    assert got["distinct_words"].tolist() == [len(set(WORD.findall(t))) for t in texts]
    assert got["code_points"].tolist() == [len(t) for t in texts]
    assert got["capitals"].tolist() == [sum("A" <= c <= "Z" for c in t) for t in texts]
    assert got["symbols"].tolist() == [sum(c in "#$%&*|" for c in t) for t in texts]


def test_hash_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(A, "span_hashes", lambda words, starts, lengths, owners: np.zeros(starts.size, np.uint64))
    texts = ["a b c a b", "abcdefgh1 abcdefgh2 abcdefgh1", "a a a"]
    assert A.measured([t.encode() for t in texts])["distinct_words"].tolist() == [3, 2, 1]
