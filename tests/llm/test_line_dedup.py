"""Repeated runs against a search over all pairs of lines."""

import random

from pyspark.sql import functions as F

from tallyforge.llm import line_dedup as L


def lines(rng, n, low=3, high=14):
    return [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(rng.randint(low, high))) for _ in range(n)]


def test_picks_cover_every_run_and_agree_inside_shared_runs():
    rng = random.Random(1)
    for _ in range(50):
        words = [rng.randint(1, 70) for _ in range(rng.randint(1, 40))]
        hashes = [rng.getrandbits(62) for _ in words]
        found = L.picks(hashes, words)
        for i, stop in enumerate(L.shortest_runs(words, L.RUN_WORDS)):
            if stop:
                inside = [f for f in found if f[1] >= i and f[1] + f[2] <= stop]
                assert inside
                grams = [L.signed_hash(L.np.array(hashes[s:e], "i8").tobytes()) for s, e in enumerate(L.shortest_runs(words, L.GRAM_WORDS)) if e and s >= i and e <= stop]
                assert min(f[0] for f in inside) == min(grams)


def plain_repeats(docs, least):
    """For each document the lines inside a run of at least so many words that an earlier place has."""
    seqs = {i: [" ".join(w) for _, w in L.filled_lines(t)] for i, t in docs}
    out = {i: set() for i, _ in docs}
    ids = sorted(seqs)
    for d in ids:
        for r in ids:
            if r > d:
                break
            a, b = seqs[d], seqs[r]
            for shift in range(-len(b), len(a)):
                if r == d and shift <= 0:
                    continue
                run = []
                for j in range(len(a) + 1):
                    i = j - shift
                    if j < len(a) and 0 <= i < len(b) and a[j] == b[i]:
                        run.append(j)
                    else:
                        if sum(len(a[k].split()) for k in run) >= least:
                            out[d].update(run)
                        run = []
    return out


def test_deletions_match_all_pairs(spark):
    rng = random.Random(2)
    passages = [lines(rng, rng.randint(5, 12), 8, 12) for _ in range(4)] + [["one long line " * 30], lines(rng, 1, 60, 60)]
    docs = []
    for i in range(40):
        body = lines(rng, 12)
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randrange(len(body))
            body[at:at] = p
        docs.append((i, "\n".join(body).replace("a", "a ", 0)))
    docs.append((40, docs[3][1]))
    docs.append((41, "\n\n".join(lines(rng, 3) + passages[0] * 2)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in L.deduplicated(df).collect()}
    sure, possible = plain_repeats(docs, 50), plain_repeats(docs, 25)
    for i, text in docs:
        seq = [" ".join(w) for _, w in L.filled_lines(text)]
        kept, gone, k = [" ".join(x.split()) for x in got[i].text.split("\n") if x.strip()], set(), 0
        for j, line in enumerate(seq):  # lines are invented, so a line is one kept as soon as it comes next
            if k < len(kept) and kept[k] == line and not (j in sure[i] and line in seq[:j]):
                k += 1
            else:
                gone.add(j)
        assert k == len(kept)
        assert sure[i] <= gone <= possible[i], i
        assert got[i].removed_lines == len(gone)
    assert sum(map(len, sure.values())) > 100


def test_odd_rows(spark):
    long = "\n".join(["word " * 60, "", "x"])
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (4, long), (None, long), (6, "word " * 60 + "\n" + "word " * 60), (7, "a\n" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("q")).withColumn("start", F.lit(0))
    got = L.deduplicated(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    assert by[None][0].text == long and by[None][0].removed_lines == 0
    assert [r.text for r in by[4]] == ["", ""]
    assert (by[6][0].text, by[6][0].removed_words) == ("", 120)
    assert [by[i][0].text for i in (1, 2, 3)] == ["", "", "\n\n"]
    assert by[7][0].removed_words >= 100_000 - 60
    assert L.deduplicated(df.limit(0)).count() == 0
