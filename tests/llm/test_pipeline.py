"""The pipeline's stages on planted rows, against plain reasoning about what must stay."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(4)
    pool = ["".join(rng.choices("abcdeghilnorst", k=rng.randint(3, 9))) for _ in range(3000)]
    texts = {i: " ".join(rng.choices(pool, k=120)) for i in range(300)}
    item = " ".join(rng.choices(pool, k=16))
    toxic, copied, leaked = set(range(0, 60)), set(range(300, 320)), set(range(100, 110))
    for i in toxic:
        texts[i] += " you idiot, stupid moron"
    for i in copied:
        words = texts[i - 150].split()
        words[rng.randrange(120)] = "other"
        texts[i] = " ".join(words)
    for i in leaked:
        texts[i] = texts[i][:200] + " " + item.upper() + "! " + texts[i][200:]
    texts[400], texts[401] = None, ""
    root = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", 0) for i, t in texts.items()], DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "never seen anywhere at all in these texts")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, texts, toxic, copied, leaked


def test_stages_keep_what_they_should(spark, planted):
    root, texts, toxic, copied, leaked = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    def ids(df):
        assert df.columns == docs.columns
        return [r.doc_id for r in df.collect()]

    clean = ids(stages["toxicity"](spark, docs, root))
    assert sorted(clean) == sorted(set(texts) - toxic)
    single = ids(stages["near_duplicates"](spark, docs, root))
    assert sorted(single) == sorted(set(texts) - copied - {401})
    assert sorted(ids(stages["decontamination"](spark, docs, root))) == sorted(set(texts) - leaked)
    mixed = ids(stages["mixing"](spark, docs, root))
    assert max(mixed.count(i) for i in set(mixed)) <= 3
    shards = [r.asDict() for r in stages["tokens"](spark, docs, root).collect()]
    assert sum(r["n_docs"] for r in shards) == len(texts)


def test_run_is_the_stages_in_order(spark, planted):
    root, texts, toxic, copied, leaked = planted
    out = corpus_pipeline.run(spark, root)
    assert out.agg(F.sum("n_docs")).first()[0] >= 0.9 * (len(texts) - len(toxic | copied | leaked))
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
    again = repair.shards(docs, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    assert again.agg(F.sum("n_tokens")).first()[0] == out.agg(F.sum("n_tokens")).first()[0]
