"""The pipeline against a brute-force version of its stages, each on the input it had."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from askwright.llm.toxicity import fit_toxicity

from .test_exact_and_shards import lower
from .test_text_operators import WORDS, brute_contamination, brute_links


def corpus(tmp_path, spark):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        rows.append((i, text(30) + (" you scum " if bad else " ") + text(5)))
        labels.append((i, 1, int(bad)))
    base = text(120)
    rows += [(200, base), (201, base.upper()), (202, base + " one"), (203, base + " two"), (204, None), (205, ""), (206, "")]
    rows += [(210, text(10) + " " + " ".join(WORDS[:12])), (211, " ".join(WORDS[:9])), (212, text(3000)), (213, text(4) + " you scum " + text(4))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(WORDS))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    rows = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    field = fit_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(i, t) for i, t in rows if field.score([field.read(t or "")[0]])[0] < 0.3]
    assert not {i for i, _ in left} & {0, 4, 8, 213} and {1, 2, 3, 204, 212} <= {i for i, _ in left}
    last = {}
    for i, t in left:
        last[lower(t)] = max(i, last.get(lower(t), i))
    left = [(i, t) for i, t in left if last[lower(t)] == i]
    links, label = brute_links(left), list(range(len(left)))
    for _ in left:
        label = [min([label[k], *(label[j] for j in links[k])]) for k in range(len(left))]
    least = {}
    for k, (i, _) in enumerate(left):
        least[label[k]] = min(i, least.get(label[k], i))
    left = [(i, t) for k, (i, t) in enumerate(left) if least[label[k]] == i]
    clean = {r[0] for r in brute_contamination(left, [(1, " ".join(WORDS))]) if not r[-1]}
    told = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in told.collect()} == clean
    assert told.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
