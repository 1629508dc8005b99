"""The pipeline's stages against plain versions on the smallest tables."""

import zlib

import corpus_pipeline
from pricebase.llm import quality
from tests.conftest import SMALL
from tests.llm.test_set_operators import brute_components


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    (_, classify), (_, exact), (_, near), (_, pack) = corpus_pipeline.STAGES
    good = classify(spark, docs, SMALL).cache()
    assert good.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    learned = [i for i in labels if zlib.crc32(str(i).encode()) % 5]
    assert sum((i in kept) == bool(labels[i]) for i in learned) >= 0.95 * len(learned)
    trees = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in quality.score(docs, trees).collect()}
    assert kept == {i for i, p in scores.items() if p}

    single = exact(spark, good, SMALL).cache()
    texts = {}
    for r in good.collect():
        texts[r.text or ""] = max(r.doc_id, texts.get(r.text or "", -1))
    assert sorted(r.doc_id for r in single.collect()) == sorted(texts.values()) and single.columns == docs.columns

    apart = near(spark, single, SMALL).cache()
    groups = brute_components([(r.doc_id, r.text) for r in single.collect()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, c in groups.values()}) and apart.columns == docs.columns

    packed = pack(spark, apart, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in apart.collect()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, packed))
