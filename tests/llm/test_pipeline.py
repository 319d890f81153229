"""The pipeline on the small tables against plain versions of its stages."""


import corpus_pipeline
from test_minhash import brute as all_pairs
from test_scoring import contamination

from tidewire.llm import toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, FOLDER)
    assert clean.columns == docs.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where(~toxicity.held_out("doc_id"))
    scored = {r.doc_id: r.tox for r in toxicity.score(docs, toxicity.learn(docs, labels), out="tox").collect()}
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == {d for d, s in scored.items() if s < 0.5}

    single = stages["near_duplicates"](spark, clean, FOLDER)
    kept = {r[0] for r in all_pairs(list(texts), list(texts.values()), 5, 80) if r[3]}
    assert {r.doc_id for r in single.collect()} == kept and single.columns == docs.columns

    cut = {r.doc_id: r for r in stages["decontamination"](spark, single, FOLDER).collect()}
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    order = sorted(kept)
    for d, (n, hit, _) in zip(order, contamination([texts[d] for d in order], items, 10)):
        assert (d in cut) == (n == 0 or hit < n)
        if not hit:
            assert cut[d].text == texts[d]
    left = contamination([r.text for r in cut.values()], items, 10)
    assert sum(hit for _, hit, _ in left) == 0

    final = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in final} == set(cut)
    assert all(r.n_tokens == len(r.ids) for r in final)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
