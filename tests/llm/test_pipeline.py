import re

import corpus_pipeline
from paperlake.llm import quality
from paperlake.llm.common import id_bucket, stored

from .conftest import SMALL
from .test_decontaminate import brute as contamination
from .test_jaccard import brute as near_copies
from .test_packing import checked, plain_best_fit
from .test_secrets import base, entropy


def redacted(text):
    spans: list[list[int]] = []
    for s, _, e in sorted(base(text) + entropy(text)):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    for s, e in reversed(spans):
        text = text[:s] + "[secret]" + text[e:]
    return text


def test_stage_by_stage(spark):
    assert [re.sub("[^a-z]", "", name) for name, _ in corpus_pipeline.STAGES] == [
        "qualityclassifier", "ngramjaccardjoin", "benchmarkdecontamination", "secretscans", "bestfitpacking"
    ]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    machine = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), learn_from=id_bucket("doc_id", 3) != 1)
    now = {r.doc_id: r for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        assert len(rows) == docs.count()
        pairs = [(i, r.text) for i, r in now.items()]
        if name.startswith("quality"):
            wanted = {i for i, r in now.items() if machine.scores([r.text], [r.n_chars])[0] >= 0.5}
        elif name.startswith("ngram"):
            wanted = {component for _, _, component in near_copies(pairs, 5, 80)}
        elif name.startswith("benchmark"):
            wanted = {row[0] for row in contamination(pairs, items) if not row[5]}
        else:
            wanted = set(now)
            assert all(rows[i].text == redacted(t) and rows[i].n_chars == len(rows[i].text) for i, t in pairs)
        assert set(rows) == wanted
        if not name.startswith("secret"):
            assert all(rows[i] == now[i] for i in rows)
        now = rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    assert set(packed.doc_id) == set(now)
    texts = {i: r.text for i, r in now.items()}
    assert checked(packed, texts, 2048) == plain_best_fit(packed.length.tolist(), 2048)
    whole = corpus_pipeline.run(spark, SMALL).toPandas()
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(whole[keys].itertuples(index=False)) == sorted(packed[keys].itertuples(index=False))


def test_odd_documents(spark, odd_docs, tmp_path):
    docs = odd_docs
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "lost id")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for empty in (False, True):
        rows = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            rows = stored(stage(spark, rows, str(tmp_path)), "test-stage")
            if not name.startswith("best"):
                assert rows.columns == docs.columns
            assert (rows.count() == 0) == empty
