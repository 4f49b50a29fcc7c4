import re
from collections import Counter

import corpus_pipeline
from spindrift.llm import langid, simhash


def test_stages_on_odd_rows(spark, documents, odd_rows, tmp_path):
    columns = documents([]).columns
    for rows in (odd_rows, []):
        docs = documents(rows)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "unused")
            path = f"{tmp_path}/{len(rows)}-{i}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns, name


def test_run_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    names = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert len(texts) >= 0.98 * docs.count() and all(names[i] != "und" for i in texts)
    single = corpus_pipeline.near_dedup(spark, kept, sf_dir)
    ids = sorted(r["doc_id"] for r in single.collect())
    sets = {i: set(simhash.shingle_hashes(texts[i].encode(), 5).tolist()) for i in texts}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    left = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(a, b)]
    assert not left
    gone = set(texts) - set(ids)
    assert gone and all(any(alike(g, i) for i in texts if i != g) for g in gone)
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_scan(spark, single, sf_dir).collect()}
    assert set(masked) == set(ids) and not any(re.search("[0-9a-f]{24}", t) for t in masked.values())
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.source_mix(spark, single, sf_dir).collect())
    assert set(mixed) <= set(ids) and max(mixed.values()) <= 3
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out[0].asDict())
