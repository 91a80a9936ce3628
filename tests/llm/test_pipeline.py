from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
import helpers

from flowlens.llm import packing, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = quality.fit_quality(docs, labels)
    good = {r.id for r in quality.judged(docs, model).collect() if r.kept}
    kept = docs.where(docs.doc_id.isin(sorted(good)))
    calm = {r.id for r in toxicity.scored(kept, toxicity.fit_toxicity(kept, labels)).collect() if not r.predicted}
    left = sorted((r for r in rows if r["doc_id"] in calm), key=lambda r: r["doc_id"])
    sets = [helpers.shingle_set(r["text"]) for r in left]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if helpers.jaccard(sets[i], sets[j]) >= 0.8:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    first = [(r["doc_id"], r["text"]) for i, r in enumerate(left) if root[i] == i]
    removed = {k[0]: k for k in helpers.removal(first)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(removed)
    texts = dict(first)
    unchanged = spark.createDataFrame([(d, texts[d]) for d in removed if not removed[d][2]], "doc_id long, text string")
    want = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pieces(unchanged).collect())
    untouched = {r.doc_id for r in unchanged.collect()}
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got if r.doc_id in untouched) == want


def test_stages_keep_columns_and_take_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], helpers.LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (helpers.ROWS, []):
            docs = helpers.docs(spark, rows)
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            out.collect()


def test_registered_queries():
    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
