import corpus_pipeline
import fixtures
from eoframe.llm import exact, mixing, packing, simhash, toxicity


def test_stages_and_run(spark, tmp_path):
    rows = [(i, ("word%d " % (i % 40)) * (20 + i % 7) + str(i % 50), "en", f"s{i % 3}", 1) for i in range(120)]
    fixtures.docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the same by the plain operators, whose own tests hold them against brute force
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    none = spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.drop_toxic(docs, docs, none).count() == 120
    kept = {r.doc_id for r in exact.exact_groups(docs).where("kept").collect()}
    left = docs.where(docs.doc_id.isin(*kept))
    ones = {r.component_id for r in simhash.near_groups(left).collect()}
    left = left.where(left.doc_id.isin(*ones))
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(left).collect()}
    tokens = {r.doc_id: len(packing.token_ids(packing.coder(), r.text)) for r in left.collect()}
    have = {}
    for p in got:
        have[p.doc_id] = have.get(p.doc_id, 0) + p.length
    assert have == {i: n * tokens[i] for i, n in copies.items() if n}
