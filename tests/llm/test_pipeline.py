import corpus_pipeline
from loomgraph.llm import registry
from loomgraph.llm.exact import exact_groups
from loomgraph.llm.quality import fit_quality, score_quality, training_labels
from loomgraph.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, SF)
    vectors, net = fit_quality(docs, training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in score_quality(docs, vectors, net).where("score >= 0.3").collect()}
    one = stage["exact_dedup"](spark, good, SF)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in exact_groups(good).where("kept").collect()}
    best = {}
    for r in good.collect():
        text = r.text or ""
        key = text.translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))
        best[key] = min(best.get(key, (0, float("inf"))), (-len(text), r.doc_id))
    assert {r.doc_id for r in one.collect()} == {i for _, i in best.values()}
    near = stage["near_dedup"](spark, one, SF)
    sets = {r.doc_id: set(shingle_hashes((r.text or "").encode(), 5).tolist()) for r in one.collect()}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert {r.doc_id for r in near.collect()} == {i for i, v in label.items() if i == v}
    left = {r.doc_id: set(shingle_hashes(r.text.encode(), 5).tolist()) for r in near.collect()}
    ids = sorted(left)
    assert not any(len(left[a] & left[b]) >= 0.8 * len(left[a] | left[b]) for k, a in enumerate(ids) for b in ids[:k])
    clean = stage["pii"](spark, near, SF)
    assert clean.count() == len(ids) and clean.where("text rlike '[a-z]@[a-z]+[.]'").count() == 0
    assert all(set(x.columns) == set(columns) for x in (good, one, near, clean))
    pieces = stage["packing"](spark, clean, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(ids)
    total = pieces.selectExpr("sum(length) as n").first().n
    assert corpus_pipeline.run(spark, SF).selectExpr("sum(length) as n").first().n == total


def test_repeated_rows_stay_once(spark):
    stage = dict(corpus_pipeline.STAGES)
    rows = [(1, "write to a.b@x.com now", 22)] * 30 + [(2, "another text", 12)] * 3 + [(3, "another  text", 13), (None, "no id", 5), (4, None, None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    one = stage["exact_dedup"](spark, docs, SF)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in one.collect() if r.text) == [(1, rows[0][1], 22), (3, "another  text", 13)]
    assert one.where("text is null").count() == 1 and one.columns == docs.columns
    clean = stage["pii"](spark, docs.where("doc_id in (1, 2)"), SF).collect()
    assert len(clean) == 33 and {(r.doc_id, r.text, r.n_chars) for r in clean} == {(1, "write to <EMAIL> now", 20), (2, "another text", 12)}


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 14))
