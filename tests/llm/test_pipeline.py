import re
from collections import Counter

import corpus_pipeline
from placespark.llm import decontaminate, toxicity
from placespark.llm.tables import written


def least_of_similar(rows):
    """Least ids of the groups that all pairs of a five-word Jaccard similarity of 0.8 or more make, by brute force."""
    sets = []
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and 5 * both >= 4 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return set(least.values())


def test_stages_do_what_their_operators_find(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "benchmark_decontamination", "secret_scan", "pack"]

    kept = written(stages["toxicity"](spark, docs, sf))
    report = toxicity.toxicity_report(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in report.where("predicted = 0").collect()}

    single = written(stages["near_duplicates"](spark, kept, sf))
    assert single.columns == columns and {r.doc_id for r in single.collect()} == least_of_similar(kept.collect())

    clean = written(stages["benchmark_decontamination"](spark, single, sf))
    bad = decontaminate.contamination_report(single, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - {r.doc_id for r in bad}

    masked = written(stages["secret_scan"](spark, clean, sf))
    before = {r.doc_id: r for r in clean.collect()}
    assert masked.columns == columns and masked.count() == clean.count()
    for r in masked.collect():
        assert not re.search("[0-9a-f]{16}", r.text) and (r.text == before[r.doc_id].text or "[SECRET]" in r.text) and r.n_chars == len(r.text)

    packed = stages["pack"](spark, masked, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in masked.collect()}
    assert all(sum(x.length for x in packed if x.sequence_id == s) <= 2048 for s in Counter(r.sequence_id for r in packed))
    assert sorted((r.doc_id, r.piece, r.length) for r in packed) == sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, sf).collect())


def test_edges(spark, edges, nothing, sf):
    for docs in (edges, nothing):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            assert name == "pack" or docs.columns == columns
            docs = written(docs)
        docs.count()
