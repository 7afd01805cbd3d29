"""The pipeline's stages on small tables, each against what its predecessor kept."""

import corpus_pipeline
from ledgerline.llm import op6_parity_join, op10_quality
from ledgerline.llm.common import shared_folder, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names, kept = docs.columns, [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:4]:
        path = shared_folder(spark, "test")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == names
        kept.append(docs.collect())
    every, quality, clean, single, mixed = ({r["doc_id"]: r["text"] for r in rows} for rows in kept)

    def passes(text):
        m = dict(zip(op10_quality.MEASURES, op10_quality.measure(text), strict=True))
        return m["n_words"] >= 20 and 100 * m["n_repeat_words"] <= 30 * m["n_words"]

    assert set(quality) <= {i for i, t in every.items() if passes(t)}
    assert set(clean) <= set(quality)
    # near duplicates: the least document of each component by brute force
    ids = sorted(clean)
    found = {i: op6_parity_join.shingles(clean[i], 5) for i in ids}
    least = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and op6_parity_join.linked(found[i], found[j], 80):
                a, b = least[i], least[j]
                least = {k: min(a, b) if v in (a, b) else v for k, v in least.items()}
    assert sorted(single) == sorted(set(least.values()))
    assert set(mixed) <= set(single) and mixed.items() <= every.items()
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert last.count() == len(kept[4])
