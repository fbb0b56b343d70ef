import test_linededup
import test_packing
import test_simhash_wide
from pyspark.sql import functions as F

import corpus_pipeline
from landweave.llm import decontam, langid

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]

    known = corpus_pipeline.language(spark, docs, SF)
    kept = known.collect()
    found = langid.identify(docs, langid.fit(docs, ~langid.held_out()))
    want = {r.doc_id for r in found.collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert known.columns == docs.columns and {r.doc_id for r in kept} == want and len(kept) >= 0.99 * len(before)

    cut = corpus_pipeline.lines(spark, known, SF)
    got = {r.doc_id: r for r in cut.collect()}
    plain = {d: (n, dropped, sha) for d, n, dropped, sha in test_linededup.plain([(r.doc_id, r.text) for r in kept])}
    shas = {r.doc_id: r.s for r in cut.select("doc_id", F.sha2("text", 256).alias("s")).collect()}
    assert cut.columns == docs.columns and any(v[1] for v in plain.values())
    for r in kept:
        if r.doc_id in got:
            assert shas[r.doc_id] == plain[r.doc_id][2]
            if plain[r.doc_id][1]:
                assert got[r.doc_id].n_chars == len(got[r.doc_id].text)
        else:
            assert plain[r.doc_id][1]

    one = corpus_pipeline.near_duplicates(spark, cut, SF)
    want, _ = test_simhash_wide.classes([(d, r.text) for d, r in got.items()])
    left, first = {r.doc_id for r in one.collect()}, set(want.values())
    assert first <= left and len(left - first) <= 2 and len(left) < len(got)

    clean = corpus_pipeline.decontaminate(spark, one, SF)
    hits = {r.doc_id for r in decontam.matches(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert hits and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - hits

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert test_packing.check(corpus_pipeline.pack(spark, clean, SF).collect(), rows)[0] == 0


def test_odd_rows_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 !!", "en", "s", 6), (None, "the and of that with this from", None, "s", 1)], docs.schema)
    mixed = docs.unionByName(odd).unionByName(docs.limit(5))
    for start in (mixed, mixed.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        assert now.count() >= 0
