import hashlib


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from lexiloom.llm import decontaminate, pii, quality

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == 4 or out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    kept = list(seen.values())
    assert 200 > len(kept[0]) >= len(kept[1]) >= len(kept[2]) == len(kept[3]) == len(kept[4]) > 80
    toxic = {"trash", "pathetic", "idiot", "disgusting", "worthless"}
    assert not any(len(toxic & set(r.text.lower().split())) > 2 for r in kept[0].values())
    assert not any(pii.base_spans(r.text) for r in kept[3].values())
    for doc_id, r in kept[4].items():
        assert r.decoded_sha256 == hashlib.sha256(kept[3][doc_id].text.encode()).hexdigest()
    assert quality.KEEP and decontaminate.COVERAGE


def test_edges(spark, tmp_path):
    """Nulls, empty and repeated rows and extra columns pass all stages; so does an empty table."""
    import corpus_pipeline

    long = " ".join(f"word{k}" for k in range(50_000))
    rows = [(1, "one two three four five six", "en", "a", 27, 0.5), (1, "one two three four five six", "en", "a", 27, 0.5), (None, "no key", None, None, None, 0.5), (2, None, "en", "b", 0, 0.5), (3, "", "en", "b", 0, 0.5), (4, long, "en", "c", len(long), 0.5), (5, "one two three four five seven", "en", "a", 29, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, p_highest double")
    for name, some in (("full", docs), ("empty", docs.limit(0))):
        folder = tmp_path / name
        for table, frame in (("documents", some), ("labels", spark.createDataFrame([(1, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, None), (2, " ")], "item_id long, text string"))):
            frame.write.parquet(f"{folder}/{table}.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert len(out) == len({r.doc_id for r in out}) <= len({r[0] for r in rows})
        assert name == "full" or not out
