import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    words = [f"w{k}" for k in range(300)]
    item = " ".join(f"item{k}" for k in range(30))
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, " ".join(words[:100]), "x"), (2, " ".join([*words[:99], "other"]), "x"), (3, f"before {item} after", "x"), (4, f"{passage}\nmine", "x"), (5, f"{passage}\nyours alone", "x"),
            (6, None, "x"), (None, "no id here", "x"), (7, "idiotic nonsense", "x"), (7, "idiotic nonsense", "x"), (8, passage, "x")]
    rows += [(k, f"{'idiotic' if k % 6 == 5 else 'kindly'} text{k}", "x") for k in range(100, 160)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1.0) for r in rows], "doc_id long, text string, source string, n_chars long, score double")
    for name, df in {"documents": docs, "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
                     "labels": spark.createDataFrame([(k, 1, int(k % 6 == 5)) for k in range(100, 160)], "doc_id long, quality int, toxic int")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "sentencepiece":
            assert at.columns == docs.columns and at.dtypes == docs.dtypes
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r["doc_id"] for r in at.select("doc_id").collect()})
    assert 7 not in ids[0] and {1, 2, 3, 4, 5, 6, None, 8, 100} <= ids[0] and 101 not in ids[0]
    assert 8 not in ids[1] and {4, 5} <= ids[1]
    assert 2 not in ids[2] and {1, 5, 6} <= ids[2]
    assert 3 not in ids[3] and {1, 4, 5, 6, None} <= ids[3]
    five = spark.read.parquet(f"{tmp_path}/decontamination").where("doc_id = 5").first()
    assert (five["text"], five["n_chars"]) == ("yours alone", 11)
    assert ids[4] == ids[3]
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=str)
    assert got == sorted(at.collect(), key=str)


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
