import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, any string, key string, node int"


def row(i, text, source="web"):
    return (i, text, "en", source, len(text or ""), f"x{i}", "k", 1)


def test_every_stage_takes_odd_rows_and_empty_tables(spark, sf_dir):
    long = "word " * 30_000 + "end"
    rows = [row(None, "a b c d e f g"), row(None, None), row(1, None), row(2, ""), row(3, "same text of six words here"), row(4, "same  text of six words here", None), row(4, "same  text of six words here", None), row(5, long), row(6, long + " more")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        ids = [r.doc_id for r in got.collect()]
        if name != "bpe":
            assert got.columns == docs.columns
        if name == "exact_dedup":  # null and empty texts are one group
            assert sorted(map(str, ids)) == ["1", "3", "5", "6", "None"]
        if name == "near_dedup":  # texts without words all stay; the long ones have 2 and 3 different shingles
            assert sorted(map(str, ids)) == ["1", "2", "3", "5", "6", "None", "None"]
        if name == "bpe":
            assert len(ids) == len(rows)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
