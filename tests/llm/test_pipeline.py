import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_models import labelled


def test_stages_take_effect_one_after_the_other(spark, words, tmp_path):
    rows, labels = labelled(words[:400], 300)
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t, _ in rows]
    docs += [(1000 + i, docs[i][1], "en", "s1", docs[i][4]) for i in range(7, 27)]
    docs += [(2000, "token = abcdef0123456789 " + docs[1][1], "en", None, 0), (2001, None, None, None, None), (2002, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {i for i, t in labels if t}
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    first = set(ids(kept["toxicity"]))
    assert len(first & toxic) <= 2 and len(first) >= len(docs) - len(toxic) - 8
    second = ids(kept["simhash_near_duplicates"])
    assert len(second) == len(set(second)) and not any(1000 <= i < 2000 and i - 1000 in first for i in second)
    assert sorted(ids(kept["secret_scan"])) == sorted(second)
    assert kept["secret_scan"].where(F.col("text").contains("abcdef0123456789")).count() == 0
    words_of = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert abs(words_of(kept["source_mixing"]) / words_of(kept["secret_scan"]) - 1.5) < 0.03
    assert set(ids(kept["packing"])) == set(ids(kept["source_mixing"]))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["packing"].count()


def test_columns_of_any_name_ids_beside_nulls_and_no_rows(spark, words, tmp_path):
    rows, labels = labelled(words[:300], 120)
    docs = [(i, t, "en", f"s{i % 3}", len(t), 111.0, True, "keep", "dot") for i, t, _ in rows]
    docs += [(9007199254740993, "alone " + rows[1][1][::-1], "en", "s1", 3, 111.0, True, "keep", "dot"), (None, "without an id " + rows[2][1][::-1], "en", "s2", 3, 111.0, True, "keep", "dot")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean, predicted string, `a.b` string"
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, some in (("all", docs), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        for stage_name, stage in corpus_pipeline.STAGES:
            stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{stage_name}")
            at = spark.read.parquet(f"{tmp_path}/{name}-{stage_name}")
            if stage_name != "packing":
                assert at.columns == spark.read.parquet(f"{tmp_path}/{name}").columns
                assert at.where("score <> 111.0 or predicted <> 'keep' or not held_out or `a.b` <> 'dot'").count() == 0
                if some:
                    assert {9007199254740993, None} <= {r["doc_id"] for r in at.select("doc_id").collect()}
        assert (at.count() > 0) == bool(some)
