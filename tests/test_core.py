from corpuskit.operators.ranks import first_per_key
from corpuskit.plans.core import dedup_split_counts, exact_dedup


def test_first_per_key(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, "b")], "seq long, k string")
    assert sorted((r.seq, r.k) for r in first_per_key(df, "k", "seq").collect()) == [(1, "a"), (4, "b")]
    assert first_per_key(df.limit(0), "k", "seq").count() == 0


def test_dedup_split_counts_takes_one_record_a_text(spark, tmp_path):
    rows = [("3", "e\u0301 x", "twitter", "train"), ("1", "\u00e9 x", " Twitter", "test"), ("1", "\u00e9 x", " Twitter", "test"), ("2", "other", "twitter", "train"), ("4", None, "twitter", "train")]
    spark.createDataFrame(rows, "sentence_id string, text string, platform string, split string").write.parquet(f"{tmp_path}/annotated_sentences.parquet")
    assert sorted(tuple(r) for r in dedup_split_counts(spark, str(tmp_path)).collect()) == [("twitter", "test", 1), ("twitter", "train", 1)]


def test_exact_dedup_takes_composed_and_decomposed_letters_as_one_text(spark, tmp_path):
    rows = [(3, "c", "\u00e9 x"), (2, "b", "e\u0301 x"), (1, "a", None), (4, "d", "e x"), (5, "e", "\u0958"), (6, "f", "\u0915\u093c")]
    spark.createDataFrame(rows, "seq long, sentence_id string, text string").write.parquet(f"{tmp_path}/raw_sentences.parquet")
    assert sorted(tuple(r) for r in exact_dedup(spark, str(tmp_path)).collect()) == [(2, "b"), (4, "d"), (5, "e")]
