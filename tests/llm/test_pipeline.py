import corpus_pipeline as cp
from graphloom.llm import bpe, decontam


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    item = " ".join(f"b{k}" for k in range(12))
    same = " ".join(f"n{k}" for k in range(80))
    rows = [
        (1, "the house and the garden are in the town with the people and their work", "en", "s", 1),
        (2, "1234 5678", "en", "s", 1),
        (3, same + " one", "en", "s", 1),
        (4, same + " two", "en", "s", 1),
        (5, "the words " + item + " are here", "en", "s", 1),
        (6, "write to joe@example.com about the garden", "en", "s", 1),
        (7, None, "fr", "s", 0),
        (8, "la maison et le jardin de la ville avec les gens", "fr", "s", 1),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == cp.COLUMNS
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    assert kept == [[1, 3, 4, 5, 6, 8], [1, 3, 5, 6, 8], [1, 3, 6, 8], [1, 3, 6, 8]]
    out = {r["doc_id"]: bpe.decode_ids(bytes(r["ids"]), bpe.default_path()).decode() for r in cp.run(spark, d).collect()}
    assert sorted(out) == [1, 3, 6, 8] and out[6] == "write to [EMAIL] about the garden"
    assert decontam.word_list(out[1]) == decontam.word_list(rows[0][1])


def test_near_duplicates_keep_one_row_of_a_repeated_id(spark):
    same = " ".join(f"n{k}" for k in range(80))
    rows = [(3, same + " one", "en", "s", 1), (3, same + " one", "en", "s", 1), (4, same + " two", "en", "s", 1), (9, "all alone", "en", "s", 1), (None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == [3, 9, None, None]
