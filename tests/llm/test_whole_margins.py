"""op9 rejects texts whose language is a tie."""

from treeloom.llm.queries import op9_language_id


def test_ties_are_not_accepted(spark, tmp_path):
    said = {"en": "the thing and the other one were there ", "fr": "les choses et la petite histoire que nous "}
    rows = [(i, said["en" if i % 2 else "fr"] * 9, "en" if i % 2 else "fr") for i in range(60)]
    rows += [(1000 + i, "z", "en") for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_language_id(spark, str(tmp_path)).collect()
    ties = [x for x in got if x.score == 0]
    assert ties
    assert not any(x.accepted for x in ties)
    assert all(x.accepted == (x.score >= 0.01) for x in got)
    assert all(x.accepted and x.lang_pred == ("en" if x.doc_id % 2 else "fr") for x in got if x.doc_id < 60)
