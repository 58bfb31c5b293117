"""op12's order does not follow from the input's size."""

from clauseframe.llm import languages


def test_many_languages_do_not_lower_the_order(spark):
    n = 6500  # (gram, language) rows times languages: over 80 million
    rows = [(i, "abab", f"l{i:04d}") for i in range(n)]
    model = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.order == languages.ORDER
    assert len(model.languages) > n // 2 and len(model.hashes) == languages.ORDER
