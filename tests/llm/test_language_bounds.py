"""What the language model takes to the driver is bounded, however many values `lang` has."""

from pyspark.sql import functions as F

from loomlens.llm import language


def test_a_dirty_column_teaches_the_frequent_values(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    monkeypatch.setattr(language, "MOST_ROWS", 90)
    words = {"en": "the of and to in that with", "de": "der und die nicht mit ist ein", "fr": "le de la et les des une"}
    rows = [(i, " ".join((words[lang].split() * 4)[i % 5 : i % 5 + 12]), lang) for i in range(600) for lang in [list(words)[i % 3]]]
    rows += [(1000 + i, f"junk {i} text of no language", f"x{i}") for i in range(400)] + [(2000, "the of and to in", None), (2001, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken, build = [], language.Model

    class Counted(build):
        def __init__(self, x, langs):
            taken.append(len(x))
            super().__init__(x, langs)

    monkeypatch.setattr(language, "Model", Counted)
    model = language.train(docs)
    assert sorted(model.langs) == ["de", "en", "fr"] and taken[0] <= 2 * 90
    got = language.identify(docs.filter("doc_id < 600").withColumn("want", F.col("lang")), model, extra=["want"]).filter("held_out")
    assert got.filter("lang_pred = want").count() >= 0.95 * got.count() > 0
