"""A language whose labelled texts are all long is learned, too."""

from pyspark.sql import functions as F

from tracewell.llm import language


def test_only_long_texts(spark):
    rows = [(i, "en", f"the cat and the other cat sat on that mat number {i}") for i in range(20)]
    rows += [(100 + i, "xx", "zyr qolu vexin tarpu molzi " * 900) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert all(len(t) > language.LONGEST for _, lang, t in rows if lang == "xx")
    model = language.train(frame, F.lit(True))
    assert model.languages == ["en", "xx"]
    assert model.predict(["vexin tarpu zyr", "the cat sat"])[0] == ["xx", "en"]
    assert {r.lang for r in language.sampled(frame.filter("lang = 'en'"), F.lit(True)).collect()} == {"en"}
