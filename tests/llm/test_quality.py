"""Line rules with and without the gates of the whole text, on nulls, blanks, copies and an empty table."""

from pyspark.sql import functions as F

from lectern.llm import quality

LINES = ["A plain line that ends well.", "Home | Menu | Login | About", "We use COOKIES here, dear reader of ours.", "x{y}", "buy!! now!! this!! very!! good", "go go go go"]


def test_gates_change_nothing(spark):
    rows = [(i, "\n".join(LINES[: i + 1])) for i in range(len(LINES))] + [(6, None), (7, ""), (8, " \n\t"), (9, LINES[0]), (9, LINES[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = quality.measures(d).withColumn("plain", quality.clean_lines(F.coalesce("text", F.lit("")))).collect()
    assert len(got) == len(rows) and all(r.clean_text == r.plain for r in got)
    assert {r.clean_text for r in got if 0 <= r.doc_id < 6} == {LINES[0]}
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in got if r.doc_id in (6, 7, 8))
    assert quality.measures(d.where("false")).count() == 0
