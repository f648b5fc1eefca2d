"""No label is left out of a sample."""

from terrafolio.llm import langid
from terrafolio.llm.common import labelled_sample


def test_every_label_is_sampled(spark):
    rows = [(100 * k + i, f"l{k}", f"word{k}" * 3) for k in range(70) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert {r["lang"]: r["count"] for r in labelled_sample(frame, "doc_id", "lang", 2).groupBy("lang").count().collect()} == {f"l{k}": 2 for k in range(70)}
    assert len(langid.fit(frame).languages) == 70
