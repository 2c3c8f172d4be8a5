"""What tasks of the toxicity operator hold: a shard once, and few whole texts at a time."""

import io
import re
from contextlib import redirect_stdout

from gridloom.llm import toxicity


def plan(df) -> str:
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_a_task_sorts_its_shard_once_and_texts_come_few_at_a_time(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    dealt = plan(toxicity.dealt_rows(docs, labels, 8, 2))
    scored = plan(toxicity.classify(docs, toxicity.Classifier(8, 4, (1, 2), 3, 1)))
    assert len(re.findall(r"\bSort \[", dealt)) == 1 and "BatchEvalPython" in dealt and "BatchEvalPython" in scored
    assert not any("ArrowEvalPython" in p for p in (dealt, scored))  # a batch of Arrow has 10,000 texts
