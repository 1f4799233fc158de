"""How often texts are dealt out."""

from quernel.llm import substring_dedup
from quernel.llm.common import table


def test_texts_are_dealt_once(spark):
    """Ends of repeats and the removal of words read the same exchange, whatever the length of the lists."""
    out = substring_dedup.remove_repeats(table(spark, "/root/testdata/sf0.001", "documents"))
    assert sum(r["n_removed"] for r in out.collect()) > 0
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") == 1
