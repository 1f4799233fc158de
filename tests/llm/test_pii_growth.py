"""Added spans don't depend on how many like candidates the table has."""

from pyspark.sql import functions as F

from quernel.llm import pii

FORMS = {"phone": "call (555) 555-0142 today", "ip": "from 192[.]0[.]2[.]44 today", "email": "write to ann [at] mail [dot] example today"}


def test_many_like_candidates(spark):
    for n in (1, 4000):
        docs = spark.range(n).select(F.explode(F.array(*[F.concat(F.lit(t + " "), F.col("id").cast("string")) for t in FORMS.values()])).alias("text"))
        row = pii.find(docs).agg(*[F.sum(F.size(f"spans.{k}")).alias(k) for k in FORMS]).first()
        assert {k: row[k] for k in FORMS} == dict.fromkeys(FORMS, n)
