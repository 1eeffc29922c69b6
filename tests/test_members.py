import time

from pyspark.sql import functions as F
from test_lambdas import page_of

from pageloom.operators import sections as S
from pageloom.operators.shred import shred
from pageloom.sources import sinks


def test_members_of_large_pages_grow_in_proportion(spark):
    """As tests/test_lambdas.py asks of the documents that are texts: a member for every heading."""
    def seconds(heads):
        page = shred(page_of(spark, heads, 3), parts_of=S.SECTION_PARTS, text_nodes=True, decode_twice=True)
        page = page.withColumn("website", F.lit("w")).withColumn("unique_page_name", F.lit("n"))
        start = time.time()
        row = sinks.page_documents(page, kinds=("members",)).select(F.size("members").alias("n"), F.length(sinks.members_json(F.col("members"))).alias("length")).first()
        assert row["n"] >= heads and row["length"] > heads * 10
        return time.time() - start

    seconds(10)
    few, many = seconds(300), seconds(3000)
    assert many < 20 * max(few, 0.3)
