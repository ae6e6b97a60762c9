"""What the pipeline's tasks leave in the Python workers, which Spark uses again."""

import re
from pathlib import Path

import pytest

P = pytest.importorskip("public_tokenizers")


def held(spark):
    """MB of its own that the largest of the workers has."""

    def look(batches):
        import os

        import pyarrow as pa

        for _ in batches:
            pass
        daemon, most = os.getppid(), 0.0
        for pid in Path(f"/proc/{daemon}/task/{daemon}/children").read_text().split():
            try:
                found = re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())
            except OSError:  # it has ended
                continue
            most = max(most, sum(map(int, found)) / 1024)
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["mb"])

    return spark.range(1).coalesce(1).mapInArrow(look, "mb double").first()["mb"]


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="Linux only")
def test_tasks_give_back_what_they_freed(spark):
    from pyspark.sql import functions as F

    from framelake.llm.minhash import _sketches
    from framelake.llm.packing import pack_documents

    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda k: F.hex(F.xxhash64("id", k))), " ")
    docs = spark.range(1500).coalesce(1).select(F.col("id").alias("doc_id"), words.alias("text"))
    empty = docs.limit(1).withColumn("text", F.lit("a b c"))
    pack = lambda df: pack_documents(df, P.path("byte_bpe_50k.json"))
    for make in (lambda df: _sketches(df.select("doc_id", "text"), 5, 32), pack):
        make(empty).count()  # libraries and tables are loaded
        before = held(spark)
        make(docs).coalesce(1).write.format("noop").mode("overwrite").save()
        after = held(spark)
        assert after - before < 60
