"""How much of a table of blocks a task holds."""

from pyspark.sql import functions as F
import pyarrow.parquet as pq

from quillgraph.llm import collocations


def test_a_file_has_few_blocks(spark, monkeypatch):
    """a writer, and a reader's batch, hold a file's blocks at once, so a file has a few of them, not all of a task's."""
    docs = spark.range(400).coalesce(1).select(F.lit("en").alias("lang"), F.concat_ws(" ", F.lit("one two three"), F.col("id") % 7, F.lit("end.")).alias("text"))
    sizes, write = {}, collocations.materialize

    def seen(df, name, *rest):
        out = write(df, name, *rest)
        if name in ("colloc_blocks", "colloc_pairs"):
            sizes.setdefault(name, []).extend(pq.read_metadata(f.removeprefix("file://")).num_rows for f in out.inputFiles())
        return out

    monkeypatch.setattr(collocations, "materialize", seen)
    found = {r["phrase"]: r["a"] for r in collocations.collocations(docs, block_chars=100).collect()}
    assert found["one two three"] == 400
    assert sum(sizes["colloc_blocks"]) > 50 and sum(sizes["colloc_pairs"]) > 100
    assert max(map(max, sizes.values())) <= 4
