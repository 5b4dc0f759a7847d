"""What workers keep after a task, and the size of batches."""

import os
import subprocess
import sys

KEPT = """
import re
import pyarrow as pa
from strataloom.batches import slices

def anonymous():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

before = anonymous()
for b in slices([pa.RecordBatch.from_arrays([pa.array(["a text"])], names=["text"])], 0):
    blocks = [b"x" * (100_000 + i) for i in range(600)]
    last = blocks.pop()  # what lies below it stays with the allocator
    del blocks
print(anonymous() - before)
"""


def test_worker_gives_memory_back_after_its_batches():
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", KEPT], env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True, check=True)
    assert float(run.stdout) < 25


def test_smaller_batches_win_and_a_callers_value_stays(spark):
    import corpus_pipeline
    from strataloom.batches import BATCH_BYTES, small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    session = spark.newSession()
    session.conf.set(key, "67108864b")
    small_batches(session)
    assert session.conf.get(key) == str(BATCH_BYTES)
    small_batches(session, corpus_pipeline.BATCH_BYTES)
    small_batches(session)
    assert session.conf.get(key) == str(corpus_pipeline.BATCH_BYTES) < str(BATCH_BYTES)
    session.conf.set(key, "7777777")
    small_batches(session, corpus_pipeline.BATCH_BYTES)
    assert session.conf.get(key) == "7777777"


def test_small_tables_are_few_files(spark, tmp_path, monkeypatch):
    """As many files as rows ask for, not one a shuffle partition."""
    from glob import glob

    from strataloom.llm.simhash import drop_near_duplicates

    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "50")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr("strataloom.storage.shared_folder", lambda _: f"file://{tmp_path}")
    texts = [" ".join(f"word{(i // 2 + 7) * j * j % 9973}" for j in range(200)) + " tail" * (i % 2) for i in range(300)]
    docs = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.text for r in drop_near_duplicates(docs).collect()}
    assert kept and kept <= set(texts)
    files = {name: len(glob(f"{tmp_path}/strataloom-{name}-*/part-*")) for name in ("prints", "nodes", "blocks", "linked")}
    assert files["prints"] == 3 and all(1 <= n <= 4 for n in files.values()), files
