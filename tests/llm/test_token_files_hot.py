"""Token files: a hot id, rows without an id, windows of long documents, samples bounded by rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import token_files
from lurewatch.llm.sampling import bounded_sample
from lurewatch.llm.scratch import folder

tokenizers_dir = pytest.importorskip("public_tokenizers")


def test_hot_id_and_rows_without_one_are_dealt_over_shards(spark, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(token_files, "SHARD_DOCS", 10)
    path = tokenizers_dir.path("byte_bpe_50k.json")
    rows = [(7, f"hot {i}") for i in range(100)] + [(i, f"text {i}") for i in range(-30, 60)] + [(None, f"no id {i}") for i in range(60)] + [(0, None), (None, "")]
    random.Random(1).shuffle(rows)
    root = f"{folder(spark)}/tokens-hot-{random.random()}"
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("mine")), root, path, tokenizers_dir.PATTERN)
    got = token_files.read(manifest, root).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [key((r.doc_id,)) for r in got] == sorted(map(key, rows))
    assert sorted((key((r.doc_id,)), bytes(r.ids)) for r in got) == sorted((key(r), np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in rows)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    shards = manifest.withColumn("range", F.shiftright("shard", 32)).groupBy("range").agg(F.sum("n_docs").alias("n")).collect()
    assert len(shards) > 15 and max(r.n for r in shards) <= 40  # neither is one range's work


def test_windows_reach_the_end():
    ids = np.arange(100_000, dtype="<u4").tobytes()
    seen = np.frombuffer(token_files.windows(ids), "<u4")
    assert len(seen) * 4 == token_files.SAMPLE_BYTES and seen[0] == 0 and seen[-1] == 99_999 and len(np.flatnonzero(np.diff(seen) != 1)) == token_files.WINDOWS - 1
    assert token_files.windows(ids[:400]) == ids[:400]


def test_sample_is_bounded_for_one_id_and_equal_rows(spark):
    df = spark.range(50_000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    assert 1500 < bounded_sample(df, ["doc_id"], 2000).count() <= 2000
    assert bounded_sample(df.limit(10), ["doc_id"], 2000).count() == 10
