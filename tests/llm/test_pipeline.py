"""The pipeline against a composition of the plain versions."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lurewatch.llm import bpe, mixing, quality_rules
from tests.llm import plain

tokenizers_dir = pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_run(spark, docs):
    """Rows of run(), from plain Python; verdicts of the rules and draws of the mix come from their own tests' code."""
    voted = quality_rules.with_measures(docs).select("doc_id", *[v.alias(k) for k, v in quality_rules.votes().items()]).collect()
    posterior = plain.estimate(Counter(tuple(v)[1:] for v in voted), len(quality_rules.votes()), quality_rules.STEPS, quality_rules.SMOOTH)
    good = {v.doc_id: posterior[tuple(v)[1:]] for v in voted}
    rows = []
    for r in docs.collect():
        n, _, _, _, repeated = plain.measures(r.text)
        if n >= 50 and 100 * repeated <= 50 * n and good[r.doc_id] >= 0.5:
            rows.append((r.doc_id, r.text, r.source))
    cut = plain.dedup_lines([(d, t) for d, t, _ in rows])
    rows = [(d, t, s) for (d, t, dropped), (_, _, s) in zip(cut, rows) if not dropped or plain.words(t)]
    classes = plain.near_classes([(d, t) for d, t, _ in rows])
    rows = [(d, t, s) for d, t, s in rows if classes[d] == d]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(plain.words(t))
    return rows, plain.targets(sizes), sizes


def test_pipeline_matches_plain(spark, tmp_path):
    import tiktoken
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    rows, targets, sizes = plain_run(spark, docs)
    path = tokenizers_dir.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=tokenizers_dir.PATTERN, mergeable_ranks=bpe.vocabulary(path), special_tokens={})
    ids = {d: library.encode_ordinary(t) for d, t, _ in rows}
    words = {d: len(plain.words(t)) for d, t, _ in rows}
    assert {r.doc_id for r in got} <= set(ids) and all(r.round_trip for r in got)
    for r in got:
        assert r.n_tokens == len(ids[r.doc_id]) and bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids[r.doc_id])
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += words[r.doc_id]
    longest = max(words.values())
    assert all(abs(taken[s] - targets[s]) <= longest for s in sizes)
    # one copy more for whom the draw says so
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Counter(r.doc_id for r in got) == Counter({r.doc_id: r.copies for r in mixing.mix(frame).collect() if r.copies})


def test_stages_on_odd_tables(spark):
    good = " ".join(f"the plain word of text{i}" for i in range(30)) + "."
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(plain.ODD_TEXTS)] + [(50, good, None, None, None), (51, good + " more", "en", "b", 3), (None, good.replace("plain", "other"), "en", "a", 2), (50, good, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("kept", F.lit("mine")).withColumn("n_dropped", F.lit(7))
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        none = stage(spark, docs.limit(0), "")
        assert none.count() == 0
        if at + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and none.columns == docs.columns
            assert {r.kept for r in out.collect()} <= {"mine"} and {r.n_dropped for r in out.collect()} <= {7}


def test_near_stage_leaves_one_of_each_group(spark):
    good = " ".join(f"word{i}" for i in range(100))
    rows = [(1, good, "en", "a", 1), (2, good + " x", "en", "a", 1), (2, good + " x", "en", "a", 1), (3, "something else entirely", "en", "a", 1), (3, "something else entirely", "en", "a", 1), (None, good, "en", "a", 1)]
    out = corpus_pipeline.near(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 1), (False, 3), (True, 0)]


def test_texts_that_share_an_id_are_documents_each(spark):
    """A repeated id with differing texts: copies and repeated lines of one text cost the others nothing."""
    words = lambda k, n=100: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, words("a"), "en", "a", 1), (2, words("a") + " x", "en", "a", 1), (2, words("b"), "en", "a", 1), (2, words("c"), "en", "a", 1), (2, words("c"), "en", "b", 1), (3, words("b") + " y", "en", "a", 1)]
    for n in (1, 4):
        out = corpus_pipeline.near(spark, spark.createDataFrame(rows, COLUMNS).repartition(n), "").collect()
        assert sorted((r.doc_id, r.text, r.source) for r in out) == [(1, words("a"), "a"), (2, words("b"), "a"), (2, words("c"), "a")]
    line = "one line of seven words stands twice"
    rows = [(1, f"{line}\n{words('d', 9)}", "en", "a", 1), (2, f"{line}\n{words('e', 9)}", "en", "a", 1), (2, f"{words('f', 9)}\n{words('g', 9)}", "en", "a", 1), (None, line, "en", "a", 1)]
    out = corpus_pipeline.lines(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, line), (1, rows[0][1]), (2, words("e", 9)), (2, rows[2][1])]
