"""Byte pairs: pieces of any length, remembered pieces that are forgotten again, odd column names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import bpe

tokenizers_dir = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    import tiktoken
    path = tokenizers_dir.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=tokenizers_dir.PATTERN, mergeable_ranks=bpe.vocabulary(path), special_tokens={})


def ids_of(row):
    return np.frombuffer(bytes(row.ids), "<u4").tolist()


def test_long_pieces_equal_the_library(spark, library):
    path, whole = library
    rnd = random.Random(1)
    run = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    texts = [run("abcdefghijklmnopqrstuvwxyzABCDEFGH", 10**6), run("ACGT", 10**5), "1" * 10**5, "é" * 700]
    texts += [run("abcdeé", n) for n in (bpe.LONG // 2, bpe.LONG - 2, bpe.LONG - 1, bpe.LONG, bpe.LONG + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.decode(bpe.encode(df, path, tokenizers_dir.PATTERN), path).collect()
    for r in rows:
        assert ids_of(r) == whole.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode()


def test_linked_list_merges_as_the_fold(library):
    pairs, ranks = bpe.merges(library[0]), bpe.vocabulary(library[0])
    rnd = random.Random(2)
    for n in (1, 2, 3, 10, 40):
        for _ in range(50):
            ids = [ranks[bytes([rnd.choice(b"etaoin sh")])] for _ in range(n)]
            assert bpe.merge_long(list(ids), pairs) == bpe._fold_plain(ids, pairs)


def test_certain_merges_change_nothing(library):
    """Texts in other scripts and of few letters, where pairs compete."""
    pairs, ranks, certain = bpe.merges(library[0]), bpe.vocabulary(library[0]), bpe._certain(library[0])
    rnd = random.Random(4)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 14))).encode() for letters in ("the inger", "éèaoui ", "日本語で", "aab", "0123") for _ in range(300)]
    ids = [[ranks[bytes([b])] for b in w] for w in words]
    merged, piece = bpe.merge_certain(np.array([x for w in ids for x in w]), np.repeat(np.arange(len(ids)), list(map(len, ids))), certain)
    assert len(merged) < sum(map(len, ids))
    for i, w in enumerate(ids):
        assert bpe._fold_plain(merged[piece == i].tolist(), pairs) == bpe._fold_plain(w, pairs)


def test_places_hold_every_pair(library):
    shift, entries = bpe._places(library[0])
    pairs = bpe.merges(library[0])
    assert all(entries[shift[a] + b] ^ (a << bpe.BITS) == rank for (a, b), rank in pairs.items())
    assert len([e for e in entries if e >> bpe.BITS != bpe.MASK]) == len(pairs)


def test_forgotten_pieces_and_odd_names(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 40)
    monkeypatch.setattr(bpe, "GROUP_PIECES", 30)
    monkeypatch.setattr(bpe, "ROW_PIECES", 3)
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(25))) for _ in range(200)] + ["x" * 600, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for name in ("_", "_kept", "words", "a.b", "a`b", "c0", "index"):
        df = df.withColumn(name, F.lit(name)) if "." not in name and "`" not in name else df.select("*", F.lit(name).alias(name))
    rows = bpe.encode(df, *[library[0], tokenizers_dir.PATTERN], decoded=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert ids_of(r) == library[1].encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode()
        assert all(r[c] == c for c in ("_", "_kept", "words", "a.b", "a`b", "c0", "index"))


def test_rounds_over_all_pieces_merge_as_one_by_one(library):
    """Every piece of many, in arrays, merges as it does alone; entries of the map that lie outside it are no pairs."""
    pairs, ranks = bpe.merges(library[0]), bpe.vocabulary(library[0])
    shift, entries = (np.array(x, np.int64) for x in bpe._places(library[0]))
    pick = random.Random(5)
    words = ["".join(pick.choice("etaoin shrdlué中0.") for _ in range(pick.randrange(1, 40))).encode() for _ in range(400)]
    ids = [[ranks[bytes([b])] for b in w] for w in words]
    flat, piece = np.array([x for w in ids for x in w], np.int32), np.repeat(np.arange(len(ids)), list(map(len, ids)))
    merged, of = bpe.merge_ranked(flat, piece, shift, entries)
    assert [merged[of == i].tolist() for i in range(len(ids))] == [bpe._fold_plain(w, pairs) for w in ids]


def test_rank_map_is_not_in_the_plan(library, spark):
    """The map of pairs goes to the tasks, not into the plan that the driver holds and prints."""
    df = bpe.encode(spark.createDataFrame([(1, "one text")], "doc_id long, text string"), library[0], "[^ ]+| +")
    assert len(df._jdf.queryExecution().toString()) < 20_000
