"""Operators against plain versions on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import bagminhash as bag
from lurewatch.llm import bpe, gam, licenses, line_dedup, mixing, near_dup, pii, quality_rules, token_files, topk
from lurewatch.llm.scratch import Scratch, folder
from tests.llm import plain

tokenizers_dir = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def table(spark, texts, extra="", start=0):
    rows = [(start + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in extra.split():
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    # the last row repeats an earlier one, id and all; one row has no id
    df = table(spark, plain.ODD_TEXTS)
    return df.unionByName(df.where("doc_id = 5")).unionByName(spark.createDataFrame([(None, "a text without an id that has some words")], df.schema))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# --- top k ------------------------------------------------------------------

def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CHUNK", 16)
    rnd = random.Random(4)
    rows = [(i * 10, [float(rnd.randint(-3, 3)) / 4 for _ in range(6)], "mine") for i in range(120)]
    rows += [(1300, None, "x"), (1350, [1.0, None], "x"), (1400, [float("nan")] * 6, "x"), (1450, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x"), (1500, [], "x"), (1550, [1.0], "x")]
    rows += [(2000 + i, rows[0][1], "copy") for i in range(70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 50 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(good[q], v)), c) for c, v in good.items() if c != q)[:5]
            want |= {(q, r, c, -s) for r, (s, c) in enumerate(ranked, 1)}
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert len(got) == len(want) and set(got) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_scores_of_large_components():
    a = np.array([[2**40, -3]], dtype=np.int64)
    assert topk.accumulate(a, np.array([[2**20, 5], [0, 7]], dtype=np.int64)).tolist() == [[2**60 - 15, -21]]


# --- mixing -----------------------------------------------------------------

def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)) if i % 17 else None, rnd.choice(["b", "a", "a", "a", "a", "z", None, "B"]), "mine") for i in range(300)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(plain.words(t))
    want = plain.targets(sizes)
    source = {r[0]: r[2] for r in rows}
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken == r.copies * r.size <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_takes_good_documents_first(spark):
    df = spark.createDataFrame([(i, "a b c d e f", "s") for i in range(2000)] + [(9000 + i, "a b c", "t") for i in range(100)], "doc_id long, text string, source string")
    got = mixing.mix(df, quality=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1), share=0.5).where("size = 6 and copies > 0").groupBy((F.col("doc_id") % 2).alias("k")).count().collect()
    n = {r["k"]: r["count"] for r in got}
    assert n[0] > 3 * n[1] > 0


# --- quality rules ----------------------------------------------------------

def test_measures(odd):
    rows = quality_rules.with_measures(odd).select("text", *quality_rules.BASE).collect()
    for r in rows:
        assert tuple(r)[1:] == plain.measures(r.text), (r.text or "")[:40]


def test_estimation_matches_plain(spark, odd):
    docs = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    voted = quality_rules.with_measures(docs).select(*[v.alias(k) for k, v in quality_rules.votes().items()]).collect()
    want = plain.estimate(Counter(map(tuple, voted)), len(quality_rules.votes()), quality_rules.STEPS, quality_rules.SMOOTH)
    got = Counter(round(r.quality, 6) for r in quality_rules.score(docs.withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x")), ["doc_id"]).collect())
    assert got == Counter(round(want[tuple(v)], 6) for v in voted)


def test_rules_keep_good_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.score(docs, ["doc_id"]).withColumnRenamed("quality", "p").join(labels, "doc_id").select(F.col("quality").alias("y"), "kept", "base_failed").collect()
    assert all(r.kept for r in rows if r.y == 1 and not r.base_failed)
    assert not any(r.kept for r in rows if r.y == 0)
    assert quality_rules.score(empty(spark), ["doc_id"]).count() == 0


# --- byte pairs -------------------------------------------------------------

def test_bpe_matches_library(spark, odd, monkeypatch):
    import tiktoken
    monkeypatch.setattr(bpe, "GROUP_PIECES", 500)
    path = tokenizers_dir.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=tokenizers_dir.PATTERN, mergeable_ranks=bpe.vocabulary(path), special_tokens={})
    df = odd.withColumn("ids", F.lit("clash")).withColumn("place", F.struct(F.lit(1).alias("x")))
    rows = bpe.decode(bpe.encode(df.withColumn("keep", F.col("text")), path, tokenizers_dir.PATTERN), path).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(r.keep or "")
        assert bytes(r.decoded) == (r.keep or "").encode() and r.place.x == 1
    assert bpe.encode(df.limit(0), path, tokenizers_dir.PATTERN).count() == 0


def test_bpe_merges_alone_and_together(spark):
    """A vocabulary in which a merge brings up a pair of lower rank, on long and short pieces."""
    path = folder(spark).removeprefix("file://") + "/tiny.tiktoken"
    import base64
    import os
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"aab", b"aa", b"aaaa", b"ab", b"cab"]
    with open(path, "w") as out:
        out.writelines(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens))
    pairs, ranks = bpe.merges(path), bpe.vocabulary(path)
    rnd = random.Random(0)
    texts = ["".join(rnd.choice("abc") for _ in range(n)) for n in (1, 2, 3, 7, 30, 129, 300, 301)] + ["a" * 131, "abc", "aab"]
    rows = bpe.encode(table(spark, texts).withColumn("t", F.col("text")), path, tokenizers_dir.PATTERN).collect()
    for r in rows:
        whole = ranks.get(r.t.encode())
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ([whole] if whole is not None else bpe._fold_plain([ranks[bytes([b])] for b in r.t.encode()], pairs))


# --- near duplicates --------------------------------------------------------

def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(1)
    for low, high in ((1, 2), (0, 9), (0, 200)):
        a = rng.integers(low, high, 300)
        b = np.maximum(0, a + rng.integers(-high // 3 - 1, high // 3 + 2, 300))
        names = bag.mix(np.arange(300, dtype=np.uint64))
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = bag.signatures(doc, np.concatenate([names[a > 0], names[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
        truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - truth) < 5 * (truth * (1 - truth) / 4096) ** 0.5 + 1e-9


def edited(rnd, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark, odd, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 6)
    monkeypatch.setattr(near_dup, "AT_ONCE", 2000)
    rnd = random.Random(5)
    texts = [t for t in plain.ODD_TEXTS if t != plain.ODD_TEXTS[-1]]
    for n in (40, 90, 200):
        base = " ".join(f"v{rnd.randrange(5000)}" for _ in range(n))
        texts += [base, base, base.replace(" ", "  ")] + [edited(rnd, base, rnd.choice((1, 1, 2, n // 25 + 1, n // 15, n // 10))) for _ in range(30)]
    df = table(spark, texts, "bands key")
    want = plain.near_classes([(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: r.class_id for r in near_dup.classes(df).collect()}
    assert set(got) == set(want)
    # a link is missed with a small chance only: classes may split, never join
    assert all(want[got[d]] == want[d] for d in got)
    assert sum(got[d] == want[d] for d in got) >= 0.98 * len(got)
    assert near_dup.classes(empty(spark)).count() == 0
    rows = near_dup.classes(odd).collect()
    assert len(rows) == odd.where("doc_id is not null").count() and sum(r.doc_id == 5 for r in rows) == 2


# --- lines ------------------------------------------------------------------

def test_line_dedup(spark, odd):
    rnd = random.Random(7)
    names = [f"n{i}" for i in range(12)]
    base = [" ".join(rnd.choice(names) for _ in range(n)) for n in (4, 5, 6, 7, 8, 9, 15, 16, 17, 31, 32, 33) for _ in range(3)]
    texts = list(plain.ODD_TEXTS)
    for _ in range(60):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            w = rnd.choice(base).split()
            for _ in range(rnd.choice((0, 1, 1, 1, 2))):
                at = rnd.randrange(len(w))
                w[at:at + 1] = rnd.choice(([], [rnd.choice(names)], [w[at], rnd.choice(names)]))
            lines.append("  ".join(w) if rnd.random() < 0.2 else " ".join(w))
        texts.append("\n".join(lines))
    rows = list(enumerate(texts)) + [(None, "a line of some words without an id\n" * 2), (20, texts[20])]
    df = spark.createDataFrame([(d, t, "mine") for d, t in rows], "doc_id long, text string, drops string")
    got = line_dedup.dedup_lines(df).collect()
    assert Counter((r.doc_id, r.text, r.n_dropped) for r in got) == Counter(plain.dedup_lines(rows))
    assert sum(r.n_dropped for r in got) > 60 and all(r.drops == "mine" for r in got)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# --- quality classifier -----------------------------------------------------

def test_gam_learns_main_effects_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.4)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert (0, 1) in model.pairs


def test_gam_on_held_out_documents(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = gam.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    scored = gam.classify(odd.withColumn("score", F.lit("x")), labels).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    import zlib
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert {r.score for r in gam.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert gam.classify(empty(spark), labels).count() == 0


# --- token files ------------------------------------------------------------

def test_token_files(spark, odd, monkeypatch):
    import zlib
    monkeypatch.setattr(token_files, "SHARD_DOCS", 4)
    monkeypatch.setattr(token_files, "GROUP_PIECES", 300)
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 100)
    path = tokenizers_dir.path("byte_bpe_50k.json")
    library = token_files._tokenizer(path)
    more = odd.unionByName(table(spark, ["a text <|endoftext|> with a special string"] * 3, start=100))
    root = f"{folder(spark)}/tokens-test-{random.random()}"
    manifest = token_files.write(more.withColumn("shard", F.lit("mine")), root, path, tokenizers_dir.PATTERN)
    rows = token_files.read(manifest, root).collect()
    start, want = 0, []
    # rows without an id come first
    for _, d, t in sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in more.collect()):
        d = d if _ else None
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in sorted(rows, key=lambda r: r.start)] == want
    assert manifest.count() > 3 and manifest.agg(F.max("n_docs")).first()[0] <= 4
    dictionary = token_files._get(f"{root}/dictionary")
    one = token_files.Reader(token_files._get(manifest.orderBy("shard").first().path), dictionary)
    assert one.ids(0)[-1] == 0
    with pytest.raises(ValueError):
        token_files.Reader(token_files._get(manifest.first().path), b"another")
    none = token_files.write(empty(spark), root + "-none", path, tokenizers_dir.PATTERN)
    assert none.count() == 0 and token_files.read(none, root + "-none").count() == 0


def test_token_files_match_the_unaltered_library(spark):
    """Added tokens in a text get their own ids, wherever they stand."""
    from tokenizers import Tokenizer
    path = tokenizers_dir.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a text <|endoftext|> with one", "<|endoftext|>", "two!!<|endoftext|><|endoftext|>\n  of them  <|endoftext|> ", "nearly <|endoftext| > one", "none", "", None]
    root = f"{folder(spark)}/tokens-added-{random.random()}"
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_files.read(token_files.write(table(spark, texts), root, path, tokenizers_dir.PATTERN), root).collect()}
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert got[1] == [50256, 0] and got[2].count(50256) == 3


# --- personal data ----------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if name == "ip" else None,
                    "card": 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0,
                    "phone": 10 <= len(digits) <= 15}[name]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rnd = random.Random(1)
    for _ in range(20000):
        text = "".join(rnd.choice("aB1234567890..@@+-  ()_%x\né") for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("9" * 50000) == [] and pii.base_spans("a" * 50000 + "@") == []


def test_disclosing_terms(spark, odd):
    rnd = random.Random(3)
    common = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    say = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    texts = [f"{say(20)} zebulon {say(2)} jane.roe@mail.example.com {say(2)} falconry {say(20)}" for _ in range(6)]
    texts += [say(60) for _ in range(200)] + [say(30) + " falconry " + say(30) for _ in range(2)]
    texts += [f"{say(20)} other{i}@mail.example.com {say(20)}" for i in range(20)]
    rows = {r.doc_id: r for r in pii.sanitise(table(spark, texts, "spans row")).collect()}
    for i in range(6):
        at = texts[i].index("zebulon")
        assert f"term:{at}:{at + 7}" in rows[i].spans.split(",") and "[TERM]" in rows[i].redacted and "zebulon" not in rows[i].redacted
        assert "jane.roe" not in rows[i].redacted and rows[i].n_email == 1 and rows[i].base == f"email:{texts[i].index('jane')}:{texts[i].index('.com') + 4}"
    # documents without the entity stay as they are, and rare values reveal nothing about their neighbours
    assert all(rows[i].spans == "" and rows[i].redacted is None for i in range(6, 208))
    assert all(rows[i].n_term == 0 and rows[i].n_email == 1 for i in range(208, 228))
    found = pii.sanitise(odd).collect()
    assert len(found) == odd.count() and all(r.n_email == 0 for r in found)
    assert pii.sanitise(empty(spark)).count() == 0


def test_terms_of_a_value_in_one_document(spark):
    """A value of one document and one of two: rare terms anywhere in them go, common terms and other documents stay."""
    rnd = random.Random(6)
    common = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    say = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    texts = [f"Zebulon {say(40)} jane.roe@mail.example.com {say(40)} falconry {say(10)}", f"{say(30)} quillmaker {say(30)} +44 20 7946 0991 {say(5)}", f"{say(5)} +44 20 7946 0991 {say(40)} quillmaker"]
    texts += [f"{say(60)} lonely{chr(97 + i)} {say(5)}" for i in range(26)] + [say(60) for _ in range(300)]
    rows = {r.doc_id: r for r in pii.sanitise(table(spark, texts)).collect()}
    for i, names in ((0, ("Zebulon", "falconry")), (1, ("quillmaker",)), (2, ("quillmaker",))):
        want = {f"term:{texts[i].index(x)}:{texts[i].index(x) + len(x)}" for x in names}
        assert {x for x in rows[i].spans.split(",") if x.startswith("term")} == want and rows[i].n_term == len(names)
        assert not any(x in rows[i].redacted for x in names)
    assert all(rows[i].spans == "" and rows[i].redacted is None for i in range(3, len(texts)))


# --- licences ---------------------------------------------------------------

@pytest.fixture(scope="module")
def licence_model(spark):
    return licenses.fit(spark)


def test_licence_scan(spark, odd, licence_model):
    texts = ["Some prose.\nLicensed under CC BY-NC 4.0.\nMore prose.", "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.",
             "The licence plate of the car was red.\nShe went to MIT.", "Licensed under the terms of the Apache License Version 2.0", None, "", "x " * 9000 + "\n" + "Licensed under the Apache License, Version 2.0."]
    rows = licenses.scan(table(spark, texts, "paragraphs keep"), licence_model, licenses._notice_words()).orderBy("doc_id").collect()
    assert [r.licences for r in rows] == ["cc-by-nc", "gpl-3.0,mit", None, "apache-2.0", None, None, "apache-2.0"]
    assert [p.place for p in rows[0].paragraphs] == [1] and rows[0].n_paragraphs == 3 and rows[0].keep == "mine" and rows[5].n_paragraphs == 0
    assert licenses.scan(odd, licence_model).count() == odd.count()
    assert licenses.scan(empty(spark), licence_model).count() == 0


def test_licence_classifier_on_held_out_variants(spark, licence_model):
    held = licenses.examples(spark).where("held")
    z = licenses._softmax_let(licenses._logits(F.col("grams"), licence_model), licence_model["temperature"])
    best = F.get(licenses._json(licence_model["families"], "array<string>"), (F.array_position(z, F.array_max(z)) - 1).cast("int"))
    right = held.select((best == F.col("family")).cast("int").alias("y")).agg(F.avg("y"), F.count("y")).first()
    assert right[1] > 50 and right[0] > 0.9


def test_licence_of_a_common_notice(spark, licence_model):
    """A notice in a third of the lines, and a small table with one notice twice: no word is too common to be looked at."""
    texts = [f"Some prose of day {i}.\nLicensed under the MIT License.\nMore prose of day {i}." for i in range(40)]
    assert {r.licences for r in licenses.scan(table(spark, texts), licence_model).collect()} == {"mit"}
    few = ["Released under the BSD License.", "prose", "Released under the BSD License."]
    assert [r.licences for r in licenses.scan(table(spark, few), licence_model).orderBy("doc_id").collect()] == ["bsd", None, "bsd"]


def test_licence_lines_left_out_are_none(spark, docs, licence_model):
    """The default marks give what scoring every line with any word of the model gives."""
    every = sorted({w for g in licence_model["weights"] for w in g.split(" ")})
    marks = licenses.marking_words(licence_model)
    assert len(marks) < len(every)
    lines = [*licenses.OTHERS, *(t for ts in licenses.NOTICES.values() for t in ts), " ".join(set(every) - set(marks)), "the of and in to a is this that by for"]
    both = docs.select("doc_id", "text").unionByName(table(spark, lines, start=10**6))
    seen = [Counter(map(str, licenses.scan(both, licence_model, m).collect())) for m in (None, every)]
    assert seen[0] == seen[1]


# --- tables and registry ----------------------------------------------------

def test_scratch_tables(spark):
    scratch = Scratch(spark, "test")
    kept = scratch.write(spark.range(5))
    assert kept.count() == 5 and scratch.path.startswith(folder(spark))
    scratch.drop(kept)


def test_registry():
    import __spark_entry__ as entry
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert {"op6_mixing", "op8_topk", "op9_line_dedup"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op6_mixing", "op8_topk", "op9_line_dedup"])
def test_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(found.fetchall())


def test_query_columns(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = q["op7_pii"](spark, SF).collect()
    assert len(rows) == n
    for r in rows:
        shown = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    assert q["op10_licenses"](spark, SF).count() == n and q["op2_token_files"](spark, SF).count() == n
