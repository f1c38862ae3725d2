"""Term spans against a brute-force version over all pairs of entities and terms; directories of many values."""

import math
import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lurewatch.llm import pii

WORD = re.compile(r"[^\W_]+")


def plain_terms(text, spans):
    """(start, end, term) of the words of letters alone, outside the spans."""
    return [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)
            if len(m.group()) > 1 and not any(c.isdigit() or not c.isalpha() for c in m.group()) and not any(s < m.end() and m.start() < e for s, _, e in spans)]


def plain_told(texts):
    """For each text the set of its terms that disclose one of its entities."""
    n = len(texts)
    spans = [pii.base_spans(t) for t in texts]
    entities = [{pii._value(k, t[s:e]) for s, k, e in x} for t, x in zip(texts, spans)]
    terms = [{w for _, _, w in plain_terms(t, x)} for t, x in zip(texts, spans)]
    of_term = Counter(w for t in texts for w in {w.lower() for w in {m.group() for m in WORD.finditer(t)} if len(w) > 1 and w.isalpha()})
    where = defaultdict(set)
    for i, x in enumerate(entities):
        for e in x:
            where[e].add(i)
    told = [set() for _ in texts]
    for e, docs in where.items():
        met = Counter(w for i in docs for w in terms[i])
        for w, both in met.items():
            information = math.log2(n / len(docs))
            if information > 0 and math.log2(n * (both + len(docs) / n) / ((of_term[w] + 1) * len(docs))) >= pii.DISCLOSURE * information:
                for i in docs:
                    if w in terms[i]:
                        told[i].add(w)
    return told


def test_terms_match_brute_force(spark):
    rnd = random.Random(5)
    common = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rare = [f"rare{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    value = lambda i: f"p{i}@mail.example.com" if i % 3 else f"10.0.{i}.7"
    texts = []
    for i in range(260):
        words = [rnd.choice(common) for _ in range(rnd.randint(0, 30))] + [rnd.choice(rare) for _ in range(rnd.randint(0, 3))] + ["04ab91", "x1y", "Ω"]
        if i % 4 == 0:
            words += [value(rnd.randrange(25)) for _ in range(rnd.randint(1, 4))]
        if i % 50 == 0:  # a directory of many values, some of which stand elsewhere as well
            words += [value(k) for k in range(40)] + rare
        if i % 16 == 0:
            words += ["constant", value(3)]
        rnd.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:5]
    rows = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    told = plain_told(texts)
    assert sum(map(len, told)) > 40
    for r in rows:
        t = texts[r.doc_id]
        want = {f"term:{s}:{e}" for s, e, w in plain_terms(t, pii.base_spans(t)) if w in told[r.doc_id]}
        assert {x for x in r.spans.split(",") if x.startswith("term")} == want, r.doc_id


def test_a_directory_of_many_values(spark):
    """4,000 addresses and 4,000 terms in one document, and in a second one like it: no pairs of them."""
    names = ["".join(chr(97 + int(d)) for d in f"{i:05d}") for i in range(4000)]
    page = "\n".join(f"{w} {w}{i}@mail.example.com" for i, w in enumerate(names))
    docs = spark.createDataFrame([(1, page), (2, page + " more")] + [(i, "plain words of a text") for i in range(10, 60)], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in pii.sanitise(docs.withColumn("told", F.lit("mine"))).collect()}
    assert time.time() - began < 60 and rows[1].n_email == rows[2].n_email == 4000 and rows[10].n_email == 0
    assert rows[1].n_term == rows[2].n_term == 4000
