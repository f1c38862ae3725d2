"""Personal data: patterns, and information-theoretic sanitisation of the words that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  Each
distinct value found is a protected entity.  Corpus counts then tell how
strongly a term of an entity's documents reveals it: with N documents, the
entity's information is ``log2(N / df(e))`` and what a term tells of it is the
pointwise mutual information ``log2(N * p(e | t) / df(e))``, with the estimate
``p(e | t) = (df(t, e) + df(e) / N) / (df(t) + 1)``: one document's worth of
chance, so that a term of a value seen once is judged by how rare it is.  A
term that discloses at least ``DISCLOSURE`` of the information is sanitised
wherever it stands in a document with that entity.  Terms in other documents
are counted but stay: they reveal nothing there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.scratch import Scratch

#: Least share of an entity's information.
DISCLOSURE = 0.8
KINDS = ["email", "ip", "card", "phone", "term"]
#: Letters that stand alone: those inside identifiers and hexadecimal strings are no words.
TERM = re.compile(r"(?<![^\W_])[^\W\d_]{2,}(?![^\W_])")
#: Patterns of the base kinds (fixed values); e-mail and IP addresses are matched from their anchors, see below.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match begins where the run of local characters before an @ begins, so each @ is looked at once."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at)  # no later match reaches back over this @
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """A dotted chain of numbers falls into groups of four from the left."""
    for chain in _DOTTED.finditer(text):
        start, parts = chain.start(), chain.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order: the base kinds, leftmost and non-overlapping within a kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    out += [(s, 1, e) for s, e in _ips(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def _value(kind: int, text: str) -> str:
    return f"{KINDS[kind]}:{text.lower() if kind == 0 else text if kind == 1 else _digits(text)}"


def _terms(text: str, spans: list) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms outside all spans."""
    out, taken, i, reach = [], sorted((s, e) for s, _, e in spans), 0, 0
    for m in TERM.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        if s >= reach:
            out.append((s, e, m.group().lower()))
    return out


def _show(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _redact(text: str, spans: list) -> str:
    """Values become the name of their kind, revealing terms a mark; of overlapping spans the first one stands."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
    return "".join([*out, text[at:]])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each text; its entities and, if it has any, its terms."""
    for batch in batches:
        spans, entities, terms = [], [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text or "")
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            entities.append(sorted({_value(k, text[s:e]) for s, k, e in found}))
            terms.append(sorted({t for _, _, t in _terms(text, found)}) if found else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(spans, _SPANS), pa.array(entities, _NAMES), pa.array(terms, _NAMES)], names=["doc_id", "text", "found", "entities", "terms"])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))
_NAMES = pa.list_(pa.string())
_SPANS_SQL = "array<struct<start:bigint,kind:bigint,end:bigint>>"


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term, counted within the task up to a bounded table."""
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update({t.lower() for t in set(TERM.findall(text))} if text else ())
            if len(held) > 500_000:
                yield out()
                held.clear()
    if held:
        yield out()


def reveals(both: Column, of_entity: Column, of_term: Column, n: float) -> Column:
    """Whether a term in ``of_term`` of ``n`` documents, ``both`` of them with the entity, tells enough of it."""
    information = F.log2(F.lit(n) / of_entity)
    shared = F.log2(F.lit(n) * (both + of_entity / F.lit(n)) / ((of_term + 1) * of_entity))
    return (information > 0) & (shared >= F.lit(DISCLOSURE) * information)


def disclosing(rows: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, told): the terms of a document that give one of its entities away.  ``rows`` has ``row``, ``entities`` and ``terms``, both distinct.

    Entities are never paired with the terms of a document one by one:

    * Entities of the same documents are one class, told by its hash of rows.
    * A term that meets a class in one document only tells most of the class of
      the fewest documents, so each term of a document is judged once.
    * A term that meets a class in two documents or more stands in one that
      isn't the class's longest, so these list their terms, and the
      longest is asked for them.
    """
    n = float(docs.count())
    terms = scratch.write(docs.select("text").mapInArrow(_vocabulary, "term string, n long").groupBy("term").agg(F.sum("n").alias("of_term")))
    named = rows.select("row", F.size("terms").alias("length"), F.explode("entities").alias("entity"))
    classes = scratch.write(named.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("b")))
    member = scratch.write(named.join(classes.hint("merge"), "entity").groupBy("row", "length", "of_entity", "a", "b").agg(F.lit(1).alias("one")).drop("one"))
    fewest = member.groupBy("row").agg(F.min("of_entity").alias("of_entity"))
    judged = scratch.write(rows.select("row", F.explode("terms").alias("term")).join(terms.hint("merge"), "term"))
    once = judged.join(fewest.hint("merge"), "row").filter(reveals(F.lit(1), F.col("of_entity"), F.col("of_term"), n)).select("row", "term")
    # classes of several documents: all but the longest one list their terms
    several = member.filter("of_entity > 1")
    longest = scratch.write(several.groupBy("of_entity", "a", "b").agg(F.max(F.struct("length", "row")).alias("longest")).select("of_entity", "a", "b", F.col("longest.row").alias("longest")))
    marked = several.join(longest.hint("merge"), ["of_entity", "a", "b"])
    listed = scratch.write(marked.filter("row <> longest").join(judged.hint("merge"), "row").select("of_entity", "a", "b", "longest", "row", "term", "of_term"))
    met = listed.groupBy("of_entity", "a", "b", "longest", "term").agg(F.count(F.lit(1)).alias("listed"), F.first("of_term").alias("of_term"))
    here = judged.select(F.col("row").alias("longest"), "term", F.lit(1).alias("here"))
    both = F.col("listed") + F.coalesce("here", F.lit(0))
    told = scratch.write(met.join(here.hint("merge"), ["longest", "term"], "left").filter(reveals(both, F.col("of_entity"), F.col("of_term"), n)).select("of_entity", "a", "b", "longest", "term", "here"))
    others = listed.join(told.hint("merge"), ["of_entity", "a", "b", "term"], "left_semi").select("row", "term")
    found = once.unionByName(others).unionByName(told.filter("here = 1").select(F.col("longest").alias("row"), "term"))
    # of each document, the terms that apply
    return scratch.write(found.groupBy("row").agg(F.collect_set("term").alias("told")))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base (text), spans (text) and redacted of each row of ``docs`` (doc_id, text).

    Spans read kind:start:end, joined by commas, by start and then kind; places
    are code points, the end is exclusive.  Null texts count as empty and have
    no spans; ``redacted`` is null where nothing was found.  Repeated rows are documents each.
    Rows without an id are treated alike.  Other columns are ignored.  An empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.mapInArrow(_find, f"doc_id long, text string, found {_SPANS_SQL}, entities array<string>, terms array<string>").withColumn("row", F.monotonically_increasing_id())
    # documents without an entity are done: only their ids are kept; numbers of rows are fixed by writing them
    table = scratch.write(found.select("doc_id", F.when(F.size("found") > 0, F.col("text")).alias("text"), "found", "entities", "terms", "row"))
    told = disclosing(table, docs, scratch)
    marked = table.select("doc_id", "text", "found", "row").join(told, "row", "left").drop("row")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found, told in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found", "told"))):
                base = [(x["start"], x["kind"], x["end"]) for x in found]
                reveal = set(told or ())
                spans = [*base, *((s, 4, e) for s, e, t in _terms(text, base) if t in reveal)] if reveal else base
                counts = Counter(k for _, k, _ in spans)
                rows.append((doc_id, *(counts[k] for k in range(5)), _show(base), _show(spans), _redact(text, spans) if spans else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, [pa.int64()] * 6 + [pa.string()] * 3)], names=names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_term", "base", "spans", "redacted"]
    return marked.mapInArrow(finish, ", ".join(f"{c} {'long' if i < 6 else 'string'}" for i, c in enumerate(names)))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document; ``redacted`` is null where nothing was found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sanitise(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_term", F.sha2("base", 256).alias("base_sha256"), "spans", "redacted")
