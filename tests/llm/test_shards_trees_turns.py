"""Sharding, conversation repair and the Merkle manifest against plain versions; nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from lurewatch.llm import conversations as conv
from lurewatch.llm import merkle, sharding
from tests.llm import plain

SF = "/root/testdata/sf0.001"


# --- sharding ---------------------------------------------------------------

def shards(spark, keys, tree):
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    return {r.doc_id: r.shard for r in sharding.assign(df, tree).collect()}


def test_shards_follow_weights_and_move_in_changed_subtrees_only(spark):
    tree = {"a": {"x": {0: 1, 1: 3}, "y": {2: 2}}, "b": {"x": {3: 4, 4: 0}, "y": {5: 2}}}
    keys = range(6000)
    before = shards(spark, keys, tree)
    share = Counter(before.values())
    assert set(share) == {0, 1, 2, 3, 5} and all(abs(share[s] / 500 - w) < 0.6 for s, w in ((0, 1), (1, 3), (2, 2), (3, 4), (5, 2)))
    heavier = {"a": {"x": {0: 1, 1: 5}, "y": {2: 2}}, "b": tree["b"]}
    after = shards(spark, keys, heavier)
    moved = {(before[k], after[k]) for k in keys if before[k] != after[k]}
    # into the heavier region, rack or shard; never out of one, nor between subtrees that stay
    assert moved and all(new in (0, 1, 2) for _, new in moved) and all(old in (3, 5) or new in (0, 1) for old, new in moved) and all(old in (2, 3, 5) or new == 1 for old, new in moved)
    assert not {(3, 5), (5, 3)} & moved


def test_a_new_shard_takes_documents_into_itself_only(spark):
    tree = sharding.TREE
    for n in (16, 17):
        more = sharding.grown(tree, n)
        old, new = shards(spark, range(4000), tree), shards(spark, range(4000), more)
        changed = [k for k in old if old[k] != new[k]]
        assert 4000 / (n + 1) * 0.7 < len(changed) < 4000 / (n + 1) * 1.4 and all(new[k] == n for k in changed)
        tree = more
    assert shards(spark, [1], {}) == {1: None}


def test_slots_of_hot_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    monkeypatch.setattr(sharding, "CHUNK", 7)
    rows = [(7, "same", "c")] * 100 + [(8, f"t{i}", "c") for i in range(100)] + [(i, t, "c") for i, t in enumerate(plain.ODD_TEXTS)] + [(None, "x", "c"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("slot", F.lit(1)).withColumn("a.b", F.lit(2))
    got = sharding.slots(sharding.assign(df, sharding.TREE), ["doc_id", "text"]).collect()
    assert Counter((r.doc_id, r.text, r["a.b"]) for r in got) == Counter((d, t, 2) for d, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    for key in (7, 8, None):
        assert len({r.shard for r in got if r.doc_id == key}) == 1
    again = sharding.slots(sharding.assign(df.repartition(5), sharding.TREE), ["doc_id", "text"]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sharding.slots(sharding.assign(df.limit(0), sharding.TREE), ["doc_id"]).count() == 0


# --- conversations ----------------------------------------------------------

def cheapest(turns):
    """(cost, audit) by search over what has been said, without tables: turns of (initial, must go, truncated)."""
    @lru_cache(None)
    def rest(i, last):
        best = []
        if i == len(turns):
            if last in "-a":
                best.append((0, ""))
        else:
            c, must, cut = turns[i]
            cost, audit = rest(i + 1, last)
            best.append((cost + 2, "D" + audit))
            for new in ("su" if last == "-" else "a" if last == "u" else "u") if not must else "":
                if new == c or new != "s":
                    cost, audit = rest(i + 1, new)
                    best.append((cost + (c != new) + 5 * cut, ("K" if c == new else "R") + audit))
        if i < len(turns) or last in "su":
            new = "a" if last == "u" else "u"
            if last != "-" or i < len(turns):
                cost, audit = inserted(i, new, 1)
                best.append((cost + 5, "I" + audit))
        return min(best)

    @lru_cache(None)
    def inserted(i, last, n):
        # more than three insertions in a row never pay
        c = [rest_no_insert(i, last)]
        if n < 3:
            cost, audit = inserted(i, "a" if last == "u" else "u", n + 1)
            c.append((cost + 5, "I" + audit))
        return min(c)

    @lru_cache(None)
    def rest_no_insert(i, last):
        if i == len(turns):
            return (0, "") if last == "a" else (1 << 30, "")
        c, must, cut = turns[i]
        cost, audit = rest(i + 1, last)
        best = [(cost + 2, "D" + audit)]
        if not must:
            new = "a" if last == "u" else "u"
            cost, audit = rest(i + 1, new)
            best.append((cost + (c != new) + 5 * cut, ("K" if c == new else "R") + audit))
        return min(best)

    return rest(0, "-")


def test_alignment_is_cheapest_and_pieces_compose():
    rnd = random.Random(3)
    kinds = list(product("sua ", (False, True), (False, True)))
    for n in [*range(7), 9, 12, 20, 33] * 25:
        turns = [rnd.choice(kinds) if rnd.random() < 0.5 else (rnd.choice("sua"), False, rnd.random() < 0.2) for _ in range(n)]
        want = cheapest(tuple(turns))
        assert conv.Aligner(turns).whole() == want, turns
        for size in (1, 2, 5):
            pieces = [conv.Aligner(turns[i:i + size]) for i in range(0, n, size)]
            ways = [{a + b: p.cheapest(a, b) for a, bs in (("-", "-sua"), ("s", "sua"), ("u", "ua"), ("a", "ua")) for b in bs} for p in pieces]
            cost, parts = conv.chain([{k: v for k, v in w.items() if v} for w in ways])
            assert n == 0 or (cost, "".join(a for _, a in parts)) == want, (turns, size)


SPACES = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """{conv_id: result row}; rows of (conv_id, turn, role, text) before damage."""
    by = {c: [] for c, *_ in rows}
    blank = lambda x: " " if x is None else str(x)
    for at, (c, turn, role, text) in enumerate(rows):
        kind = zlib.crc32(f"{blank(c)}:{blank(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else blank(role), blank(text)
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        name = "" if c is None else f"={c}"
        by[c] += [(turn is not None, turn or 0, role, hashlib.md5(f"{name}\0{role}\0{text}".encode()).hexdigest(), at, k, turn, text) for k in range(0 if kind == 0 else 2 if kind == 3 else 1)]
    out = {}
    for c, turns in by.items():
        turns.sort()
        seen, faults, marks = set(), Counter(), []
        for *_, role, _, _, _, _, text in turns:
            bare = text.rstrip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = cheapest(tuple(marks))
        said, at = [], 0
        kept = len(audit) - audit.count("D")
        target = ["s" if kept % 2 else "u"] + ["u" if (i + kept) % 2 == 0 else "a" for i in range(1, kept)] if kept else []
        for edit in audit:
            if edit != "D":
                to = {"s": "system", "u": "user", "a": "assistant"}[target[len(said)]]
                said.append((turns[at][2] if edit == "K" else to) + ":" + ("" if edit == "I" else turns[at][7]))
            at += edit != "I"
        numbers = [t[6] for t in turns if t[6] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        out[c] = (c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def odd_conversations(n):
    rnd = random.Random(11)
    say = lambda: rnd.choice(["Yes.", "No!", "cut off", "", " \n", "Long " * rnd.randint(1, 50) + "end?", "日本。", None, "Yes.\r\n"]) if rnd.random() < 0.6 else f"Say {rnd.random()}."
    rows = [(c, rnd.choice([t, t, t, t + 2, None]), rnd.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), say()) for c in [*range(12), None] for t in range(rnd.randint(1, 9))]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", say()) for t in range(n)]
    return rows + rows[:3] + [(50, 1, "user", "x" * 300_000 + ".")]


@pytest.mark.parametrize("piece", [conv.PIECE, 5])
def test_conversations_match_plain(spark, monkeypatch, piece):
    """A conversation of a third of all turns among them, cut by ranges and by pieces."""
    monkeypatch.setattr(conv, "PIECE", piece)
    rows = odd_conversations(60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).withColumn("kind", F.lit("mine"))
    got = {r.conv_id: tuple(r) for r in conv.summary(conv.repair(conv.damaged(df), gone=F.col("gone"))).collect()}
    assert got == plain_repair(rows)
    pieces = conv.repair(conv.damaged(df), gone=F.col("gone"))
    assert pieces.filter("not whole").count() >= (2 if piece > 60 else 12)
    turns = [(r.conv_id, role) for r in pieces.orderBy("part", "piece").collect() for role in r.roles]
    for c in {r[0] for r in rows}:
        said = "".join(role[:1] for x, role in turns if x == c)
        assert said == "" or said.removeprefix("s") == "ua" * (len(said) // 2)
    assert conv.summary(conv.repair(df.limit(0))).count() == 0


# --- manifest ---------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Levels of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_siblings(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 8 * 8
        out.append((level[start:i], level[i + 1:start + 8]))
        i //= 8
    return out


def plain_manifest(rows):
    """Result rows of op13 from (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        text = r[4]
        if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0 and text is not None:
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        groups[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r[0], plain_leaf((*r[:4], text))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in order}
    upper = plain_tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (_, _, leaf, doc_id, other) in enumerate(sorted(groups[g])):
            path = plain_siblings(trees[g], i) + plain_siblings(upper, at)
            for left, right in path:
                other = h(*left, other, *right)
            out.append((doc_id, leaf, trees[g][-1][0], upper[-1][0], h(*(d for left, right in path for d in left + right)), other, other == upper[-1][0]))
    return out


@pytest.mark.parametrize("levels", [merkle.LEVELS, 1, 2])
def test_manifest_matches_plain(spark, levels):
    rnd = random.Random(levels)
    rows = [(i, "s", rnd.choice(["en", "en", "en", "de", None, "", "=x", "日本"]), rnd.choice([None, i]), t) for i, t in enumerate(plain.ODD_TEXTS * 12 + ["Upper Case"] * 60)]
    rows += rows[:5] + [(None, None, None, None, None), (None, None, "en", 1, "Null id")] * 2 + [(10**6 + i, "s", f"l{i}", 1, "One") for i in range(11)] + [(7, "s", "en", 7, f"T{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    tampered = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    got = merkle.manifest(df.withColumn("g", F.lit("mine")).withColumn("i", F.lit(3)).withColumn("a.b", F.lit(3)), merkle.COLUMNS, changed={"text": tampered}, levels=levels).collect()
    want = plain_manifest(rows)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded, r.verified) for r in got) == Counter(want)
    assert not all(r.verified for r in got)
    for r in got[:50]:
        assert r.verified == (merkle.fold(r.leaf, merkle._read(r.path)) == r.folded) and merkle.proof(merkle._read(r.path)) == r.proof


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = merkle.manifest(spark.createDataFrame([(1, "s", "en", 2, "x" * 10**6)], schema), merkle.COLUMNS).first()
    assert one.leaf == one.subroot == one.root == one.folded and one.verified and one.proof == h() and one.path == ""
    assert merkle.manifest(spark.createDataFrame([], schema), merkle.COLUMNS).count() == 0


# --- registry ---------------------------------------------------------------

@pytest.mark.parametrize("name", ["op11_sharding", "op12_conversations", "op13_merkle"])
def test_new_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(found.fetchall())


def test_sharding_query_columns(spark):
    from lurewatch.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op11_sharding"](spark, SF).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 16)
