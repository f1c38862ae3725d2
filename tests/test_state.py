"""Tables that batches change: pending hosts, seen hosts, settled verdicts, CNAME jumps, the keyword index."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from lurewatch.functions.dates import as_of_lit
from lurewatch.operators import captures as cap
from lurewatch.operators.seen import SeenHosts
from lurewatch.plans.triage import Captures
from lurewatch.rules import TEST_RULES
from lurewatch.sources.store import Delta, names
from lurewatch.streaming.triage import due, latest_verdicts, pending_table, settle, start_triage, stream_hosts

AS_OF = "2026-01-15 12:00:00"


def keys(df):
    return sorted(r[0] for r in df.select("host").collect())


def frame(spark, hosts):
    return spark.createDataFrame([(h, "s", None) for h in hosts], "host string, source string, brand string")


def test_delta_table(spark):
    root = tempfile.mkdtemp(prefix="lw-delta-")
    table = Delta(spark, root, "host string, source string, brand string", "host", buckets=4)
    none = frame(spark, []).select("host")
    assert keys(table.read()) == []
    table.change(0, none, frame(spark, [f"h{i}" for i in range(40)]))
    for _ in range(2):  # a replayed batch sees what the first attempt saw
        table.change(3, frame(spark, ["h1", "h2", "absent"]).select("host"), frame(spark, ["new"]))
        assert keys(table.read()) == sorted(["new", *(f"h{i}" for i in range(40) if i not in (1, 2))])
    assert keys(table.read(3)) == sorted(f"h{i}" for i in range(40))
    before = set(names(spark, f"{root}/rows/version=3"))
    table.change(4, frame(spark, ["new"]).select("host"), frame(spark, []))
    written = [n for n in names(spark, f"{root}/rows/version=4") if n.startswith("bucket=")]
    assert len(written) <= 1 < len(before)  # the bucket of that host alone
    table.change(5, table.read().select("host"), frame(spark, []))
    assert keys(table.read()) == [] and len(names(spark, f"{root}/manifests")) == 2


def http_of(spark, hosts):
    return spark.createDataFrame([(h, "primary", None, 404, {}, "", [], f"http://{h}", 0.0) for h in hosts], cap.HTTP_SCHEMA)


def test_a_batch_does_not_read_the_history(spark):
    """Captures arrive in parts; earlier batches of the sink are gone, and still every host is settled once."""
    root = tempfile.mkdtemp(prefix="lw-history-")
    land, sink, out = (os.path.join(root, x) for x in ("landing/manual", "sink", "out"))
    os.makedirs(land)
    waiting = [f"w{i}-testbrand.com" for i in range(6)]
    got, read = {}, []
    for run, (new, captured) in enumerate([(waiting, []), (["x.com", waiting[0]], waiting[:2]), (["late-testbrand.com"], waiting[2:4]), ([], ["late-testbrand.com", waiting[4]])]):
        with open(os.path.join(land, f"{run}.txt"), "w") as fh:
            fh.write("\n".join([*new, "x.com"]) + "\n")
        read.append(pending_table(spark, sink).read().count())
        hs = stream_hosts(spark, os.path.join(root, "landing"), [("manual", False)])
        latest = Captures(http=http_of(spark, captured)) if captured else Captures()
        start_triage(spark, hs, lambda c=latest: c, TEST_RULES, as_of_lit(AS_OF), sink, os.path.join(root, "ckpt")).awaitTermination()
        settle(spark, sink, out)
        got |= {r.host: r.verdict for r in latest_verdicts(spark, sink).collect()}
        files = due(spark, sink, http_of(spark, waiting), 99).inputFiles()
        assert not any("/sink/" in f for f in files)  # the sink is written, never read
    assert got == {"x.com": "irrelevant", waiting[5]: "pending", "late-testbrand.com": "benign"} | {h: "benign" for h in waiting[:5]}
    assert read == [0, 6, 4, 3]  # hosts that wait, whatever has been settled
    from lurewatch.sources.sinks import read_verdicts
    assert {r.host: r.verdict for r in read_verdicts(spark, out).collect()} == got
    before = sorted((p, f) for p, _, fs in os.walk(os.path.join(out, "brands")) for f in fs)
    settle(spark, sink, out)
    assert sorted((p, f) for p, _, fs in os.walk(os.path.join(out, "brands")) for f in fs) == before


def test_seen_hosts(spark):
    root = tempfile.mkdtemp(prefix="lw-seen-")
    name = "seen_test_" + os.path.basename(root).replace("-", "_").lower()
    rnd = random.Random(1)
    loads = [[f"h{rnd.randrange(900)}.com" for _ in range(400)] for _ in range(3)]
    held = set()
    for load, hosts in enumerate(loads):
        df = spark.createDataFrame([(h,) for h in hosts], "host string")
        for again in range(2):  # a repeated load gives the same
            seen = SeenHosts(spark, name + str(again), root, buckets=16, bits=1 << 15)
            assert keys(seen.unseen(df, load)) == sorted(set(hosts) - held)
            seen.add(seen.unseen(df, load), load)
        held |= set(hosts)
        assert keys(spark.table(seen.table)) == sorted(held)
    none, may = seen.split(spark.createDataFrame([(f"z{i}",) for i in range(300)], "host string"), 9)
    assert none.count() > 200 and none.count() + may.count() == 300
    plan = seen.unseen(df, 9)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("LeftAnti"):]
    right = scan[scan.rindex("Scan parquet spark_catalog") - 400:]
    assert "Exchange hashpartitioning" not in right  # the table is read bucket by bucket


def test_cname_jumps_equal_a_walk(spark):
    """Loops, chains beyond ten hops, names that many point to, several answers."""
    rnd = random.Random(2)
    edges = [(f"n{i}.net", f"n{i + 1}.net.", 0) for i in range(25)] + [("a.net", "b.net.", 0), ("b.net", "a.net.", 0), ("self.net", "self.net.", 0)]
    edges += [(f"h{i}.com", "n20.net." if i % 3 else f"n{rnd.randrange(25)}.net.", 0) for i in range(200)] + [("h1.com", "z.net.", 1), ("h2.com", "0.net.", -1)]
    hosts = [f"h{i}.com" for i in range(200)] + ["n0.net", "a.net", "self.net", "none.org"]
    first = {}
    for s, t, p in edges:
        first[s] = min(first.get(s, (99, "")), (p, t))

    def walk(h):
        out = []
        while len(out) < 10 and h in first:
            out.append(first[h][1])
            h = out[-1].rstrip(".")
        return out

    rows = cap.cname_chains(spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame(edges, "src string, target string, pos int")).collect()
    assert {r.host: r.cname.chain for r in rows} == {h: walk(h) for h in hosts}


def test_keyword_index_equals_a_scan(spark):
    from lurewatch.operators.match import match_brand
    from lurewatch.rules import Brand
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 5)))
    rules = TEST_RULES.with_(brands=tuple(Brand(i * 3, f"B{i}", (), (word() if i else "b" * 9, word()), (word() + word(),) if i % 2 else ()) for i in range(60)))
    texts = ["".join(rnd.choice("abé.") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    rows = match_brand(spark.createDataFrame([(t,) for t in [*texts, None]], "host string"), rules).collect()
    for r in rows:
        h = r.host or ""
        want = next((b for b in rules.brands if any(k in h for k in rules.brand_match(b)) and not any(k in h for k in rules.brand_exclude(b))), None)
        assert (r.brand, r.brand_ord) == ((want.name, want.ord) if want else (None, None)), h
