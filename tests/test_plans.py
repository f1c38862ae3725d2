"""Plan properties of the operators: rules stay JVM-side, the suffix join is broadcast, no cross joins.

(The driver's derived views use ``CROSS JOIN (VALUES ...)`` as test-input
definitions, so plan checks run on plain capture tables instead.)
"""

from lurewatch.functions.dates import as_of_lit
from lurewatch.operators.verdict import classify
from lurewatch.rules import TEST_RULES
from tests.test_rules import make


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_classify_plan(spark):
    ctx = make(spark, cname=[("phish-testbrand.com", "x.example.net.")], ct=(200, "[]"),
               rdap=(200, "{}"), favicon=(200, b"x"), cert={"body": "{}"})
    p = plan(classify(ctx, TEST_RULES, as_of_lit("2026-01-15 12:00:00")))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "BroadcastHashJoin" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_cluster_conf_sizing():
    from lurewatch.session import cluster_conf
    c = cluster_conf(100 * 2**40, stateful_stream=True)
    assert c["spark.sql.shuffle.partitions"] == "20480"
    assert c["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert "RocksDB" in c["spark.sql.streaming.stateStore.providerClass"]
    assert "spark.checkpoint.dir" not in c
    assert cluster_conf(10 << 20)["spark.sql.shuffle.partitions"] == "200"


def test_bodies_stay_out_of_the_shuffle(spark):
    """Every capture is parsed before its exchange: no exchange carries a body or content column."""
    from lurewatch.operators import captures as cap
    tables = {
        cap.rdap_fields: "registrable string, status int, body string, captured_at timestamp",
        cap.ct_history: "registrable string, status int, body string, captured_at timestamp",
        cap.cert_fields: "host string, body string, error string, captured_at timestamp",
        cap.favicon_fields: "host string, status int, content binary, captured_at timestamp",
    }
    for roll_up, schema in tables.items():
        plan = roll_up(spark.createDataFrame([], schema))._jdf.queryExecution().sparkPlan().toString()
        partial = [line for line in plan.splitlines() if "partial_max_by" in line]
        assert partial and not any("body#" in line or "content#" in line for line in partial)


def test_cname_walk_is_linear(spark):
    from lurewatch.operators.captures import cname_chains
    hosts = spark.createDataFrame([], "host string")
    plan = cname_chains(hosts, spark.createDataFrame([], "src string, target string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") <= 10 and "Union" not in plan


def test_unset_folder_raises_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from lurewatch.session import checkpoint_dir
    empty = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: empty, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=empty))
