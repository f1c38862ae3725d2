"""Page bodies: literal searches against the patterns they stand for, bodies dealt over tasks, verdicts made once."""

import random

from pyspark.sql import functions as F

from lurewatch.functions import text as tx
from lurewatch.operators.skew import PAGES_PER_TASK, spread
from lurewatch.plans.views import view
from lurewatch.sources.sinks import read_verdicts, write_verdicts

WORDS = ["type=password", 'TYPE="PassWord', "type='paſſword'", "type= password", "2FA", "oTp", "one time", "ONE-TIME", "one　tıme", "onetİme", "one.time", "one  time",
         "Card Number", "ccnum", "CVV", "cvc", "maİlto:", "MAILTO:", "maıl", "sendmail.php", "sendmailxphp", "wp-mail", "phpmail", "ſmtp", "SMTP", "t.me/", "t.me", "Telegram.ORG",
         "telegram.net", "bot_toKen", "api.telegram.org", "discord.gg", "discord.com/api/webhookſ", "discord.com/api", "atob(", "xatob", "medieval", "eval", "éeval", "_eval", "Function(",
         "myFunction(", "fromCharCode(", "window.ethereum", "WEB3", "web3", "walletconnect", "replace", "writeText", "execcommand", "Phishing KİT", "phiſhing kıt", "phishing kit", "tg://",
         "by elite phisher", "by phisher", "BY A PHıſHER", "by\nx phisher", "", "Straße ǅ", "kKey"]


def texts(spark):
    pick = random.Random(7)
    rows = [(w,) for w in WORDS] + [(pick.choice([" ", "", "\n", "="]).join(pick.sample(WORDS, 4)),) for _ in range(400)]
    return spark.createDataFrame(rows, "html string")


def test_literals_find_what_the_patterns_find(spark):
    h, text, lo = F.col("html"), tx.folded(F.col("html")), F.lower(F.col("html"))
    pairs = {"password": (tx.holds_any(text, tx.PASSWORD_LITERALS), h.rlike(tx.PASSWORD_RE)), "otp": (tx.otp_hint(text), h.rlike(tx.OTP_RE)),
             "card": (tx.holds_any(text, tx.CARD_LITERALS), h.rlike(tx.CARD_RE)), "exfil": (tx.holds_any(text, tx.EXFIL_LITERALS), h.rlike(tx.EXFIL_ANY_RE)),
             "js": (tx.js_obfuscation(h), h.rlike(tx.JS_OBFUSCATION_RE)), "wallet": (tx.holds_any(h, tx.WALLET_LITERALS), h.rlike(tx.WALLET_RE)),
             "clipboard": (tx.holds_any(h, tx.CLIPBOARD_WRITE_LITERALS), h.rlike(tx.CLIPBOARD_WRITE_RE)), "kit": (tx.kit_comment(lo), lo.rlike(tx.KIT_COMMENT_RE))}
    got = texts(spark).select("html", *[F.struct(a.alias("a"), b.alias("b")).alias(k) for k, (a, b) in pairs.items()]).collect()
    assert [(r.html, k) for r in got for k in pairs if r[k].a != r[k].b] == []
    assert all({r[k].a for r in got} == {True, False} for k in pairs)


def test_long_base64_runs(spark):
    runs = [("QUJD" * 17, True), ("QUJD" * 16, False), ("QUJD" * 16 + "Q", False), ("=" + "QUJD" * 17, False), ("<p>" + "QUJD" * 20 + "</p>", True), ("QUJD" * 9 + " " + "QUJD" * 18, True),
            ("QUJD" * 17 + "QQ==", True), ("QUJD" * 17 + "Q", False), (None, False)]
    got = spark.createDataFrame(runs, "html string, want boolean").select(tx.has_high_entropy_run(F.col("html")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_bodies_of_one_row_group_are_dealt(spark, tmp_path):
    """One file of one row group is read by one task; the views on its bodies have more, and the same rows."""
    n = 3 * PAGES_PER_TASK
    for name in ("part", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(5).write.parquet(str(tmp_path / f"{name}.parquet"))
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a"), F.col("id").cast("string"), F.lit(".example/")).alias("url"), F.lit("<p>x</p>").alias("html"))
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    for name, times in (("v_pages", 1), ("v_http", 3)):
        table = view(spark, str(tmp_path), name)
        sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 3 and max(sizes) < n * times * 2 // 3 and sum(sizes) == n * times
        assert table.select("n").distinct().count() == n
    assert spread(spark.range(10)).rdd.getNumPartitions() == spark.range(10).rdd.getNumPartitions()


def test_verdicts_are_made_once(spark, tmp_path):
    """Each host lands in one part of the sink, even if a rule answers differently when asked again."""
    coin = F.udf(lambda: "a" if random.random() < 0.5 else None, "string").asNondeterministic()
    verdicts = spark.range(300).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("benign").alias("verdict"), coin().alias("brand"))
    write_verdicts(verdicts, str(tmp_path / "sink"))
    assert sorted(r.host for r in read_verdicts(spark, str(tmp_path / "sink")).collect()) == sorted(f"h{i}" for i in range(300))
