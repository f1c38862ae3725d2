"""Line dedup: chains of near lines, exact repeats of any length, texts without spaces."""

import random

from lurewatch.llm import line_dedup
from tests.llm import plain


def dedup(spark, texts):
    rows = list(enumerate(texts))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got) == sorted(plain.dedup_lines(rows))
    return {r.doc_id: r.text for r in got}


def test_a_line_stays_unless_a_kept_one_is_near(spark):
    a = "one two three four five six seven eight"
    chain = [a]
    for i, new in enumerate("ABCDEFGH"):
        w = chain[-1].split()
        w[i] = new
        chain.append(" ".join(w))
    got = dedup(spark, chain)
    assert [i for i in range(9) if got[i]] == [0, 2, 4, 6, 8]
    # what is dropped draws nothing with it
    assert dedup(spark, chain[1:])[1] == ""


def test_long_chains_and_cliques(spark):
    rnd = random.Random(9)
    names = [f"n{i}" for i in range(4)]
    texts = []
    for _ in range(40):
        texts.append("\n".join(" ".join(rnd.choice(names) for _ in range(rnd.choice((5, 6, 7)))) for _ in range(rnd.randint(1, 5))))
    dedup(spark, texts)


def test_short_lines_and_scripts_without_spaces(spark):
    page = "第一行の文章がここにある。\nAll rights reserved.\n\n}\n \n}\nx"
    got = dedup(spark, [page, page, "第一行の文章がここにある。!\n}\n\tAll  rights reserved.", ""])
    assert got[0] == "第一行の文章がここにある。\nAll rights reserved.\n\n}\n \nx" and got[1] == "\n " and got[2] == "第一行の文章がここにある。!"
