"""Licence notices over several lines, families without a template, and columns of odd names."""

import pytest
from pyspark.sql import functions as F

from lurewatch.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark)


def found(spark, model, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licences for r in licenses.scan(table, model).orderBy("doc_id").collect()]


def wrap(text, width, mark=""):
    w = text.split()
    return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_wrapped_notices(spark, model):
    mit, bsd, apache, gpl = (licenses.NOTICES[f][i] for f, i in (("mit", 4), ("bsd", 4), ("apache-2.0", 1), ("gpl-3.0", 3)))
    cases = [(f, wrap(t, n, mark)) for f, t in (("mit", mit), ("bsd", bsd), ("apache-2.0", apache), ("gpl-3.0", gpl)) for n in (7, 9, 12) for mark in ("", " * ", "# ")]
    texts = [f"import os\n\n{t}\n\nSome prose about the sea." for _, t in cases]
    assert found(spark, model, texts) == [f for f, _ in cases]


def test_families_without_a_template(spark, model):
    texts = ["Licensed under the Eclipse Public License 2.0.", "Boost Software License - Version 1.0 - August 17th, 2003",
             "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
             "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0"]
    assert found(spark, model, texts) == [None] * 4


def test_a_blank_line_parts_paragraphs(spark, model):
    half = wrap(licenses.NOTICES["mit"][4], 6).replace("\n", "\n\n")
    assert found(spark, model, [half]) == [None]


def test_columns_of_any_name(spark, model):
    table = spark.createDataFrame([(1, "Released under the MIT License.", "a", "b", "c", "d")], ["doc_id", "text", "_lines", "lines", "a.b", "kept"])
    row = licenses.scan(table, model).first()
    assert row.licences == "mit" and [row[c] for c in ("_lines", "lines", "a.b", "kept")] == ["a", "b", "c", "d"]
    assert licenses.scan(table.where(F.lit(False)), model).count() == 0
