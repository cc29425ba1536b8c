"""Numbers and dotted numbers with their surroundings, neighbours included, against slices of the text."""

import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import privacy

TEXTS = ["RR 120 mmhg, puls 80 bpm, 37 kg", "1.2.3.4 und 5.6.7.8 g/l", "(0.14.2.58 g/l) ferritin 1.1.1.1 x", "7", "", None, "4000 Hz 5 - 6-mg 7%8‰ 9 cmh2o 1,5 mmol/l", "12 5 6 7 8 9 mg", "é1ü2ß3 4", "9" * 40 + " g", "1.2.3.4.5.6.7.8(9.9.9.9 %", "CRP" + " " * 27 + "1.2.3.4", "CRP" + " " * 28 + "1.2.3.4"]


@pytest.mark.parametrize("expression, reach, least", [("[0-9]+", 15, 2), ("[0-9]+", 1, 2), (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 30, 7)])
def test_contexts(spark, sf, expression, reach, least):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    for r in privacy.with_contexts(df, "text", expression, reach, least).collect():
        want = [(r.text[max(m.start() - reach, 0) : m.start()], m[0], r.text[m.end() : m.end() + reach]) for m in re.finditer(expression, r.text)]
        assert [tuple(x) for x in r.found] == want, r.text


def test_measures_and_ranges(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    numbers = privacy.with_contexts(df, "text", "[0-9]+", 15, 2).select("id", F.expr("transform(found, x -> x.match)").alias("m"), F.transform("found", lambda x: privacy.is_measure(x.after)).alias("is")).collect()
    of = {r.id: list(zip(r.m, r["is"], strict=True)) for r in numbers}
    assert of[0] == [("120", True), ("80", True), ("37", True)]
    assert [x for x, y in of[6] if y] == ["4000", "6", "7", "8", "9", "5"] and of[7][-1] == ("9", True) and not of[7][0][1]
    dotted = privacy.with_contexts(df, "text", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 30, 7).select("id", F.transform("found", lambda x: privacy.is_lab_range(x.before, x.after)).alias("is")).collect()
    ranges = {r.id: r["is"] for r in dotted}
    assert ranges[1] == [False, False] and ranges[2] == [True, True] and ranges[10] == [False, False, True] and ranges[11] == [True] and ranges[12] == [False]
