"""The words of a line are those of the whole text's lines, whatever blanks stand at its ends."""

import pytest
from pyspark.sql import functions as F

from quorbit.llm import quality_rules


def verdicts(spark, lines):
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    return [r[0] for r in frame.select(quality_rules.line_passes(F.col("line"))).collect()]


@pytest.mark.parametrize("before, after", [("\t", ""), ("", "\r"), (" \t\x0b", "\x0c \r"), ("  ", "  ")])
def test_blanks_at_the_ends_change_nothing(spark, before, after):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    plain = [" ".join(words[:n]) for n in (1, 11, 12, 13)]
    assert verdicts(spark, plain) == [True, True, False, False]
    assert verdicts(spark, [before + x + after for x in plain]) == [True, True, False, False]


def test_crlf_texts_lose_no_more_than_others(spark):
    text = "\n".join(["Eleven words stand here in a row without any sentence mark"] * 3 + [f"A sentence ends with a mark, as number {k} does." for k in range(10)])
    docs = spark.createDataFrame([(1, text), (2, text.replace("\n", "\r\n"))], "doc_id bigint, text string")
    kept = {r["doc_id"]: (r["kept"], r["lost"]) for r in quality_rules.quality_rules(docs).collect()}
    assert kept[1] == kept[2] and kept[1][1] == 0
