"""Line-first cleaning, then whole-text rules.

Each line is held against punctuation, navigation and boilerplate rules; lines
that fail go, and a document that loses too much of its text goes whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorbit.llm.columns import BLANKS, pick, without, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the line rules, and of the rule for the document."""

    long_line: int = 12  # words from which a line must hold the end of a sentence
    most_symbols: float = 0.05  # of a line's characters
    most_shouts: float = 0.2  # doubled marks (!!, ??) a word
    least_bars: int = 3  # separators that make a line a menu, if they are also
    most_bars: float = 0.15  # this share of its words
    notice_words: int = 40  # a notice is no longer than this
    most_lost: float = 0.5  # of the text's characters in words
    min_words: int = 50
    most_repeated: int = 50  # percent of words in repeated 3-word windows


#: Fixed phrases of notices that sites and repositories put into texts.
NOTICE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie policy|use of cookies|"
    "enable javascript|sign up|log ?in to|subscribe to|click here|copyright ?(\\(c\\)|©|\\d{4})|"
    "licensed under (the|a) |released under (the|a) .{0,30}licen[cs]e|spdx-license"
)


def _only(text: Column, marks: str) -> Column:
    """The marks of a text, in order; runs of other characters are passed over at once."""
    return F.regexp_replace(text, f"[^{marks}]+", "")


def _n(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(without(text, characters))


def line_facts(line: Column) -> Column:
    """What the rules ask of a line, found once: the line, its number of words, and its marks in order."""
    bare = F.btrim(line, F.lit(BLANKS))
    n_words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+")))
    return F.struct(line.alias("line"), n_words.alias("n"), _only(line, "#*$%&|»•·!?").alias("marks"))


def facts_pass(facts: Column, limits: Limits = Limits()) -> Column:
    """Whether a line keeps its place; lines without a word pass."""
    line, n_words, marks = facts["line"], facts["n"], facts["marks"]
    bars = _n(marks, "|»•·")
    punctuation = (
        ((n_words < limits.long_line) | line.rlike("[.!?…:;。！？]"))
        & (_n(marks, "#*$%&") <= limits.most_symbols * F.length(line))
        & (_n(marks, "!?") <= n_words * limits.most_shouts * 2)
    )
    navigation = (bars < limits.least_bars) | (bars < n_words * limits.most_bars)
    notice = (n_words <= limits.notice_words) & F.lower(line).rlike(NOTICE)
    return (n_words == 0) | (punctuation & navigation & ~notice)


def line_passes(line: Column, limits: Limits = Limits()) -> Column:
    return F.element_at(F.transform(F.transform(F.array(line), line_facts), lambda f: facts_pass(f, limits)), 1)


def window_hashes(word_list: Column) -> Column:
    """Hashes of the 3-word windows, in order."""
    at = lambda i: F.get(word_list, i)
    n = F.size(word_list)
    made = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    return F.when(n >= 3, made).otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more.

    Windows are sorted by hash with their places, so that equal ones are
    neighbours; places of repeated windows are sorted again and their spans
    merged. That is linear in one text, but for the two sorts; texts whose
    windows are all different need neither.
    """

    def merged(arrays: Column) -> Column:
        near = lambda x, i: F.coalesce(F.get(arrays, i)["h"] == x["h"], F.lit(False))
        again = F.transform(F.filter(arrays, lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x["p"])
        return F.aggregate(
            F.sort_array(again),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(p - a["last"], F.lit(3))).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    placed = F.sort_array(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    # bound by transform, so that the sorted windows are made once
    found = F.element_at(F.transform(F.array(placed), merged), 1)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(found).cast("long")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), row: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, clean_text, the measures and the verdict; with ``row``, also the whole row.

    Measures (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) are of
    the whole text as it came; ``lost`` is the share of its word characters in
    removed lines. Null and empty texts have zeros, and fail for want of words.
    Repeated rows, and rows of a null id, are judged each by itself, by text alone,
    so there are no ties; texts of any length are read whole, within one row. An
    empty table gives an empty result; columns of other names are not looked at.
    A line's words are what the whole text's are: blanks at its ends, such as the
    return of a CRLF text, are none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    measures = F.struct(
        F.col("clean_text"),
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars"),
        F.length(_only(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("with_word") - F.size(F.array_distinct("with_word"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.when(F.col("clean_text") == F.col("text"), F.col("word_chars")).otherwise(F.length(without(F.col("clean_text"), BLANKS))).cast("long").alias("kept_chars"),
    )
    whole = ["row"] if row else []
    measured = (
        pick(docs, row=row, doc_id=id_col, text=text_col)
        .withColumn("text", text)
        .withColumn("lines", F.transform(F.split("text", "\n"), line_facts))
        .withColumn("with_word", F.transform(F.filter("lines", lambda f: f["n"] > 0), lambda f: f["line"]))
        .withColumn("clean_text", F.concat_ws("\n", F.transform(F.filter("lines", lambda f: facts_pass(f, limits)), lambda f: f["line"])))
        .withColumn("words", words(F.col("text")))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("windows", window_hashes(F.col("words")))
        # one row each; no filter on the measures goes below this, where it would make them again
        .select(*whole, "doc_id", F.inline(F.array(measures)))
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.most_repeated * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, 1 - F.col("kept_chars") / F.col("word_chars")).otherwise(0.0)
    return measured.withColumn("base_failed", failed).withColumn("lost", lost).withColumn("kept", ~failed & (lost <= limits.most_lost))


def op10(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", F.round("lost", 6).alias("lost")
    )
