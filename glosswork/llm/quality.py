"""Quality rules: text statistics, and the frequency of lines across the documents of a host.

A line that very many different texts of a host share is boilerplate: it is removed, and a document of which too little
remains is rejected. Everything is DataFrame functions. Lines travel as hashes, counted in steps that combine before they
shuffle, so neither a hot host nor a hot line gathers rows in a task. The lines above the limits are kept as one array per
host; as each is in a minimum share of the host's texts, an array is at most (lines per text) / share long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import WS, fresh, let, materialize, text_of, words_of

#: Characters that count as symbols, and the words of a window.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """min_words and max_repeat_pct: the base rules. A line is above the limits if more than ``max_line_docs`` and more than
    ``max_line_share`` of a host's different texts have it; shorter ones than ``min_line_words`` words never are. A document
    is depleted if its words that remain are less than ``min_kept_share``."""

    min_words: int = 20
    max_repeat_pct: int = 30
    min_line_words: int = 3
    max_line_docs: int = 20
    max_line_share: float = 0.02
    min_kept_share: float = 0.3


def _repeat_words(words: Column) -> Column:
    """How many words are in windows that occur twice or more.

    Windows are compared by 64-bit hashes of their words' hashes. Only texts in which one repeats are looked at closely."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def covered(starts: Column) -> Column:
        """Words under windows at the given ascending places."""
        return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")),
                           lambda seen, at: F.struct((seen["n"] + F.least(F.lit(WINDOW), at - seen["at"])).alias("n"), at.alias("at")),
                           lambda seen: seen["n"])

    def repeated(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
        return let(ranked, lambda r: F.sort_array(F.transform(F.filter(
            F.transform(r, lambda x, k: F.struct(x["i"].alias("i"), (
                same(F.get(r, k - 1), x) | same(F.get(r, k + 1), x)).alias("again"))),
            lambda x: x["again"]), lambda x: x["i"])))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(repeated(w)))))


def text_statistics(text: Column, limits: Limits) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{WS}]"))
    long = lambda c: c.cast("long")

    def of(words: Column) -> Column:
        return F.struct(
            long(F.size(words)).alias("n_words"), long(F.char_length(F.array_join(words, ""))).alias("word_chars"),
            long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
            long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
            long(_repeat_words(words)).alias("n_repeat_words"))

    return let(let(words_of(text), of), lambda s: F.struct(
        *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ((s["n_words"] < limits.min_words) | (100 * s["n_repeat_words"] > limits.max_repeat_pct * s["n_words"])).alias(
            "base_failed")))


def _line_key(line: Column) -> Column:
    """Hash of a line without case, digits and outer or repeated white space."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))), f"[{WS}]+", " "),
                                       "[0-9]+", "0"))


def _line_words(line: Column) -> Column:
    return F.size(words_of(line))


def frequent_lines(docs: DataFrame, limits: Limits, host: str = "source", text_col: str = "text") -> DataFrame:
    """(host, lines): the hashes of each host's lines above the limits, in a written table.

    Equal texts of a host count as one document, so that copies don't make their own lines frequent: that is the business of
    deduplication. Null hosts are one host."""
    rows = docs.select(F.col(host).alias("host"), text_of(text_col).alias("text")).where("text <> ''")
    texts = rows.groupBy("host", F.xxhash64("text").alias("doc")).agg(F.lit(1).alias("one")).groupBy("host").agg(
        F.count("*").alias("texts"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: _line_words(x) >= limits.min_line_words)
    keys = rows.select("host", F.xxhash64("text").alias("doc"), F.explode(F.array_distinct(F.transform(lines, _line_key))).alias(
        "line"))
    seen = keys.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limits.max_line_docs)
    limit = texts.select(F.col("host").alias("h"), "texts")
    above = seen.join(limit, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > limits.max_line_share * F.col("texts"))
    return materialize(above.groupBy("host").agg(F.collect_list("line").alias("lines")), "lines")


def quality(docs: DataFrame, limits: Limits = Limits(), host: str = "source", text_col: str = "text") -> DataFrame:
    """Add the struct ``quality``: the text statistics and base_failed, words_left after the removal of frequent lines, lines_removed,
    kept, and text_left, the text without those lines.

    A null text counts as empty (and stays null in text_left): no words, base_failed, not kept. Repeated rows stay and have
    equal results; equal lines of a text are removed together. An empty table gives none. A column named quality is replaced, others
    are left alone.
    """
    host_of, lines_of = fresh(docs, "_host"), fresh(docs, "_lines")
    bad = frequent_lines(docs, limits, host, text_col).select(F.col("host").alias(host_of), F.col("lines").alias(lines_of))
    text, lines = text_of(text_col), F.col(lines_of)
    # a written table: Spark broadcasts it if its files are below the session's threshold, else joins by host and splits hot ones
    joined = docs.join(bad, F.col(host).eqNullSafe(F.col(host_of)), "left")
    split = F.split(text, "\n", -1)
    is_bad = lambda x: (_line_words(x) >= limits.min_line_words) & F.array_contains(lines, _line_key(x))
    left = F.when(lines.isNull(), split).otherwise(F.filter(split, lambda x: ~is_bad(x)))

    def verdict(stats: Column, kept_lines: Column) -> Column:
        untouched = F.size(kept_lines) == F.size(split)
        text_left = F.when(untouched, F.col(text_col)).otherwise(F.array_join(kept_lines, "\n"))
        words_left = F.when(untouched, stats["n_words"]).otherwise(F.size(words_of(text_left)).cast("long"))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        return F.struct(
            *[stats[c].alias(c) for c in names], words_left.alias("words_left"),
            (F.size(split) - F.size(kept_lines)).cast("long").alias("lines_removed"),
            (~stats["base_failed"] & (words_left >= limits.min_kept_share * stats["n_words"])).alias("kept"),
            text_left.alias("text_left"))

    verdicts = let(text_statistics(text, limits), lambda s: let(left, lambda kept: verdict(s, kept)))
    return joined.withColumn("quality", verdicts).drop(host_of, lines_of)


def quality_digest(docs: DataFrame) -> DataFrame:
    q = quality(docs.select("doc_id", "source", "text"))
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left",
        "lines_removed")])
