"""Quality rules: measures of a text alone, and lines that too many documents of a host share.

Normalised lines are hashed and the distinct documents of each line and host are counted; lines above
the limits are removed, and a document that loses too much is rejected. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stage

#: Runs between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
SPACES_IN_LINE = r"[\x20\x09\x0B-\x0D]+"
WORDED = r"[^\x20\x09-\x0D]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Limits:
    """A line goes if more than `documents` documents of its host hold it and these are more than the `share` of all of the host's.

    A document that loses lines is rejected where fewer than `least_words` words, or less than the
    share `least_rest` of its words, are left.
    """

    documents: int = 10
    share: float = 0.01
    least_words: int = 50
    least_rest: float = 0.5


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns through a generator, so that they are computed once and not wherever they are used."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def normal_lines(text: Column) -> Column:
    """Lines that hold a word, lower-cased and with single spaces between words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), SPACES_IN_LINE, " "), " ?\n ?", "\n")
    return F.array_remove(F.split(F.trim(plain), "\n"), "")


def hashed_lines(lines: Column) -> Column:
    """(line, words) of each line: a 64-bit hash and the number of words."""
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).cast("long").alias("words")))


def repeated_words(rows: DataFrame, words: str) -> DataFrame:
    """Adds n_repeat_words: words that lie in a three-word window found twice or more in their text.

    Windows are told apart by 64-bit hashes, so that two of a text's windows may be taken for one
    with a chance of about n^2 / 2^65. Equal ones are found by sorting, so a text costs n log n.
    """
    n = F.size(words)
    window = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("at")))
    kind = "array<struct<h:bigint,at:int>>"
    ordered = held(rows, _windows=F.when(n >= 3, F.sort_array(window)).otherwise(F.array().cast(kind)))
    same = lambda x, k: F.get("_windows", k)["h"] == x["h"]
    again = F.filter("_windows", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    starts = held(ordered, _starts=F.sort_array(F.transform(again, lambda x: x["at"])))
    # a window covers three words, or those up to the next one
    covered = F.transform("_starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - p, F.lit(3))))
    return starts.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda total, x: total + x)).drop("_windows", "_starts")


def measured(docs: DataFrame, host: str = "source", keep: Sequence[str] | None = None) -> DataFrame:
    """(own, row, document, host, lines) and the measures of each row; `own` has the columns `keep` of `docs`, all where it is None.

    `lines` has hash and words of each line with a word. To be written once, so that row numbers stay.
    """
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("every"))
    own = F.struct(*[F.col(f"every.`{c}`") for c in (docs.columns if keep is None else keep)])
    rows = every.select(
        own.alias("own"), F.coalesce("every.text", F.lit("")).alias("text"), F.coalesce(F.col(f"every.`{host}`").cast("string"), F.lit("")).alias("host"), F.col("every.doc_id").alias("id"), F.monotonically_increasing_id().alias("row"),
    )
    split = held(rows, words=F.array_remove(F.split("text", SPACES), ""), normal=normal_lines(F.col("text")), raw=F.array_distinct(F.split("text", "\n")))
    found = repeated_words(split, "words")
    n_words = F.size("words").cast("long")
    texts = F.size(F.filter("raw", lambda x: x.rlike(WORDED)))
    return found.select(
        "own", "row", F.struct("id", F.when(F.col("id").isNull(), F.col("row")).alias("row")).alias("document"), "host", hashed_lines(F.col("normal")).alias("lines"), n_words.alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"), F.length(F.regexp_replace("text", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("normal") - texts).cast("long").alias("n_dup_lines"), "n_repeat_words", ((n_words < 50) | (F.col("n_repeat_words") * 100 > n_words * 50)).alias("base_failed"),
    )


def frequent_lines(rows: DataFrame, limits: Limits) -> DataFrame:
    """(host, line, documents): lines above the limits. Rows that repeat an id are one document, rows without id are each one.

    A hot line or host is a row for each document and task at first, dealt by line and document, and
    then one partial count a task.
    """
    each = rows.select("host", "document", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counted = each.groupBy("host", "line").agg(F.count_distinct("document").alias("documents")).where(F.col("documents") > limits.documents)
    totals = rows.groupBy("host").agg(F.count_distinct("document").alias("total"))
    return counted.join(totals, "host").where(F.col("documents") > F.col("total") * limits.share).select("host", "line", "documents")


def judge(docs: DataFrame, host: str = "source", limits: Limits = Limits(), keep: Sequence[str] | None = None) -> DataFrame:
    """(own, measures, frequent, removed_words, kept) of each row of `docs`; `own` has its columns `keep`, all where that is None, whatever their names.

    `frequent` has the hashes of the text's lines above the limits, `removed_words` is the number of
    words in them, and `kept` is false for texts that the measures reject and for those that removal
    depletes. A null text has no words. Null hosts are one host of their own, the empty string. Repeated
    rows get a row each, rows without id too; texts of any length count whole, and an empty table gives no rows.
    """
    rows = stage(measured(docs, host, keep), "measured")
    frequent = stage(frequent_lines(rows, limits), "frequent_lines")
    held_by = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words").join(frequent.select("host", "line"), ["host", "line"])
    lost = held_by.groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("frequent"))  # of one text
    both = rows.drop("document", "host", "lines").join(lost, "row", "left").drop("row")
    removed = F.coalesce("removed_words", F.lit(0).cast("long"))
    rest = F.col("n_words") - removed
    depleted = (removed > 0) & ((rest < limits.least_words) | (rest < F.col("n_words") * limits.least_rest))
    return both.withColumns({"frequent": F.coalesce("frequent", F.array().cast("array<bigint>")), "removed_words": removed, "kept": ~F.col("base_failed") & ~depleted})


def cleaned(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """Rows of `docs` that are kept, without their frequent lines; columns other than text stay as they are."""
    judged = judge(docs, host, limits).where("kept")
    text = F.col("own.text")
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), SPACES, " "))
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("frequent", F.xxhash64(plain(x)))), "\n")
    return judged.select(*[F.when(F.size("frequent") > 0, rest).otherwise(text).alias(c) if c == "text" else F.col(f"own.`{c}`") for c in docs.columns])
