"""Quality rules by cross-document line frequency, with DataFrame functions only.

Each document's lines are normalised (lower case, digits and white space collapsed) and hashed; per host (``source``) the
distinct documents that hold a line are counted. A line is boilerplate if at least ``line_docs`` distinct documents of one
host hold it; documents of equal words (case and white space aside) are copies and count once, as copies alone would make
every line of theirs look frequent. Near copies are documents of their own. Boilerplate lines are removed, and a document of whose words less than ``least_left`` remain
is rejected as depleted. All counts cover all documents; the frequent (host, line) groups are aggregated before and after
the shuffle, never gathered.

Defined results: a null text has no words, so it fails the base rule; a null source is a host of its own; repeated rows
get equal results; a null doc_id is kept as null; an empty table gives an empty result; other columns are ignored or
carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_only, durable, fresh, recounted

LINE_DOCS, LEAST_LEFT = 20, 0.2
_SPACES = " \t\n\u000b\f\r"
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))


def _windows(words: Column) -> Column:
    """Hashes of the three-word windows; none for fewer than three words."""
    count = F.size(words) - 2
    hashed = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    return F.when(count > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: equal windows meet by sorting, their places are sorted again and the
    words that each adds are summed up."""

    def places(pairs: Column) -> Column:
        again = lambda e, j: (e.h == F.get(pairs, j - 1).h) | (e.h == F.get(pairs, j + 1).h)
        return F.sort_array(F.transform(F.filter(pairs, lambda e, j: F.coalesce(again(e, j), F.lit(False))), lambda e: e.i))

    def total(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc.n + F.least(F.lit(3), p - acc.last)).alias("n")),
            lambda acc: acc.n,
        )

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # the first of all adds three words as "last" starts at -3
    counted = _bound(_bound(pairs, places), total)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(counted).cast("long")


def line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D0-9]+", " ")))


def _counts(text: Column, words: Column, windows: Column) -> list[Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    return [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _covered(windows).alias("n_repeat_words"),
        F.xxhash64(F.transform(words, F.lower)).alias("content"),
        F.transform(lines, lambda x: F.struct(line_key(x).alias("key"), (F.length(x) - F.length(F.translate(x, " \t", "")) + 1).alias("size"))).alias("lines"),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """The base counts of each document, the hash of its words and the keys and sizes of its lines; one pass over the texts."""
    base = documents_only(docs, F.col("source").cast("string").alias("host")).withColumn("text", F.coalesce("text", F.lit("")))
    split = base.withColumn("words", words_of(F.col("text")))
    cut = split.withColumn("windows", _windows(F.col("words")))
    return durable(cut.select("doc_id", "row_hash", "host", *_counts(F.col("text"), F.col("words"), F.col("windows"))))


def frequent_lines(rows: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """host, key of the boilerplate lines."""
    held = rows.select("host", "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x.key))).alias("key")).distinct()
    return held.groupBy("host", "key").agg(F.count("*").alias("docs")).where(F.col("docs") >= line_docs).select("host", "key")


def verdicts(docs: DataFrame, line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row for each document: the base counts, base_failed, kept, the share of its words left, its removed lines."""
    rows = measured(docs)
    bad = frequent_lines(rows, line_docs)
    held = rows.select("doc_id", "row_hash", "host", F.explode("lines").alias("line")).select("doc_id", "row_hash", "host", F.col("line.key").alias("key"))
    bad = bad.select(F.col("host").alias("bad_host"), F.col("key").alias("bad_key"))
    lost = held.join(bad, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("key") == F.col("bad_key")))
    lost = lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("row_hash").alias("lost_row"), F.col("host").alias("lost_host")).agg(F.collect_set("key").alias("cut_lines"))
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("row_hash") == F.col("lost_row")) & F.col("host").eqNullSafe(F.col("lost_host"))
    out = rows.join(lost, same, "left").drop("lost_id", "lost_row", "lost_host")
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x.size)
    left = F.filter("lines", lambda x: ~F.array_contains(F.col("cut_lines"), x.key))
    share = F.when(F.col("cut_lines").isNull(), F.lit(1.0)).otherwise(size(left) / F.greatest(size(F.col("lines")), F.lit(1)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns({"share_left": share, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("share_left") >= least_left)).drop("lines")


def quality_digest(docs: DataFrame) -> DataFrame:
    return verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """The documents that pass, all columns, without their boilerplate lines; n_chars follows the text."""
    columns = docs.columns
    row, ident, cut, host = (fresh(x, columns) for x in ("row_hash", "ident", "cut_lines", "host"))
    good = verdicts(docs, line_docs, least_left).where("kept").dropDuplicates(["doc_id", "row_hash", "host"])
    good = good.select(F.col("doc_id").alias(ident), F.col("row_hash").alias(row), F.col("host").alias(host), F.col("cut_lines").alias(cut))
    keyed = docs.withColumns({row: F.xxhash64(F.coalesce("text", F.lit(""))), ident: F.col("doc_id").cast("long"), host: F.col("source").cast("string")})
    joined = keyed.join(good, keyed[ident].eqNullSafe(good[ident]) & (keyed[row] == good[row]) & keyed[host].eqNullSafe(good[host]))
    kept_lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col(cut), line_key(x)))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n"))
    return recounted(joined.withColumn("text", text).select(*columns))
