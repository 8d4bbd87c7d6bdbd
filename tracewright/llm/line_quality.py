"""Document quality: rules on the single text, and lines that many documents of a host
share. DataFrame operations only.

A line is normalised and hashed; on each host the documents that hold it are counted. Lines
above the limit are removed everywhere on that host, and a document of which
too little is left is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.llm.common import SPACE, WORD, few_files, text_or_empty
from tracewright.plans.tables import materialize

_HAS_WORD = f"[^{SPACE}]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class LineLimits:
    """A line is removed on a host where more than ``documents`` distinct texts and more than
    ``share`` of the distinct texts of the host hold it. A document is depleted if less than
    ``left`` of its words stay. Copies of one text count once: finding them is another operator's task."""
    documents: int = 20
    share: float = 0.005
    left: float = 0.2
    min_words: int = 20
    max_repeated: float = 0.3
    window: int = 8


def lines_of(text: Column) -> Column:
    """Lines of a text that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(_HAS_WORD)))


def normal_line(line: Column) -> Column:
    """Lower case, blanks folded, digits as 0."""
    folded = F.regexp_replace(F.regexp_replace(line, f"[{SPACE}]+", " "), "[0-9]", "0")
    return F.lower(F.trim(folded))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def repeated_words(words: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the array.

    The windows are hashed; only an array with equal hashes sorts them, to find the
    repeated positions, and counts what they cover from gap to gap.
    """
    def covered(positions: Column) -> Column:
        steps = F.transform(positions, lambda p, i: F.coalesce(
            F.least(F.get(positions, i + 1) - p, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def repeats(pairs: Column) -> Column:
        marked = F.transform(pairs, lambda p, i: F.when(
            (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"]), p["i"]))
        return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        slow = _let(_let(pairs, repeats), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(slow)

    hashes = F.when(F.size(words) >= window, F.transform(
        F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window))))
    return _let(F.coalesce(hashes, F.array().cast("array<long>")), count)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda variable is not inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_columns(text: Column, limits: LineLimits) -> Column:
    """Struct of the measures of a single text."""
    def measures(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words, limits.window).alias("n_repeat_words"))

    return F.struct(
        _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), measures).alias("of_words"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines_of(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
        .alias("n_dup_lines"))


def measure(docs: DataFrame, limits: LineLimits = LineLimits(), *extra: str) -> DataFrame:
    """doc_id, host, text_hash, the measures, base_failed and the columns ``extra``. A null text
    counts as empty."""
    row = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64(text_or_empty()).alias("text_hash"),
                      *extra, base_columns(text_or_empty(), limits).alias("_m"))
    out = row.select("doc_id", "host", "text_hash", *extra, "_m.of_words.n_words", "_m.of_words.word_chars",
                     "_m.n_symbols", "_m.n_dup_lines", "_m.of_words.n_repeat_words")
    failed = ((F.col("n_words") < limits.min_words)
              | (100 * F.col("n_repeat_words") > round(100 * limits.max_repeated) * F.col("n_words")))
    return out.withColumn("base_failed", failed)


def document_lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: doc_id, host, text_hash, at (its number in the text, from
    0), line (hash of the normalised line), words."""
    rows = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64(text_or_empty()).alias("text_hash"),
                       F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("at", "_s"))
    rows = rows.withColumn("words", F.regexp_count("_s", F.lit(WORD)).cast("long")).filter(F.col("words") > 0)
    return rows.select("doc_id", "host", "text_hash", "at", line_hash(F.col("_s")).alias("line"), "words")


def frequent_lines(lines: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """host, line, n_docs of the lines above the limits. Distinct texts are counted in two
    aggregations, so a line that all documents of a large host share is spread over its texts
    first and is one row per task after that."""
    texts = lines.groupBy("host", "line", "text_hash").agg(F.lit(1).alias("_one"))
    per_line = texts.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = (lines.groupBy("host", "text_hash").agg(F.lit(1).alias("_one"))
             .groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("_host_docs")))
    over = (per_line.filter(F.col("n_docs") > limits.documents)
            .join(hosts, F.col("host").eqNullSafe(F.col("_host"))))
    return over.filter(F.col("n_docs") > limits.share * F.col("_host_docs")).select("host", "line", "n_docs")


def removed_lines(lines: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """doc_id, host, text_hash, removed (numbers of its removed lines), removed_words, for the
    documents that lose lines. ``lines`` should be a stored table. A null host is a host of its own."""
    frequent = frequent_lines(lines, limits).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    hit = lines.join(frequent, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")))
    # a set, so that repeated rows of one document count once
    own = hit.groupBy("doc_id", "host", "text_hash").agg(F.collect_set(F.struct("at", "words")).alias("_s"))
    return own.select("doc_id", "host", "text_hash", F.col("_s.at").alias("removed"),
                      F.aggregate("_s.words", F.lit(0).cast("long"), lambda a, b: a + b).alias("removed_words"))


def _with_lost(rows: DataFrame, docs: DataFrame, limits: LineLimits) -> DataFrame:
    """``rows`` (doc_id, host, text_hash, ...) with removed and removed_words (0 if nothing is removed)."""
    lines = materialize(few_files(document_lines(docs)), "lines")
    lost = removed_lines(lines, limits).select(
        *[F.col(c).alias(f"_{c}") for c in ("doc_id", "host", "text_hash")], "removed", "removed_words")
    same = F.col("text_hash") == F.col("_text_hash")
    for c in ("doc_id", "host"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = rows.join(lost, same, "left").drop("_doc_id", "_host", "_text_hash")
    return joined.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))


def _kept(limits: LineLimits) -> Column:
    left = F.col("n_words") - F.col("removed_words")
    return ~F.col("base_failed") & (left >= limits.left * F.col("n_words"))


def judge(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Every document with its measures, removed_words and kept.

    kept is false if a base rule fails or the document is depleted. Rows that repeat a
    document are judged alike. Null or empty texts have no words and fail; an empty table gives an
    empty result; columns besides doc_id, source and text are ignored.
    """
    rows = _with_lost(measure(docs, limits), docs, limits)
    return few_files(rows.select("doc_id", *MEASURES, "base_failed", "removed_words", _kept(limits).alias("kept")))


def keep_good(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that are kept, with their columns; the frequent lines are cut out of the
    text, and n_chars (if there) is the new length."""
    hidden = docs.select(F.struct("*").alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    keyed = hidden.select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"),
                          text.alias("text"))
    rows = _with_lost(measure(keyed, limits, "_row"), docs, limits).filter(_kept(limits))

    # lines are numbered as they are split here, so blank lines keep their place
    pruned = F.array_join(F.filter(F.split("_row.text", "\n", -1), lambda s, i: ~F.array_contains("removed", i)), "\n")
    new = F.when(F.size("removed") > 0, pruned).otherwise(F.col("_row.text"))
    rows = rows.select("_row", new.alias("_text"))
    out = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[(out[c] if c in out else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
