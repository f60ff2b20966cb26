"""Quality rules by cross-document line frequency.

A line's normal form has no blanks at its ends, A-Z in lower case and 0 for each digit 0-9. For every host (the
``source`` column) the documents that hold a line are counted, by the 64-bit hash of host and line. A line that more than ``MAX_DOCUMENTS``
documents of the host hold is boilerplate there and is removed from all of them but the one with the smallest id, so that one copy of every
text remains. A document that has less than ``MIN_LEFT`` of its text left (of the characters in words of its different lines) is depleted and rejected.

Base rules need no other document: fewer than ``MIN_WORDS`` words, or more than half of the words in three-word windows that
occur twice or more in the text.

All of it is DataFrame code. For the report only hashes are shuffled, never text: once per (line, document), which is then a written table, once per line, and for the lines above the limit once
more per document. ``without_frequent_lines`` gives the texts without them: the hashes that a document loses are joined to it by its id. Counts are combined before each shuffle, so a line or a host that a third of all documents share is spread.

Defined cases: a NULL or empty text has no words and no lines, and fails the base rules. A NULL source is the host with the
empty name. Rows with one id are one document for the counts, and what it loses counts against each of its rows; a missing id counts as one
document that comes last. Two windows, or two lines, are taken to be equal if their 64-bit hashes are. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..names import unused
from ..staging import stage
from .common import BLANKS, id_key, table

MAX_DOCUMENTS = 10
MIN_LEFT = 0.3
MIN_WORDS = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)


def normal_form(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER + DIGITS, LOWER + "0" * 10)


def base_counts(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the counts of a text column that is never NULL, instead of the text.

    Each step is a projection of its own: the arrays it makes are read at many places of the next one.
    """
    kept = [c for c in rows.columns if c != text]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    split = rows.select(*kept, F.col(text).alias("t"), words(F.col(text)).alias("w"), lines_with_words(F.col(text)).alias("l"))
    first = split.select(
        *kept,
        "w",
        F.size("w").cast("long").alias("n_words"),
        word_chars(F.col("t")).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    )
    window = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])
    starts = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    hashed = first.select(*kept, *counts, F.when(F.col("n_words") >= WINDOW, F.transform(starts, window)).alias("h"))
    # Most texts repeat no window, which the number of different ones tells; only the others are sorted.
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    windows = hashed.select(*kept, *counts, F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).alias("s"))
    same = lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"])
    repeated = windows.select(*kept, *counts, F.sort_array(F.transform(F.filter("s", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])).alias("p"))
    # A window covers its words up to the next repeated window's first one.
    covered = F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return repeated.select(*kept, *counts, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def line_table(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``doc``, ``line`` (the hash) and ``chars`` for each different line of each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    rows = docs.select(id_key(id_col).alias("doc"), host.alias("host"), F.array_distinct(F.transform(lines_with_words(text), normal_form)).alias("lines"))
    each = rows.select("doc", "host", F.explode("lines").alias("line"))
    hashed = each.select("doc", F.xxhash64("host", "line").alias("line"), word_chars(F.col("line")).alias("chars"))
    return hashed.groupBy("line", "doc").agg(F.max("chars").alias("chars"))


def lost_lines(lines: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """The rows of ``lines`` that are removed."""
    frequent = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).where(F.col("n") > max_documents)
    return lines.join(frequent.select("line", "first"), "line").where(F.col("doc") != F.col("first"))


def removed_chars(lines: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """``doc`` and ``removed``: the characters that it loses, for documents that lose any."""
    return lost_lines(lines, max_documents).groupBy("doc").agg(F.sum("chars").alias("removed"))


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """The documents, all rows and columns, without the lines that ``quality`` counts as removed; lines of blanks only stay."""
    own, gone = (unused(n, docs.columns) for n in ("_doc", "_lost"))
    lines = stage(line_table(docs, id_col, text_col, host_col), "lines")
    lost = lost_lines(lines, max_documents).groupBy(F.col("doc").alias(own)).agg(F.collect_set("line").alias(gone))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    left = F.filter(F.split(F.col(text_col).cast("string"), "\n"), lambda line: ~F.array_contains(gone, F.xxhash64(host, normal_form(line))))
    text = F.when(F.col(gone).isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(left, "\n"))
    joined = docs.join(lost, id_key(id_col) == F.col(own), "left")
    return joined.withColumn(text_col, text).select(docs.columns)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row: the counts, ``base_failed``, ``kept`` and ``left_share``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), id_key(id_col).alias("doc"), text.alias("text"))
    different = F.array_distinct(F.transform(lines_with_words(F.col("text")), normal_form))
    own = F.aggregate(F.transform(different, word_chars), F.lit(0).cast("long"), lambda acc, x: acc + x)
    counts = base_counts(rows.withColumn("own_chars", own), "text")
    removed = removed_chars(stage(line_table(docs, id_col, text_col, host_col), "lines"))
    judged = counts.join(removed, "doc", "left").withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "left": F.greatest(F.col("own_chars") - F.coalesce("removed", F.lit(0)), F.lit(0)),
        }
    )
    depleted = F.col("left") < MIN_LEFT * F.col("own_chars")
    share = F.when(F.col("own_chars") > 0, F.col("left") / F.col("own_chars")).otherwise(1.0)
    return judged.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"),
        share.alias("left_share"),
    )


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
blank AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
gram AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS k(k) GROUP BY doc_id),
line AS (SELECT doc_id, host, l FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS l FROM d), blank WHERE trim(l, b) <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM line GROUP BY doc_id),
norm AS (SELECT DISTINCT doc_id, host, translate(trim(l, b), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000') AS k FROM line, blank),
chars AS (SELECT doc_id, host, k, length(regexp_replace(k, '[\x20\x09-\x0D]', '', 'g')) AS c FROM norm),
freq AS (SELECT host, k, min(doc_id) AS first FROM norm GROUP BY host, k HAVING count(DISTINCT doc_id) > 10),
own AS (SELECT doc_id, sum(c) AS own, coalesce(sum(c) FILTER (first <> doc_id), 0) AS gone FROM chars LEFT JOIN freq USING (host, k) GROUP BY doc_id),
r AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(own, 0)::BIGINT AS own, coalesce(gone, 0)::BIGINT AS gone
      FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN own USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT own - gone < 0.3::DOUBLE * own AS kept, CASE WHEN own > 0 THEN (own - gone)::DOUBLE / own ELSE 1.0::DOUBLE END AS left_share
FROM f
"""
