"""Token counts by an exact histogram of encoded lengths.

Every document is encoded and only its length is kept; lengths are counted per batch of rows and then over all
of them. Sums over the longer lengths (suffix sums) make the histogram answer, for any context limit and without
another look at the documents: how many documents and tokens are there, how many tokens stay if documents are
cut at the limit, and which length a share of the documents does not exceed.

The histogram has a row per length that occurs, far fewer than documents. Its sums are made in two levels, over
ranges of ``RANGE`` lengths and within each, so that no window holds more than ``RANGE`` rows or the ranges.

Defined cases: a NULL or empty text has length 0. Every row counts, also repeated ones. Ids and other columns
are not read. An empty table gives an empty histogram, of which all answers are NULL or 0. Strings that look like
special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..staging import stage
from .common import map_batches, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that cuts a text for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANGE = 1_000

# Very long runs of blanks are beyond the library's matcher. The pattern takes such a run but for its last character.
_RUN = re.compile("([ \t\n\x0b\x0c\r\x85\xa0  -     　]{500,})")


@cache
def _encodings(ranks: bytes) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """The encoding, and one that takes a text as one piece."""
    known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tuple(tiktoken.Encoding(name, pat_str=p, mergeable_ranks=known, special_tokens={}) for name, p in (("text", PATTERN), ("piece", r"[\s\S]+")))


def count_tokens(text: str | None, ranks: bytes) -> int:
    if not text:
        return 0
    cut, piece = _encodings(ranks)
    if len(text) < 500 or not _RUN.search(text):
        return len(cut.encode_ordinary(text))
    parts, total = _RUN.split(text), 0
    for i, part in enumerate(parts):
        if i % 2 and parts[i + 1]:
            total += len(piece.encode_ordinary(part[:-1]))
            parts[i + 1] = part[-1] + parts[i + 1]
        elif part:
            total += len((piece if i % 2 else cut).encode_ordinary(part))
    return total


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def histogram(docs: DataFrame, text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """``n_tokens`` and ``n_docs`` for each encoded length."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([count_tokens(t.as_py(), ranks.value) for t in rows["text"]], np.int64)
        lengths, docs_of = np.unique(found, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(docs_of.astype(np.int64))], names=["n_tokens", "n_docs"])

    frame = docs.select(F.col(text_col).cast("string").alias("text"))
    return map_batches(frame, count, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_sums(lengths: DataFrame) -> DataFrame:
    """The histogram with, per length: documents and tokens in documents that are longer, and of all documents."""
    lengths = lengths.withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    own = [F.col("n_docs").alias("d"), (F.col("n_docs") * F.col("n_tokens")).alias("t")]
    ranges = lengths.select("range", *own).groupBy("range").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = ranges.select(
        "range",
        *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"],
    )
    longer = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    inner = lengths.select("range", "n_tokens", "n_docs", *[F.coalesce(F.sum(c).over(longer), F.lit(0)) for c in (F.col("n_docs"), F.col("n_docs") * F.col("n_tokens"))])
    inner = inner.toDF("range", "n_tokens", "n_docs", "d_longer", "t_longer")
    return inner.join(ranges, "range").select(
        "n_tokens",
        "n_docs",
        (F.col("d_longer") + F.col("d_later")).alias("docs_longer"),
        (F.col("t_longer") + F.col("t_later")).alias("tokens_longer"),
        F.col("d_all").alias("docs_total"),
        F.col("t_all").alias("tokens_total"),
    )


def truncated(lengths: DataFrame) -> DataFrame:
    """With, per length taken as a context limit: the tokens that stay when longer documents are cut, and the share of documents within."""
    cut = F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    within = (F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")
    return with_sums(lengths).withColumns({"tokens_truncated": cut, "share_within": within})


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """One row per context limit, any limit: documents, tokens, documents that are longer, tokens after cutting at the limit.

    The answer is in the suffix sums of the smallest length above the limit; without one, nothing is longer.
    """
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long").distinct()
    above = sums.select(
        "n_tokens",
        F.struct("n_tokens", F.col("docs_longer") + F.col("n_docs"), F.col("tokens_longer") + F.col("n_docs") * F.col("n_tokens")).alias("at"),
        F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit"),
    ).where(F.col("n_tokens") > F.col("limit"))
    longer = above.groupBy("limit").agg(F.min("at").alias("at")).select("limit", F.col("at.col2").alias("docs_longer"), F.col("at.col3").alias("t"))
    totals = sums.agg(F.max("docs_total").alias("docs"), F.max("tokens_total").alias("tokens"))
    found = asked.join(longer, "limit", "left").join(F.broadcast(totals)).na.fill(0)
    return found.select("limit", "docs", "tokens", "docs_longer", (F.col("tokens") - F.col("t") + F.col("docs_longer") * F.col("limit")).alias("tokens_truncated"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """One row per share (0 to 1): the smallest length that this share of the documents does not exceed."""
    spark = sums.sparkSession
    reached = sums.select("n_tokens", ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("within"))
    asked = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    found = reached.select("n_tokens", "within", asked).where(F.col("within") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
    return spark.createDataFrame([(float(x),) for x in shares], "share double").distinct().join(found, "share", "left")


def op4_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(stage(histogram(table(spark, sf_dir, "documents")), "length-histogram"))
