"""Language identification by compression.

Each language has a zstandard dictionary of raw content: snippets of its documents. A text is cut into
pieces, each piece is compressed with every dictionary, and the language with the smallest total wins.
A text whose two best totals are too close is rejected. Texts and snippets are compared as letters in
lower case with one blank between words, so that case, digits and signs do not decide.

The dictionaries are fitted on a bounded sample: ``SNIPPETS`` documents a language, chosen by the hash of
their id, with ``SNIPPET_CHARS`` code points each, from a place in the text that the hash chooses as well. That is 64 KB a language
at most, and more than ``MAX_LANGUAGES`` languages are refused, which bounds what is broadcast. Every
whole text is classified, ``PIECE`` bytes at a time, so that the dictionary counts throughout a long text.

Defined cases: a NULL text, or one without a letter, is ``und`` with score 0. Without any document to
learn from, everything is ``und``. Equal totals go to the language with more documents to learn from,
then to the first by name, and have score 0. Rows with one id are predicted each from its own text; a
missing id is neither held out nor learned from. A NULL language is not learned from. Other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import table

FOLDS = 3
HELD_OUT = 1
SNIPPETS = 256
SNIPPET_CHARS = 400
DICTIONARY = 65_536
MAX_LANGUAGES = 512
PIECE = 1_000
LEVEL = 9
#: The share by which the second best total must exceed the best, else the text is rejected.
MIN_MARGIN = 0.01
UNKNOWN = "und"
ADDED = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fold(id_col: str) -> Column:
    """The fold of a document, which depends on its id alone."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """``(language, dictionary)`` from the documents outside the held-out fold, most frequent language first."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), fold(id_col).alias("fold"))
    rows = rows.where((F.col("fold") != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64("id", F.lit("snippet"))
    slots = rows.groupBy("lang", F.pmod(F.xxhash64("id"), F.lit(SNIPPETS)).alias("slot"))
    chosen = slots.agg(F.min_by("id", F.struct(order, "id")).alias("id"), F.count(F.lit(1)).alias("n"))
    chosen = chosen.limit(MAX_LANGUAGES * SNIPPETS + 1).collect()
    counts: dict[str, int] = {}
    for row in chosen:
        counts[row["lang"]] = counts.get(row["lang"], 0) + row["n"]
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in column {lang_col!r}")
    if not counts:
        return []
    wanted = docs.sparkSession.createDataFrame([(r["lang"], r["id"]) for r in chosen], rows.select("lang", "id").schema)
    start = F.pmod(F.xxhash64("id", F.lit("start")), F.greatest(F.lit(1), F.length("text") - SNIPPET_CHARS + 1)) + 1
    snippet = F.substring("text", start.cast("int"), F.lit(SNIPPET_CHARS)).alias("snippet")
    found = rows.join(F.broadcast(wanted), ["lang", "id"]).select("lang", "id", order.alias("order"), snippet)
    snippets: dict[str, dict] = {lang: {} for lang in counts}
    for row in sorted(found.collect(), key=lambda r: (r["order"], str(r["id"]), r["snippet"])):
        snippets[row["lang"]].setdefault(row["id"], normalised(row["snippet"]))
    ranked = sorted(counts, key=lambda lang: (-counts[lang], lang))
    return [(lang, b" ".join(snippets[lang].values())[:DICTIONARY]) for lang in ranked]


def compressors(dictionaries: list[tuple[str, bytes]]) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, content in dictionaries:
        # Contents under 8 bytes are no dictionary.
        known = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def classify(text: str | None, languages: list[str], tools: list[zstandard.ZstdCompressor]) -> tuple[str, float]:
    """The best language and the margin, as a share, by which the next one needs more bytes."""
    if text is None or not tools or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    content = normalised(text)
    pieces = [content[i : i + PIECE] for i in range(0, len(content), PIECE)] or [b""]
    totals = [sum(len(tool.compress(piece)) for piece in pieces) for tool in tools]
    best = min(range(len(totals)), key=totals.__getitem__)
    others = totals[:best] + totals[best + 1 :]
    return languages[best], (min(others) - totals[best]) / min(others) if others else 1.0


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected``, instead of columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    columns = [c for c in docs.columns if c not in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, languages = compressors(sent.value), [lang for lang, _ in sent.value]
        for rows in batches:
            found = [classify(t.as_py(), languages, tools) for t in rows[text_col]]
            added = [
                pa.array([lang for lang, _ in found], pa.string()),
                pa.array([score for _, score in found], pa.float64()),
                pa.array([lang == UNKNOWN or score < min_margin for lang, score in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([rows[c] for c in columns] + added, names=[*columns, *ADDED])

    kept = docs.select(columns)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(name, kind) for name, kind in ADDED.items())])
    return kept.mapInArrow(run, schema)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, all columns, but for those that the classifier rejects."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, languages = compressors(sent.value), [lang for lang, _ in sent.value]
        for rows in batches:
            found = [classify(t.as_py(), languages, tools) for t in rows[text_col]]
            yield rows.filter(pa.array([lang != UNKNOWN and score >= MIN_MARGIN for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out")
    frame = docs.select("doc_id", held_out, "text")
    return identify(frame, fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
