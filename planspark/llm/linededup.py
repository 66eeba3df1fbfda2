"""Lines that many documents share go from all of them but one.

Every text is split into lines, each line becomes a normalised key, and keys are told apart by a 128-bit digest. Distinct
documents are counted per digest, the lines of digests over the threshold are dropped except in one document, and every text is put together
again from its remaining lines by position. Only digests, ids and positions are shuffled before the last join, which
brings a document the positions it loses. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import settle, tidy

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased. Lines of ASCII alone take the faster function."""
    key = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def _lines(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def shared_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``d, t, at``: positions (from 0) of the lines that a document loses.

    ``d`` is the id and ``t`` a hash of the text, so rows with one id and different texts are told apart; equal rows lose
    the same lines. A key's lines stay in the largest id that holds it. Rows without an id count as one document, smaller
    than all others.
    """
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(_lines(F.col(text))).alias("at", "line"))
    keyed = rows.select("d", "t", "at", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    lines = settle(keyed.select("d", "t", "at", F.unhex(F.md5("key")).alias("h")))
    # Distinct documents first, combined before the shuffle: a line in a third of all rows is no hot group.
    holders = lines.groupBy("h", "d").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("n"), F.max("d").alias("last"))
    # Stored, so that the join reads two plain inputs and a hot line's rows can be split over tasks.
    often = settle(holders.filter(F.col("n") >= min_docs).select("h", "last"))
    hit = lines.join(often, "h").filter(~F.col("d").eqNullSafe(F.col("last")))
    return hit.groupBy("d", "t").agg(F.array_sort(F.collect_set("at")).alias("at"))


def _flags(at: str, n: Column) -> Column:
    """True at the ascending positions of the array column ``at``, false between them, and a last true after ``n`` lines.

    One pass over the positions: a test of every line against an array would cost lines times positions.
    """
    def until(p: Column, k: Column) -> Column:
        before = F.when(k == 0, -1).otherwise(F.get(F.col(at), k - 1))
        return F.concat(F.array_repeat(F.lit(False), p - before - 1), F.array(F.lit(True)))
    return F.flatten(F.transform(F.concat(F.col(at), F.array(n)), until))


@tidy
def without_shared_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc``, a struct of all columns, with ``kept`` (the text that is left), ``n_lines`` and ``n_dropped``.

    A text is split at every line feed; its key of a line has no white space ``[\\x20\\x09-\\x0D]`` at either end and A-Z
    lower-cased. Keys of at least ``min_chars`` code points found in at least ``min_docs`` distinct ids lose all their
    lines, repeated ones too, except in the largest of these ids. Rows that repeat an id are one document; rows without
    an id are one document, below all others. Null texts stay null; null and empty texts count as one empty line. A text that loses all its
    lines is empty. Texts may be of any length; extra columns stay inside ``doc``. An empty table gives no rows.
    """
    lost = settle(shared_lines(docs, text, doc_id, min_chars, min_docs))
    keyed = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    lost = lost.select(F.col("d").alias("d2"), F.col("t").alias("t2"), "at")
    joined = keyed.join(lost, keyed["d"].eqNullSafe(lost["d2"]) & (keyed["t"] == lost["t2"]), "left")
    lines = _lines(F.col("text"))
    kept = F.filter(F.arrays_zip(lines.alias("line"), _flags("at", F.size(lines)).alias("gone")), lambda x: ~x["gone"])
    return joined.select(
        "doc", F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(kept["line"], "\n")).alias("kept"),
        F.size(lines).cast("long").alias("n_lines"), F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long").alias("n_dropped"))
