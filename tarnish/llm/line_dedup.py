"""Operator 10: lines that repeat across documents are dropped everywhere but in one document.

Only DataFrame functions: lines are exploded with their position, hashed, counted per document and
put together again by position. Texts are never exploded into a shuffle; only hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.llm.text import without

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("n_lines", "n_dropped", "kept_text")


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # `lower` is the fast way and does the same where every character is ASCII.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, with_text: bool = True) -> DataFrame:
    """`docs` with `n_lines`, `n_dropped` and `kept_text`.

    A key of at least `min_chars` code points that occurs in at least `min_docs` different documents
    loses all its lines, except in the document with the largest id that holds it. A document is a
    `doc_id`: rows with one id count once, rows without an id are one document below all others. A
    null or empty text is one empty line. Rows that are repeated keep the same lines each. An empty
    table gives an empty table. Columns named like the added ones are replaced.
    """
    rows = without(docs, ADDED)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    identity = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines).alias("pos", "line"))
    # Two chained 64-bit hashes: a collision is out of reach for any corpus.
    keyed = (
        identity.withColumn("key", line_key(F.col("line")))
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    # Counted in two steps (key and document, then key), each with partial sums before its shuffle, so
    # that a line of a third of all documents meets no single task.
    frequent = (
        keyed.groupBy("h1", "h2")
        .agg(F.count_distinct(F.struct("doc_id")).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    lost = (
        keyed.join(frequent, ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("lost_doc"), F.col("text_hash").alias("lost_hash"))
        .agg(F.collect_set("pos").alias("lost"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("lost_doc")) & (F.xxhash64("text") == F.col("lost_hash"))
    # Positions as a set difference and a look-up by position: linear in the lines of a document.
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost")), lambda i: F.get(lines, i))
    text = F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    out = rows.join(lost, same, "left").select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        text.alias("kept_text"),
    )
    return out if with_text else out.drop("text")
