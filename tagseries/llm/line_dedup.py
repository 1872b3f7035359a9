"""Operator 13, line dedup: lines that many documents share stay in one of them.

Lines are exploded, normalised (white space ``[\\x20\\x09-\\x0D]`` stripped at both ends, A-Z lowered) and
hashed to 128 bits; distinct documents are counted per hash; a line whose key has ``min_chars`` code
points or more and is held by ``min_docs`` documents or more leaves every document but the one with the
largest id.  Documents are put together again from the positions of the lines that stay.

Only SQL functions.  What crosses the network: (hash, document) rows twice, the second time to meet
the counts, and the texts once.  Counting is pre-aggregated by (hash, document) and then by hash, so
a frequent line costs one row per task.  The meeting with the counts is split: hashes held by more
than one in ``HOT_SHARE`` of all rows (fewer than ``HOT_SHARE`` of them, at any size) are broadcast, the
others are joined by a shuffle in which none can fill a task.  Lists are per document: never longer
than its lines.

Edge cases: a null or empty text is one empty line, which stays; a row without an id is a document of
its own text and comes before every id, and where only such rows hold a key, all of them lose it;
rows that repeat an id are one document, each with its own lines; an empty table gives an empty
result.  Very long texts are whole.  Only the id and the text are read, so other columns may have any
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagseries.llm.common import LOWER, UPPER, lower_ascii, stage

MIN_CHARS, MIN_DOCS = 20, 3
HOT_SHARE = 8192
BLANK = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, own, body, pos, h1, h2): a row for each line whose key is long enough.  ``own`` tells apart
    documents without an id, ``body`` rows that repeat an id."""
    rows = docs.select("doc", "own", "body", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = lower_ascii(F.btrim("line", F.lit(BLANK)))
    rows = rows.select("doc", "own", "body", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    return rows.select("doc", "own", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_positions(rows: DataFrame, min_docs: int) -> DataFrame:
    """(doc, body, gone): the positions of the lines that leave, per document that loses any."""
    held = rows.groupBy("h1", "h2", "doc", "own").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(
        F.count("*").alias("n_docs"), F.max("doc").alias("keep"))
    held = stage(held.where(F.col("n_docs") >= min_docs), "line-keys")
    often = F.col("n_docs") > rows.select(F.floor(F.count("*") / HOT_SHARE)).scalar()
    hot = held.where(often).select("h1", "h2", F.col("keep").alias("keep_hot"), F.lit(True).alias("is_hot"))
    cold = held.where(~often).select("h1", "h2", F.col("keep").alias("keep_cold"))
    marked = rows.join(F.broadcast(hot), ["h1", "h2"], "left")

    def leaving(x: DataFrame, keep: str) -> DataFrame:
        return x.where(F.col("doc").isNull() | (F.col("doc") != F.col(keep))).select("doc", "body", "pos")

    lost = leaving(marked.where("is_hot"), "keep_hot").unionByName(
        leaving(marked.where("is_hot IS NULL").join(cold, ["h1", "h2"]), "keep_cold"))
    return lost.groupBy("doc", "body").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: id, n_lines, n_dropped and kept_text."""
    text = F.col(text_col)
    src = docs.select(F.col(id_col).alias("doc"), text.alias("text"), F.xxhash64(text).alias("body"))
    src = src.withColumn("own", F.when(F.col("doc").isNull(), F.col("body")))
    rows = stage(line_rows(src, min_chars), "lines")
    gone = dropped_positions(rows, min_docs).select(F.col("doc").alias("doc_"), F.col("body").alias("body_"), "gone")
    whole = src.select("doc", "body", lines_of(F.col("text")).alias("lines"))
    out = whole.join(gone, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("body") == F.col("body_")), "left")
    n = F.size("lines")
    left = F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")))
    out = out.select("doc", "lines", n.alias("n"), left.alias("left"))
    kept = F.when(F.col("left").isNull(), F.col("lines")).otherwise(F.transform("left", lambda i: F.get("lines", i)))
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_lines"),
                      F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.col("n") - F.size("left")).cast("long").alias("n_dropped"),
                      F.array_join(kept, "\n").alias("kept_text"))


def line_sql(min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> str:
    """DuckDB SQL for the digest of ``dedup_lines`` (ids are unique there)."""
    blank = "||".join(f"chr({ord(c)})" for c in BLANK)
    return f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(trim(line, {blank}), '{UPPER}', '{LOWER}') AS key FROM l),
h AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= {min_chars}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
m AS (SELECT k.*, h.key IS NOT NULL AND doc_id <> h.keep AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
