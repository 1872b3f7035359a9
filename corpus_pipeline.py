"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, secret scans, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage works on all that its
predecessor kept.  All but the last return the columns of ``documents``.  ``run`` writes each stage's
rows as Parquet to the shared folder and reads them as the next one's input.

Rows are told apart by id and text (``row_``: whether there is an id, the id, whether there is a text, 128 bits of
its hashes):
rows that share an id, or have none, are judged one by one; rows equal in both stand or fall together, and
the near-duplicate stage leaves one of them.  The last stage adds its columns to those of its input; one whose
name the input has already is called ``mix_<name>``.  Null and empty texts pass all stages until the last, which
takes no words of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagseries.llm.common import batch_bytes, stage, table
from tagseries.llm.decontaminate import decontaminate
from tagseries.llm.jaccard_join import near_duplicates
from tagseries.llm.mixing import mix_sources
from tagseries.llm.secret_scan import secret_scan
from tagseries.llm.toxicity import toxicity


ROW = "row_"


def _free(name: str, names: list[str]) -> str:
    """``name``, with ``mix_`` before it as long as an input column is called so (in either case of letters)."""
    while name.lower() in [n.lower() for n in names]:
        name = f"mix_{name}"
    return name


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its row key.  Rows with an id come before rows without.  All fields of the key may be null, as they
    may in a key read from a table, so that the two are of one type and are joined without a cast."""
    name = ROW
    while any(c.lower().startswith(name) for c in docs.columns):  # an input column of that name stays what it is
        name += "_"
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text").isNull().alias("no_text"),
                   F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    kinds = [T.BooleanType(), docs.select("doc_id").schema[0].dataType, T.BooleanType(), T.LongType(), T.LongType()]
    fields = zip(("no_id", "id", "no_text", "a", "b"), kinds, strict=True)
    out = docs.withColumn(name, key.cast(T.StructType([T.StructField(n, kind) for n, kind in fields])))
    out.row_key = name
    return out


def _by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of the keyed ``docs`` whose key is (semi) or is not (anti) in ``rows(row_)``.  A key is never null, and null
    fields of two keys are equal, so plain equality holds, and what is dealt by key need not be dealt again."""
    name = docs.row_key
    keys = rows.select(F.col(name).alias(name + "key")).distinct()
    return docs.join(keys, docs[name] == keys[name + "key"], how)


def _found(rows: DataFrame) -> DataFrame:
    """``rows`` written once, in Arrow batches bounded by bytes."""
    with batch_bytes(rows.sparkSession, "4m"):
        return stage(rows, "judged")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar's score marks as toxic go."""
    docs = _keyed(docs)
    scored = toxicity(docs, table(spark, sf_dir, "labels"), keep=[docs.row_key])
    return _by_row(docs, _found(scored.where("predicted = 1").select(docs.row_key)), "left_anti").drop(docs.row_key)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    docs = _keyed(docs)
    with batch_bytes(spark, "4m"):
        groups = near_duplicates(docs, docs.row_key)
    first = groups.where(F.col(docs.row_key).eqNullSafe(F.col("component_id")))
    return _by_row(docs, first, "left_semi").dropDuplicates([docs.row_key]).drop(docs.row_key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs = _keyed(docs)
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), docs.row_key)
    return _by_row(docs, _found(found.where("contaminated").select(docs.row_key)), "left_anti").drop(docs.row_key)


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a live-looking credential that one owner alone holds go; widely copied
    examples stay."""
    docs = _keyed(docs)
    found = secret_scan(docs, docs.row_key)
    return _by_row(docs, found.where("n_specific > 0"), "left_anti").drop(docs.row_key)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, target, words taken and first slot.  Rows equal
    in id and text come out once, with the words taken of all of them."""
    names, docs = docs.columns, _keyed(docs)
    key = docs.row_key
    taken = mix_sources(docs, key).where("taken > 0").groupBy(F.col(key).alias(key + "key")).agg(
        F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"),
        F.sum("taken").alias("taken"), F.min("first_slot").alias("first_slot"))
    taken = taken.select(key + "key", *[F.col(c).alias(_free(c, names)) for c in taken.columns[1:]])
    out = docs.join(taken, docs[key].eqNullSafe(taken[key + "key"])).dropDuplicates([key])
    return out.drop(key, key + "key")


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_duplicates),
          ("benchmark decontamination", drop_contaminated), ("secret scans", drop_secrets),
          ("mixing sources to target weights", mix)]

# The first stage learns its terms and coefficients, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES):
        docs = stage(f(spark, docs, sf_dir), f"stage{i}")
    return docs
