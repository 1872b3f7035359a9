"""Operator 5, mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slot k of the schedule is the golden-ratio point k * 0x9E3779B1 mod 2^32; the point falls into the interval
of one source on the line of cumulative targets.  Slots are ranked within their source.  Each source is one
stream of words, its documents shuffled by a hash of their id, read again from the first after the last
until its target is met, and cut into as many blocks of equal length (to one word) as the source has slots:
the r-th slot takes block r.  So the number of slots is fixed, the blocks follow the source, and every source
meets its target to half a word at every size, small ones too.  A source that no point falls into has one
slot, after all others, for its whole target.

Offsets in a stream are prefix sums in two steps (per source and hash bucket, then inside a bucket),
so no task holds a whole source; the bucket totals and the inner window share one key.

Edge cases: a null text has size 0; null is one more source, the last; an id that repeats is ordered
by size and text hash; rows without an id are shuffled by their texts; an empty table or one without words
takes nothing.  Very long texts are whole.  Only the id, the text and the source are read, so other columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagseries.llm.common import WORD, stage

WEIGHTS = (5, 2, 1)
MOST = 3          # targets and documents stop at so many times their size
SLOTS = 1 << 18   # slots of the schedule, one more for each source that no point falls into
BUCKETS = 4096    # hash buckets of a source
CELLS = 1 << 14   # cells of the line of cumulative targets
GOLDEN = 2654435769  # 2^32 / golden ratio, odd


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, nul, s, target) from (src, nul, s): shares by weight, filled like water up to ``most * s``.

    A source is full once the level of all sources that are still open reaches ``most * s / w``; in
    the order of that ratio the full ones come first, so running sums give the final level.
    One row per source only.
    """
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("pos", F.row_number().over(Window.orderBy("nul", "src")) - 1).withColumn("w", w)
    t = t.withColumn("cap", F.lit(most) * F.col("s")).withColumn("total", F.sum("s").over(every))
    order = Window.orderBy(F.col("cap").cast("double") / F.col("w"), "pos")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("w").over(onward)
    t = t.withColumn("level", level).withColumn("k", F.row_number().over(order))
    is_open = F.col("w") * F.col("level") <= F.col("cap")
    t = t.withColumn("final", F.min(F.when(is_open, F.struct("k", "level"))).over(every)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("w") * F.col("final")))
    return t.select("src", "nul", "s", "pos", "total", target.alias("target"))


def schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(src, nul, block, slot, n): the slot of each of the n blocks of a source."""
    spark = targets.sparkSession
    two32 = 1 << 32
    t = targets.where("words > 0").withColumn("share", F.floor(F.col("target") / F.col("total") * two32))
    run = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("hi", F.sum("share").over(run)).withColumn("lo", F.col("hi") - F.col("share"))
    point = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN % two32).alias("u"))
    # points meet the intervals by cells of the line: at most CELLS and one more for each source
    width = two32 // CELLS
    cells = t.where("hi > lo").select("src", "nul", "lo", "hi", F.explode(F.sequence(
        F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell"))
    hit = point.withColumn("cell", F.expr(f"u div {width}")).join(cells, "cell").where("u >= lo and u < hi")
    every = t.select("src", "nul", "pos").join(hit.select("src", "nul", "slot"), ["src", "nul"], "left").withColumn(
        "slot", F.coalesce("slot", F.lit(slots) + F.col("pos")))
    of = Window.partitionBy("nul", "src")
    return every.select("src", "nul", (F.row_number().over(of.orderBy("slot")) - 1).cast("long").alias("block"), "slot",
                        F.count("*").over(of).alias("n"))


def shuffle_key(c: Column, text: Column) -> Column:
    """60 bits of the md5 of the id as text; of the text's md5 where there is no id."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.md5(text))), 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, most: int = MOST, slots: int = SLOTS, buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words of it that the mix takes) and
    first_slot (the first slot with a word of it, null if none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                    F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
                    F.col(source_col).isNull().alias("nul"), shuffle_key(F.col(id_col), text).alias("h"),
                    F.xxhash64(text).alias("tie"))
    width = (1 << 60) // buckets
    d = d.withColumn("g", F.expr(f"h div {width}"))
    per_bucket = d.groupBy("src", "nul", "g").agg(F.sum("size").alias("n"))
    targets = source_targets(per_bucket.groupBy("src", "nul").agg(F.sum("n").alias("s")), weights, most)
    targets = targets.withColumn("words", F.round("target").cast("long"))
    plan = stage(schedule(targets, slots), "schedule")  # `slots` rows, and one per source at most
    targets = targets.join(plan.where("block = 0").select("src", "nul", F.col("n").alias("blocks")), ["src", "nul"], "left")
    before = Window.partitionBy("src", "nul").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_bucket.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    offs = offs.join(targets, ["src", "nul"])
    inner = Window.partitionBy("src", "nul", "g").orderBy("h", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("c", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offs, ["src", "nul", "g"])
    d = d.withColumn("c", F.col("c") + F.col("start"))
    # where a document's words lie in the part of the repeated stream that the target takes, lap by lap
    laps = F.sequence(F.lit(0), F.lit(most - 1))
    d = d.withColumn("laps", F.filter(F.transform(laps, lambda i: F.struct(
        (F.col("c") + i * F.col("s")).alias("a"), F.least("words", F.col("c") + i * F.col("s") + F.col("size")).alias("z"))),
        lambda x: x["a"] < x["z"]))
    d = d.withColumn("rid", F.struct("src", "nul", "c", "size", "tie", "id"))
    d = d.withColumn("lap", F.explode_outer("laps"))
    # block r holds the words from r * words div blocks on; the block of word p is ((p + 1) * blocks - 1) div words
    span = F.when(F.col("lap").isNotNull(), F.sequence(F.expr("((lap.a + 1) * blocks - 1) div words"), F.expr("(lap.z * blocks - 1) div words")))
    d = d.withColumn("block", F.explode_outer(span))
    # the schedule has a fixed number of rows and one per source at most; a large number of sources is not broadcast
    d = d.join(plan.select("src", "nul", "block", "slot"), ["src", "nul", "block"], "left")
    part = F.expr("least(lap.z, (block + 1) * words div blocks) - greatest(lap.a, block * words div blocks)")
    taken = F.coalesce(F.sum(part), F.lit(0))
    # empty documents of one id share a place in the stream; the count keeps each of them a row
    out = d.groupBy("rid", "s", "target").agg(taken.alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n"))
    out = out.withColumn("copy", F.explode(F.when(F.col("rid.size") > 0, F.array(F.lit(1))).otherwise(
        F.sequence(F.lit(1), F.col("n").cast("int")))))
    return out.select(F.col("rid.id").alias(id_col), F.col("rid.size").alias("size"), F.col("s").alias("source_size"),
                      "target", F.col("taken").cast("long").alias("taken"), "first_slot")


def mixing_sql() -> str:
    """DuckDB SQL for the same rows over the view ``documents``."""
    return f"""
    with d as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size,
               coalesce(source, '') src, source is null nul,
               ('0x' || substr(md5(coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 15))::bigint h, hash(text) tie from documents),
    p as (select src, nul, sum(size)::bigint s from d group by all),
    q as (select *, row_number() over (order by nul, src) - 1 pos, sum(s) over ()::bigint total from p),
    w as (select *, [5, 2, 1][(pos % 3)::int + 1] w, 3 * s cap from q),
    l as (select *, (total - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::double
               / (sum(w) over (o rows between current row and unbounded following))::double lev, row_number() over o k
          from w window o as (order by cap::double / w, pos)),
    f as (select *, (select arg_min(lev, k) from l where w * lev <= cap) fin from l),
    t as (select src, nul, s, pos, total, case when fin is null then cap::double else least(cap::double, w * fin) end target,
          round(target)::bigint words from f),
    iv as (select *, sum(sh) over (order by pos)::bigint hi from (select *, floor(target / total * 4294967296)::bigint sh
           from t where words > 0)),
    hit as (select src, nul, k slot from (select range k, (range * {GOLDEN}) % 4294967296 u from range({SLOTS})) x
            join iv on u >= hi - sh and u < hi),
    sl as (select src, nul, coalesce(slot, {SLOTS} + pos) slot from iv left join hit using (src, nul)),
    pl as (select src, nul, slot, row_number() over (partition by nul, src order by slot) - 1 block,
           count(*) over (partition by nul, src) blocks from sl),
    n as (select distinct src, nul, blocks from pl),
    c as (select d.*, t.s, t.target, t.words, blocks, coalesce(sum(size) over (partition by d.src, d.nul order by h, doc_id, size, tie
          rows between unbounded preceding and 1 preceding), 0)::bigint c, row_number() over () rid
          from d join t using (src, nul) left join n using (src, nul)),
    la as (select *, c + lap * s a, least(words, c + lap * s + size) z from c, range(3) x(lap)),
    e as (select *, unnest(range(((a + 1) * blocks - 1) // words, (z * blocks - 1) // words + 1)) block from la where a < z),
    g as (select rid, sum(least(z, (block + 1) * words // e.blocks) - greatest(a, block * words // e.blocks))::bigint taken,
          min(slot) first_slot from e join pl using (src, nul, block) group by 1)
    select doc_id, size, s source_size, target, coalesce(taken, 0)::bigint taken, first_slot from c left join g using (rid)"""
