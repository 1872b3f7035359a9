"""Operator 1, secret scans by corpus-wide ownership frequency (DataFrame functions only).

Every text is scanned once for candidate credentials; spans, the value's hash, its repository and
owner are written to the shared folder.  Each value hash is then counted over distinct owners,
distinct repositories and distinct texts.  A value is a widely copied example if more than
``max_owners`` owners hold it in more than ``max_owners`` repositories and as many different texts (so
exact copies of one document count once; a text that is nothing but the value counts by its repository), or if more than ``max_repos`` repositories with as many
different texts hold it, whoever owns them.  Every other value is specific.  A generic random-looking string (kind
``live``) becomes a span only if it looks live and is specific.  Spans of the fixed rules stay whatever
their frequency is.

Counting is by distinct (hash, owner), (hash, repository) and (hash, text) rows, so a value that a third
of all rows hold is spread over all tasks; the following counts are summed map-side.

Edge cases: a null text is empty; a null owner is one owner of its own; a null repository likewise;
equal rows are scanned alike and each gives a row; an empty table gives an empty result.  A very long text is one
row, scanned whole.  Only the id, text, owner and repository columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagseries.llm.common import stage

# Kinds in their order, pattern, group that is the value, least length of the value.
# The counted repeats of ``access`` and ``hex`` fold the least length into the pattern; both match
# whole runs, so no shorter match can hide a longer one.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
GENERIC = ("live", r"[A-Za-z0-9+/_-]{32,}", 0, 32)
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|xxxx|(.)\1{7,}"
# Counting runs and repeats: chance puts short ones into random values, so they must be most of the value.
FILLER = r"0?1234(?:5(?:6(?:7(?:8(?:90?)?)?)?)?)?|(.)\1{3,}"
SPAN = "array<struct<s:bigint,k:int,e:bigint,kind:string,h:string,live:boolean>>"
BLOCK = 256


def live_looking(v: Column) -> Column:
    """Ten different characters, or one in three of a value under 30 characters; no placeholder word or
    long repeat, and at most half of it counting runs and short repeats."""
    varied = F.size(F.array_distinct(F.split(v, ""))) * 3 >= F.least(F.lit(30), F.length(v))
    filled = F.length(v) - F.length(F.regexp_replace(v, FILLER, ""))
    return varied & ~v.rlike(PLACEHOLDER) & (filled * 2 <= F.length(v))


def _located(gaps: str, lens: str) -> Column:
    """Start offsets of matches from the lengths between and of them.  Running sums are kept in
    blocks, so a text with n matches costs n * BLOCK steps, not n * n."""
    before = F.expr(f"""
        aggregate(zip_with({gaps}_blocks, {lens}_blocks,
                           (g, n) -> aggregate(concat(g, n), 0L, (a, x) -> a + x)),
                  array(0L), (a, t) -> array_append(a, element_at(a, -1) + t))""")
    parts = F.arrays_zip(F.col(f"{gaps}_blocks").alias("g"), F.col(f"{lens}_blocks").alias("n"),
                         F.slice(before, 1, F.size(f"{gaps}_blocks")).alias("o"))
    return F.flatten(F.transform(parts, lambda b: F.aggregate(
        F.arrays_zip(b["g"].alias("g"), b["n"].alias("n")),
        F.struct(b["o"].alias("p"), F.array().cast("array<bigint>").alias("r")),
        lambda a, x: F.struct((a["p"] + x["g"] + x["n"]).alias("p"), F.array_append(a["r"], a["p"] + x["g"]).alias("r")),
        lambda a: a["r"])))


def _blocks(c: str) -> Column:
    return F.expr(f"transform(sequence(0, greatest(size({c}) - 1, 0) div {BLOCK}), i -> slice({c}, i * {BLOCK} + 1, {BLOCK}))")


def _spans(df: DataFrame, i: int, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """Adds column ``kind``: the spans of one rule over ``text_``, leftmost and non-overlapping."""
    hit, p, none = F.col("text_").rlike(pattern), F.lit(pattern), F.array().cast("array<string>")
    df = df.withColumns({
        "gap": F.when(hit, F.split("text_", pattern, -1)).otherwise(none),
        "hit": F.when(hit, F.regexp_extract_all("text_", p, F.lit(0))).otherwise(none),
        "val": F.when(hit, F.regexp_extract_all("text_", p, F.lit(group))).otherwise(none)})
    df = df.withColumns({
        "gaps": F.expr("transform(slice(gap, 1, size(hit)), x -> cast(length(x) as bigint))"),
        "lens": F.transform("hit", lambda x: F.length(x).cast("bigint"))})
    df = df.withColumns({"gaps_blocks": _blocks("gaps"), "lens_blocks": _blocks("lens")})
    df = df.withColumn("at", _located("gaps", "lens"))
    spans = F.transform(F.arrays_zip("at", "lens", "val"), lambda x: F.struct(
        x["at"].alias("s"), F.lit(i).alias("k"), (x["at"] + x["lens"]).alias("e"), F.lit(kind).alias("kind"),
        F.when(F.length(x["val"]) >= least, F.sha2(x["val"], 256)).alias("h"), live_looking(x["val"]).alias("live")))
    out = F.filter(spans, lambda x: x["h"].isNotNull()).cast(SPAN)
    return df.withColumn(kind, out).drop("gap", "hit", "val", "gaps", "lens", "gaps_blocks", "lens_blocks", "at")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                repo_col: str | None = None, max_owners: int = 2, max_repos: int = 100) -> DataFrame:
    """One row per input row: id, counts per fixed rule, digest of the fixed spans, all spans,
    numbers of live specific, of widely copied and of added values, the most owners and the most
    repositories of one of its values.

    ``repo_col`` defaults to the id: each document is its own repository.
    """
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"),
                     F.col(owner_col).cast("string").alias("owner"),
                     F.col(repo_col or id_col).cast("string").alias("repo"))
    df = df.withColumn("body", F.xxhash64("text_")).withColumn("size", F.length("text_"))
    for i, rule in enumerate((*RULES, GENERIC)):
        df = _spans(df, i, *rule)
    base = F.concat(*[F.col(k) for k, *_ in RULES])
    mixed = lambda x: x["live"]
    free = F.filter("live", lambda x: mixed(x) & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    found = stage(df.select(F.monotonically_increasing_id().alias("rid"), "id", "owner", "repo", "body", "size",
                            base.alias("base"), free.alias("free")), "secrets")
    rows = found.select("rid", "owner", "repo", "body", "size", F.explode(F.concat("base", "free")).alias("c")).select(
        "rid", "owner", "repo", F.when((F.col("c.s") == 0) & (F.col("c.e") == F.col("size")), F.concat(F.lit("r"), "repo")).otherwise(
            F.col("body").cast("string")).alias("body"), F.col("c.h").alias("h"), F.col("c.k").alias("k"), F.col("c.s").alias("s"),
        F.col("c.live").alias("live"))
    held = rows.select("h", F.explode(F.array(
        F.struct(F.lit(0).alias("what"), F.col("owner").alias("x")), F.struct(F.lit(1).alias("what"), F.col("repo").alias("x")),
        F.struct(F.lit(2).alias("what"), F.col("body").alias("x")))).alias("t")).distinct()
    number = lambda i: F.sum((F.col("t.what") == i).cast("long"))
    freq = held.groupBy("h").agg(number(0).alias("owners"), number(1).alias("repos"), number(2).alias("bodies"))
    apart = F.least("repos", "bodies")
    freq = freq.withColumn("copied", ((F.col("owners") > max_owners) & (apart > max_owners)) | (apart > max_repos))
    judged = rows.join(freq, "h").groupBy("rid").agg(
        F.sum((F.col("live") & ~F.col("copied")).cast("long")).alias("n_specific"),
        F.sum(F.col("copied").cast("long")).alias("n_copied"),
        F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"),
        F.collect_list(F.when((F.col("k") == len(RULES)) & ~F.col("copied"), F.col("s"))).alias("own"))
    out = found.join(judged, "rid", "left")
    own = F.coalesce("own", F.array().cast("array<bigint>"))
    kept = F.filter("free", lambda x: F.array_contains(own, x["s"]))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        F.col("id").alias(id_col), *[count(k).alias(f"n_{k}") for k, *_ in RULES],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", kept)).alias("spans"),
        F.coalesce("n_specific", F.lit(0)).alias("n_specific"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.size(kept).cast("long").alias("n_live"),
        F.coalesce("most_owners", F.lit(0)).alias("most_owners"), F.coalesce("most_repos", F.lit(0)).alias("most_repos"))
