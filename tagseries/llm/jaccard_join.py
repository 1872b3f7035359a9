"""Operator 2, near duplicates by a metric-space join on the Jaccard distance.

A document is the set of its distinct word shingles; equal sets are one class, and classes are what
is joined.  Two metrics prune, both by the triangle inequality: the Jaccard distance of the sets, and
the Hamming distance of their parity bitmaps (2048 bits; bit i is the parity of the shingles that hash
to i), which never exceeds the size of the symmetric difference, itself at most (|a| + |b|) / 9 for a
link at 0.8.

1. Pivot regions.  With few pivots nearly all texts are at distance 1 from every pivot, and windows
   would copy everything everywhere.  So the first regions are those of one-shingle pivots: a set lies
   in the region of each shingle of its prefix (its first n - ceil(0.8 n) + 1 shingles, rare ones
   first), and sets that link share such a shingle.  The smallest member of a region is its leader,
   and regions of one leader are one region.
2. Members that no other member of their region can link with, by size and bitmap, leave.  The others
   are compared exactly with their home, the nearest of a few pivots drawn from their regions; linked
   ones are one component, and a region that lies in one component is finished, without any of its
   pairs.  A few rounds draw new pivots.  Each round makes at most one comparison per set.
3. A region with more than ``leaf`` members that is not finished is cut into Voronoi cells of sampled
   pivots.  A member goes to its nearest pivot, and also to each pivot that is farther by at most its
   window, twice the largest difference a link allows: where its links' homes may be.  Finished cells
   leave, large ones are cut again.  Sets far apart from all pivots would go to every cell: a region whose
   cells would hold more than ``SPREAD`` times its rows is not cut.
4. In the leaves, pairs of different components that pass size and bitmap are compared exactly; a region
   that cutting does not shrink is joined in blocks of rows, one task per pair of blocks.  While there are
   many pairs to a member (a large cluster with members that are not linked yet), the nearest pair of each member
   is compared first, and pairs that are then of one component leave.

No pair is dropped but by a bound, so the components are exact (up to 64-bit shingle hashes).  The
shingle order needs frequencies: a sketch of 2^18 counters over all texts, of fixed size, is broadcast;
any order is exact, a good one keeps regions small.  Staged tables and shuffles go as soon as nothing reads them.

Edge cases: null texts and texts without words have an empty set, size 0, and are linked with nothing;
fewer words than a shingle are one shingle; repeated rows are one class; rows with a null id are
joined like others and named by the smallest non-null id; an empty table gives an empty result.  A very long
text is one set, built in one task.  Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagseries.llm.common import batch_bytes, components, drop_shuffles, mix64, stage, texts_of, unstage

WORDS, LINK = 5, (80, 100)
SKETCH, BITS, FILTER = 1 << 18, 2048, 1 << 23
FINE, LARGE = 16384, 1024  # sets above LARGE shingles have a second bitmap of FINE bits
LEAF, SMALL, PIVOTS, DEPTH, SPREAD, MANY = 2048, 64, 16, 4, 2, 8
ROUNDS, NEAR_PIVOTS, NEAR_SIZE = 3, 4, 8
SALTS = 64
_mult = mix64(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), len(ws))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    n = len(ws) - words + 1
    total = h[:n] * _mult[0]
    for j in range(1, words):
        total += h[j:j + n] * _mult[j]
    return np.unique(mix64(total))


def bitmap(s: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def bitmaps(s: np.ndarray) -> tuple[bytes, bytes]:
    """The bitmap that all sets have, and the finer one of large sets (else empty)."""
    return bitmap(s, BITS) if len(s) else b"", bitmap(s, FINE) if len(s) > LARGE else b""


def fine_close(n1, n2, x: bytes, y: bytes) -> bool:
    """Whether the finer bitmaps allow a link, where both sets have one."""
    if not x or not y:
        return True
    return bool(close(n1, n2, int(_hamming(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))))


def bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(46)).astype(np.int64)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def short_key(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def close(n1, n2, apart) -> np.ndarray:
    """Whether sets of these sizes may link when at least ``apart`` shingles are in one set only."""
    a, b = LINK
    inter2 = n1 + n2 - apart  # twice the intersection, at most
    return b * inter2 >= a * (2 * (n1 + n2) - inter2)


def _bits(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint64).reshape(len(col), BITS // 64)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """Per document: id, node (set digest), n, bits; and rows of the sketch (bucket, count)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        counts = np.zeros(SKETCH, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            sets = [shingle_set(t, words) for t in texts_of(b.column(1))]
            counts += np.bincount(np.concatenate([bucket(s) for s in sets]), minlength=SKETCH)
            none, maps = pa.nulls(b.num_rows, pa.int64()), [bitmaps(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 *(pa.array([m[i] for m in maps], pa.binary()) for i in (0, 1)), none, none], names)
        at = np.flatnonzero(counts)
        if len(at):
            nulls = [pa.nulls(len(at), t) for t in (id_type, pa.binary(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(at), pa.array(counts[at])], names)

    id_type = to_arrow_type(docs.schema["id"].dataType)
    names = ["id", "node", "n", "bits", "fine", "bucket", "count"]
    return docs.mapInArrow(run, f"id {kind}, node binary, n bigint, bits binary, fine binary, bucket bigint, count bigint")


def _prefixes(docs: DataFrame, words: int, order: np.ndarray) -> DataFrame:
    """(s, salt, node) for the prefix of each document's set.  Shingles that the sketch says are
    frequent get one of SALTS salts by node, all others salt 0."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    limit = max(1000, 8 * int(order.mean()) + 1)

    def run(batches):
        count = shared.value
        for b in batches:
            out = [[], [], []]
            for t in texts_of(b.column(0)):
                s = shingle_set(t, words)
                if len(s):
                    c = count[bucket(s)]
                    k = len(s) - -(-LINK[0] * len(s) // LINK[1]) + 1
                    first = np.lexsort((s, c))[:k]
                    node = short_key(digest(s))
                    out[0].append(s[first].view(np.int64))
                    out[1].append(np.where(c[first] > limit, node % SALTS + 1, 0).astype(np.int32))
                    out[2].append(np.full(k, node, np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["s", "salt", "node"])

    return docs.select("text").mapInArrow(run, "s bigint, salt int, node bigint")


def _members(prefixes: DataFrame) -> DataFrame:
    """(lead, node), staged: the members of each leader's region, short keys, leaders included.

    Prefixes are shuffled once, by shingle and salt, and read in order; the leaders of a frequent
    shingle's salts then agree on the smallest, map-side."""
    first = F.first("node").over(Window.partitionBy("s", "salt").orderBy("node"))
    led = stage(prefixes.withColumn("lead", first).where("salt > 0 or lead <> node"), "led")
    hot = led.where("salt > 0").select("s", "node").distinct()
    top = led.where("salt > 0").groupBy("s").agg(F.min("lead").alias("lead"))
    pairs = led.where("salt = 0").select("lead", "node").unionByName(hot.join(top, "s").select("lead", "node"))
    pairs = pairs.where("lead <> node").distinct()
    out = stage(pairs.unionByName(pairs.select("lead", F.col("lead").alias("node")).distinct()), "members")
    unstage(led)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the classes in ``wanted(node, id)``.  A filter of fixed size says which
    documents may be wanted; the join by node is exact."""
    spot = F.pmod(F.xxhash64("id"), F.lit(FILTER))
    words_on = wanted.select((spot / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(id), {FILTER}), 64) as int))").alias("b"))
    rows = words_on.groupBy("w").agg(F.bit_or("b").alias("b")).collect()  # at most FILTER / 64 rows
    table = np.zeros(FILTER // 64, np.int64)
    for r in rows:
        table[r.w] = r.b
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    def run(batches):
        on = np.unpackbits(shared.value, bitorder="little")
        for b in batches:
            use = np.flatnonzero(on[b.column(0).to_numpy()])
            if len(use):
                sets = [shingle_set(t, words) for t in texts_of(b.column(1).take(pa.array(use)))]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    found = docs.select(spot.alias("spot"), "text").mapInArrow(run, "node binary, shingles binary")
    return found.groupBy("node").agg(F.min("shingles").alias("shingles"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose sets link, staged; only the sets of these pairs' nodes are made again."""
    pairs = stage(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stage(classes.select("node", "id").join(nodes, "node", "left_semi"), "wanted")
    sets = _sets(docs, wanted, words)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(LINK[1] * inter >= LINK[0] * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    out = stage(both.mapInArrow(run, "a binary, b binary"), "links")
    unstage(pairs)
    unstage(wanted)
    return out


def _with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Adds the root of each node's component, and leaves out regions that lie in one component."""
    rows = rows.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rows.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
    return rows.join(split.where("lo <> hi").select("region", "size"), "region")


def _pivots(rows: DataFrame, level: int, count: int) -> DataFrame:
    """(region, pivots): up to ``count`` members of each region, drawn by hash, map-side."""
    pick = F.xxhash64("node", F.lit(level))
    pivots = rows.groupBy("region", F.pmod(pick, F.lit(count)).alias("j")).agg(
        F.min(F.struct("node", "n", "bits", "fine", "root")).alias("p"))
    return pivots.groupBy("region").agg(F.array_sort(F.collect_list("p")).alias("pivots"))


def _home_pairs(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """(a, b): for each node, over all its regions, the nearest pivot of another component that size
    and bitmaps allow as a link; at most one pair per node."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            node, n, root, bits, fine, ps = (b.column(i).to_pylist() for i in range(6))
            for i, many in enumerate(ps):
                many = [p for p in many if p["root"] != root[i]]
                if many:
                    size = np.array([p["n"] for p in many])
                    d = _hamming(_bits([bits[i]]), _bits([p["bits"] for p in many]))
                    ok = close(n[i], size, d)
                    j = int(np.where(ok, d / (size + n[i]), np.inf).argmin())
                    if ok[j] and fine_close(n[i], size[j], fine[i], many[j]["fine"]):
                        out.append((node[i], float(d[j] / (size[j] + n[i])), many[j]["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.float64()),
                                              pa.array([x[2] for x in out], pa.binary())], ["a", "d", "b"])

    near = rows.join(pivots, "region").select("node", "n", "root", "bits", "fine", "pivots").mapInArrow(
        run, "a binary, d double, b binary")
    return near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select("a", F.col("x.b").alias("b"))


def _cells(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Voronoi cells of sampled pivots: (region, node, n, bits, fine), one row per cell of a node; and the rows of the
    regions that they would not shrink, as they are."""
    names = rows.columns
    joined = rows.join(_pivots(rows, level, PIVOTS), "region").select(*names, "pivots")
    at_region, at_n, at_bits = (names.index(c) for c in ("region", "n", "bits"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            region, n, bits, ps = (b.column(i).to_pylist() for i in (at_region, at_n, at_bits, -1))
            out = []
            for i, many in enumerate(ps):
                d = _hamming(_bits([bits[i]]), _bits([p["bits"] for p in many]))
                # a link differs in at most (n + 5/4 n) / 9 = n / 4 shingles, so a link's home lies
                # at most twice that farther than this home
                out.append([xxhash.xxh3_64_intdigest(f"{region[i]}:{level}:{j}") - (1 << 63)
                            for j in np.flatnonzero(2 * (d - d.min()) <= n[i])])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.int64()))], [*names, "cells"])

    schema = T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))])
    found = stage(joined.mapInArrow(run, schema), "windows")
    copies = found.groupBy("region").agg(F.sum(F.size("cells")).alias("copies"), F.count("*").alias("rows"))
    found = found.join(copies.select("region", (F.col("copies") <= SPREAD * F.col("rows")).alias("cut")), "region")
    return (found.where("cut").select(F.explode("cells").alias("region"), "node", "n", "bits", "fine"),
            found.where("not cut").select(*names))


def _grouped(rows: DataFrame, leaf: int) -> DataFrame:
    """Rows (region, size, ..) with the group (grp, i, j) they are compared in: small regions share
    groups of about ``leaf`` rows, a region of more than ``leaf`` rows is dealt into blocks, and each
    pair of blocks is one group."""
    few = rows.where(F.col("size") <= SMALL).count() // leaf + 1
    rows = rows.withColumn("m", F.expr(f"cast(ceil(size / {leaf}) as int)"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    group = F.when(F.col("size") <= SMALL, F.pmod(F.xxhash64("region"), F.lit(few))).otherwise(F.col("region"))
    return rows.withColumns({"grp": group, "i": F.least("blk", "other"), "j": F.greatest("blk", "other")})


def _partners(pdf: pd.DataFrame, root: np.ndarray):
    """(row, later rows of the same region and of another root that size and bitmaps allow, the share of shingles
    that the bitmaps tell apart) of rows sorted by region and n."""
    n, blk, bits = pdf["n"].to_numpy(), pdf["blk"].to_numpy(), _bits(pdf["bits"])
    region, fine = pdf["region"].to_numpy(), pdf["fine"].to_numpy()
    apart = pdf["i"].iloc[0] != pdf["j"].iloc[0]
    cut = np.flatnonzero(np.diff(region)) + 1
    for lo, hi in zip([0, *cut], [*cut, len(pdf)], strict=True):
        end = lo + np.searchsorted(n[lo:hi], n[lo:hi] * LINK[1] // LINK[0], "right")
        for i in range(lo, hi):
            js = np.arange(i + 1, end[i - lo])
            js = js[(root[js] != root[i]) & ((blk[js] != blk[i]) if apart else True)]
            if len(js):
                d = _hamming(bits[i], bits[js])
                ok = close(n[i], n[js], d)
                js, d = js[ok], d[ok]
                if fine[i] and len(js):
                    ok = np.array([fine_close(n[i], n[j], fine[i], fine[j]) for j in js])
                    js, d = js[ok], d[ok]
                if len(js):
                    yield i, js, d / (n[i] + n[js])


def _leaf_pairs(rows: DataFrame, leaf: int) -> DataFrame:
    """(a, b, d) of different components that size and bitmaps allow, and the share of shingles that the bitmaps tell
    apart; rows (region, size, node, n, bits, fine, root)."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["region", "n", "node"]).reset_index(drop=True)
        node, out = pdf["node"].to_numpy(), [[], [], []]
        for i, js, d in _partners(pdf, pdf["root"].to_numpy()):
            out[0] += [node[i]] * len(js)
            out[1] += node[js].tolist()
            out[2] += d.tolist()
        return pd.DataFrame({"a": out[0], "b": out[1], "d": out[2]})

    rows = _grouped(rows, leaf).select("grp", "i", "j", "region", "blk", "node", "n", "bits", "fine", F.xxhash64("root").alias("root"))
    pairs = rows.groupBy("grp", "i", "j").applyInPandas(join, "a binary, b binary, d double")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct()


def _nearest(pairs: DataFrame) -> DataFrame:
    """(a, b): of ``pairs(a, b, d)`` the nearest one of each node."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    best = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b, d) of different components."""
    for end in ("a", "b"):
        named = comp.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        pairs = pairs.join(named, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return pairs.where("a_root <> b_root").select("a", "b", "d")


def _with_partners(rows: DataFrame, leaf: int) -> DataFrame:
    """Leaves out members whose region has no other member that size and bitmaps allow: shared
    shingles bring many sets together that are far apart."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["region", "n", "node"]).reset_index(drop=True)
        on = np.zeros(len(pdf), bool)
        for i, js, _ in _partners(pdf, np.arange(len(pdf))):
            on[i] = on[js] = True
        return pdf.loc[on, ["region", "node", "n", "bits", "fine"]]

    cut = _grouped(rows.where(F.col("size") <= leaf), leaf).select("grp", "i", "j", "region", "blk", "node", "n", "bits", "fine")
    kept = cut.groupBy("grp").applyInPandas(keep, "region bigint, node binary, n bigint, bits binary, fine binary")
    return kept.unionByName(rows.where(F.col("size") > leaf).select("region", "node", "n", "bits", "fine"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    leaf: int = LEAF, depth: int = DEPTH, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links)."""
    with batch_bytes(docs.sparkSession), drop_shuffles(docs.sparkSession):  # all Python work ends in staged tables
        return _near_duplicates(docs, id_col, text_col, words, leaf, depth, rounds)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int, leaf: int, depth: int, rounds: int) -> DataFrame:
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = stage(_classes(src, words), "sets")
    rows = first.where("node is not null").select("id", "node", "n", "bits", "fine")
    order = np.zeros(SKETCH, np.int64)
    got = first.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("c")).toPandas()
    order[got["bucket"].to_numpy()] = got["c"].to_numpy()

    classes = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"),
                                                      F.min("bits").alias("bits"), F.min("fine").alias("fine"))
    classes = stage(classes, "classes")
    # the first 8 bytes of the digest as a number; should two classes share them, both are members
    keyed = classes.drop("id").mapInArrow(_short_keys, "node binary, n bigint, bits binary, fine binary, k bigint")
    members = _members(_prefixes(src, words, order))
    member = members.join(members.groupBy("lead").agg(F.count("*").alias("size")), "lead")
    region = member.join(keyed, member["node"] == keyed["k"]).select(
        F.col("lead").alias("region"), "size", keyed["node"].alias("node"), "n", "bits", "fine")
    held = stage(_with_partners(region, leaf), "regions")
    unstage(members)
    rest = held.withColumn("root", F.col("node")).withColumn("size", F.lit(2))
    links = comp = None
    for level in range(rounds):
        near = rest.where((F.col("size") > NEAR_SIZE) | F.lit(level == 0))
        more = _verified(_home_pairs(near, _pivots(near, level, NEAR_PIVOTS)), src, classes, words)
        links = more if links is None else links.unionByName(more)
        comp = components(links)
        rest, done = stage(_with_component(rest.drop("root", "size"), comp), "rest"), held
        unstage(done)
        held = rest
    leaves, big = [rest.where(F.col("size") <= leaf)], rest.where(F.col("size") > leaf)
    for level in range(rounds, rounds + depth):
        if big.isEmpty():
            break
        cells, whole = _cells(big, level)
        cells = stage(_with_component(cells, comp), "cells")
        leaves += [cells.where(F.col("size") <= leaf), whole]
        big = cells.where(F.col("size") > leaf)
    leaves.append(big)
    todo = leaves[0]
    for x in leaves[1:]:
        todo = todo.unionByName(x)
    pairs, before = stage(_leaf_pairs(todo, leaf), "near"), None
    while True:
        count = pairs.count()
        if count <= MANY * pairs.select(F.explode(F.array("a", "b"))).distinct().count() or before and 2 * count > before:
            break
        best = stage(_nearest(pairs), "best")
        links = links.unionByName(_verified(best, src, classes, words))
        comp = components(links)
        left = stage(_apart(pairs, comp).join(best, ["a", "b"], "left_anti"), "near")
        unstage(pairs)
        unstage(best)
        pairs, before = left, count
    more = _verified(pairs.select("a", "b"), src, classes, words)
    unstage(pairs)
    comp = components(links.unionByName(more)) if not more.isEmpty() else comp

    named = comp.join(classes.select("node", "id"), "node")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = comp.join(least, "root").select("node", "component_id")
    label = classes.select("node", "id").join(named, "node", "left").select(
        "node", F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select("id", "node", F.col("n").alias("n_shingles")).join(label, "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def _short_keys(batches):
    for b in batches:
        keys = [short_key(x) for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], ["node", "n", "bits", "fine", "k"])
