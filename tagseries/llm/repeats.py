"""Operator 8, exact repeated-window removal by a depth-limited radix sort of suffixes.

Suffixes are grouped most significant digit first and only as deep as the window (200 bytes); a group
of two or more at full depth is a window that repeats.  So that not every byte is a row, a window's
first digit is read at its anchor: of the 48-byte strings inside the window, the leftmost one of the
smallest hash.  Equal windows have equal anchors at equal offsets, and consecutive windows share one
(a run), so about one suffix in 77 bytes enters the first pass:

1. by the anchor's 48 bytes; anchors that occur once leave;
2. by the 160 bytes of a second anchor, chosen in the same way, for the windows that are left;
3. by all bytes that the windows of one second anchor cover (a run); a run with an equal is repeated
   as a whole, and of each different run one goes on, where its anchor has several different ones;
4. by the window's full 200 bytes, for the windows of those runs.

Texts meet their anchors and spans by a key of two hashes; equal texts are merged first, in the one
shuffle of texts, whose output all later steps reuse.  Digits are compared by 64-bit polynomial
hashes, always together with the hashes of the earlier passes.

Groups are only counted (smallest and largest member differ), so a passage that a third of all texts
share never meets in one task.

Edge cases: a null text is empty; a text shorter than the window is kept whole; a text with an exact
copy loses every byte (if it is long enough); repeated rows each give a row; an empty table gives an
empty result.  Very long texts are hashed in pieces of CHUNK bytes that overlap by a window.
Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagseries.llm.common import mix64, stage, texts_of

WINDOW, ANCHOR, SECOND, CHUNK = 200, 48, 160, 1 << 20
ODD = 0x9E3779B97F4A7C15  # odd multiplier of the polynomial
_cache: dict = {}


def _powers(n: int):
    """Byte codes, powers of the multiplier and of its inverse modulo 2^64, and places from 0 on."""
    if len(_cache.get("p", ())) < n:
        grow = max(n, 1 << 16)
        for name, m in (("p", ODD), ("i", pow(ODD, -1, 1 << 64))):
            base = np.full(grow, m, np.uint64)
            base[0] = 1
            _cache[name] = np.multiply.accumulate(base)
        _cache["t"] = mix64(np.arange(1, 257, dtype=np.uint64))
        _cache["n"] = np.arange(grow, dtype=np.uint64)
    return _cache["t"], _cache["p"], _cache["i"], _cache["n"]


class Piece:
    """Hashes of one piece of a text and the runs of its windows."""

    def __init__(self, piece: bytes, window: int, anchor: int):
        self.n, self.window = len(piece), window
        code, power, self.inv, self.places = _powers(self.n + 1)
        x = code[np.frombuffer(piece, np.uint8)]
        x *= power[:self.n]
        self.h = np.empty(self.n + 1, np.uint64)
        self.h[0] = 0
        np.cumsum(x, out=self.h[1:])
        every = self.n - anchor + 1
        g = self.h[anchor:] - self.h[:every]
        g *= self.inv[:every]
        g = mix64(g)
        # smallest of the upper halves of the hashes over each window, the leftmost one where equal: by
        # the value with its place below it
        low = g & np.uint64(0xFFFFFFFF00000000)
        low |= self.places[:every]
        width, size = window - anchor + 1, 1
        while size * 2 <= width:
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        last = self.n - window + 1
        best = np.minimum(low[:last], low[width - size:width - size + last])
        cut = np.flatnonzero(best[1:] != best[:-1]) + 1
        self.lo, self.hi = np.concatenate(([0], cut)), np.concatenate((cut, [last])) - 1
        self.pos = (best[self.lo] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.g = g[self.pos]

    def spans(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of the bytes [start, start + length)."""
        return mix64((self.h[start + length] - self.h[start]) * self.inv[start])


def pieces(text: bytes, window: int, anchor: int):
    """(offset, Piece) over a text; pieces overlap by a window less one byte, so windows are not cut."""
    for c in range(0, len(text) - window + 1, CHUNK):
        yield c, Piece(text[c:c + CHUNK + window - 1], window, anchor)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _emit(texts: DataFrame, f, schema: str) -> DataFrame:
    """Rows of arrays that ``f(text, row)`` yields, with the text's key."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            keys = [b.column(i).to_pylist() for i in (0, 1)]
            extra = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            out = [[] for _ in names]
            size = 0
            for k1, k2, t, more in zip(*keys, texts_of(b.column(2)), extra, strict=True):
                for cols in f(t, more):
                    n = len(cols[0])
                    for o, c in zip(out, (np.full(n, k1, np.int64), np.full(n, k2, np.int64), *cols), strict=True):
                        o.append(c)
                    size += n
                if size >= 1 << 18:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(c)) for c in out], names)
                    out, size = [[] for _ in names], 0
            if size:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(c)) for c in out], names)

    return texts.mapInArrow(run, schema)


def _occurrence(k1, k2, pos):
    return F.xxhash64(k1, k2, pos)


def repeated_spans(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, second: int = SECOND) -> DataFrame:
    """(k1, k2, spans): starts of windows that occur elsewhere, as array of (lo, hi), of different
    texts (k1, k2, text)."""

    def anchors(t, _):
        for c, p in pieces(t, window, anchor):
            yield p.pos + c, p.g

    def deeper(t, kept):
        kept = np.sort(np.array(kept, np.int64))
        for c, p in pieces(t, window, anchor):
            alive = np.zeros(p.n - window + 2, np.int64)
            for i in np.flatnonzero(np.isin(p.pos + c, kept)):
                alive[p.lo[i] + 1:p.hi[i] + 2] = 1
            alive = np.cumsum(alive)
            q = Piece(t[c:c + p.n], window, second)
            use = alive[q.hi + 1] > alive[q.lo]
            yield q.pos[use] + c, q.g[use]

    def runs(t, kept):
        kept = np.sort(np.array(kept, np.int64))
        for c, p in pieces(t, window, second):
            use = np.flatnonzero(np.isin(p.pos + c, kept))
            lo, hi = p.lo[use], p.hi[use]
            shape = mix64(((p.pos[use] - lo).astype(np.int64) * 65536 + hi - lo).view(np.uint64))
            yield p.g[use], p.spans(lo, hi - lo + window) ^ shape, lo + c, hi + c

    def windows(t, some):
        lo, hi, g, r = (np.array([x[i] for x in some], np.int64) for i in range(4))
        for c, p in pieces(t, window, second):
            for a, b, gg, rr in zip(lo - c, hi - c, g, r, strict=True):
                if 0 <= a and b + window <= p.n:
                    at = np.arange(a, b + 1)
                    yield np.full(len(at), gg), p.spans(at, window), np.full(len(at), rr), at + c

    key = ["k1", "k2"]
    twice = lambda o: (F.min(o) != F.max(o)).alias("twice")

    def often(rows, f):
        """Positions, per text, of the anchors that occur more than once."""
        found = _emit(rows, f, "k1 bigint, k2 bigint, pos bigint, g bigint").withColumn("pos", F.col("pos").cast("int"))
        some = found.groupBy("g").agg(twice(_occurrence("k1", "k2", "pos"))).where("twice").select("g")
        return found.join(some, "g", "left_semi").groupBy(*key).agg(F.collect_list("pos").alias("at"))

    kept = stage(often(texts.select(*key, "text"), anchors), "anchors")
    kept = stage(often(texts.join(kept, key).select(*key, "text", "at"), deeper), "anchors")
    run = stage(_emit(texts.join(kept, key).select(*key, "text", "at"), runs,
                      "k1 bigint, k2 bigint, g bigint, r bigint, lo bigint, hi bigint"), "runs")
    # one row per different part of an anchor: whether it has an equal, and where one of them is
    one = run.groupBy("g", "r").agg(twice(_occurrence("k1", "k2", "lo")), F.min(F.struct("k1", "k2", "lo", "hi")).alias("at"))
    one = stage(one, "parts")
    several = one.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    deep = one.join(several, "g", "left_semi").select("at.*", "g", "r").groupBy(*key).agg(
        F.collect_list(F.array("lo", "hi", "g", "r")).alias("some"))
    whole = run.join(one.where("twice").select("g", "r"), ["g", "r"], "left_semi").select(*key, "lo", "hi")

    win = _emit(texts.join(deep, key).select(*key, "text", "some"), windows,
                "k1 bigint, k2 bigint, g bigint, w bigint, r bigint, i bigint").withColumn("i", F.col("i").cast("int"))
    again = win.groupBy("g", "w").agg(twice("r")).where("twice").select("g", "w")
    single = win.select(*key, "g", "w", "i").join(again, ["g", "w"], "left_semi").select(
        *key, F.col("i").cast("long").alias("lo"), F.col("i").cast("long").alias("hi"))
    return whole.unionByName(single).groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _cut(text: bytes, spans, window: int) -> tuple[int, int, str]:
    """Removed bytes, removed runs and the digest of what is left."""
    removed = runs = 0
    left = hashlib.sha256()
    end = -1
    for lo, hi in sorted(spans):
        stop = hi + window
        if lo > end:
            left.update(text[max(end, 0):lo])
            runs, removed = runs + 1, removed + stop - lo
            end = stop
        elif stop > end:
            removed, end = removed + stop - end, stop
    left.update(text[max(end, 0):])
    return removed, runs, left.hexdigest()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    k = {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")}
    rows = src.select("id", k["k1"].alias("k1"), k["k2"].alias("k2"), F.octet_length("text").cast("long").alias("n_bytes"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    texts = src.where(F.octet_length("text") >= window).groupBy(k["k1"].alias("k1"), k["k2"].alias("k2")).agg(
        F.max("text").alias("text"))
    spans = repeated_spans(texts, window, anchor)

    def cut(batches):
        for b in batches:
            if b.num_rows:
                done = [_cut(t, [(x["lo"], x["hi"]) for x in s], window)
                        for t, s in zip(texts_of(b.column(2)), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([x[0] for x in done], pa.int64()),
                     pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done])],
                    ["k1", "k2", "n_removed", "n_spans", "kept"])

    part = texts.join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(
        cut, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept string")
    # of a text with an exact copy nothing is left
    full = rows.where(F.col("n_bytes") >= window).groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.max("n_bytes").alias("all")).where("copies > 1")
    part = part.join(full, ["k1", "k2"], "full").select(
        "k1", "k2", F.coalesce("all", "n_removed").alias("n_removed"),
        F.when(F.col("all").isNull(), F.col("n_spans")).otherwise(1).alias("n_spans"),
        F.when(F.col("all").isNull(), F.col("kept")).otherwise(hashlib.sha256().hexdigest()).alias("kept"))
    out = rows.join(part, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
