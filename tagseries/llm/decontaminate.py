"""Operator 10, benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of the benchmark items.  Patterns of one length m form one searcher:
a shift table over blocks of two words says how far the search may skip (m - 1 where the block occurs
in no pattern), blocks that end a pattern lead to a bucket of that suffix, and the words of each
pattern in the bucket are compared directly.  Texts are read once; nothing is shuffled.

Benchmark texts reach the tasks in chunks of at most ``chunk_bytes``, by a broadcast of the chunk's
rows; a larger benchmark makes more chunks, each one more narrow pass over the same rows, and a single
longer item is a chunk of its own.

Edge cases: null texts and items have no words; items of fewer words than a window are one window;
equal items are reported each under its own id; repeated documents are judged alike; null item ids
are left out of the list; without benchmark rows nothing is hit.
Very long texts are searched whole, one at a time.  Only ids and texts are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagseries.llm.common import LOWER, UPPER, add_columns

WINDOW, CHUNK_BYTES = 10, 16 << 20
# one byte table: A-Z to a-z; 0-9, a-z and bytes of non-ASCII characters stay; the rest is a space
TABLE = bytes(ord(LOWER[UPPER.index(chr(i))]) if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32
              for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Searcher:
    """Wu-Manber search for word-id patterns of one length."""

    def __init__(self, length: int):
        self.m, self.size = length, min(2, length)
        self.shift: dict = {}
        self.bucket: dict = {}

    def add(self, pattern: tuple, items: set) -> None:
        m, b = self.m, self.size
        for end in range(b - 1, m):
            block = pattern[end - b + 1:end + 1]
            self.shift[block] = min(self.shift.get(block, m), m - 1 - end)
        self.bucket.setdefault(pattern[m - b:], {}).setdefault(pattern, set()).update(items)

    def find(self, ids: list[int]):
        """(start, items) of every occurrence."""
        m, b, shift, bucket = self.m, self.size, self.shift, self.bucket
        skip, i, n = m - b + 1, m - 1, len(ids)
        while i < n:
            block = (ids[i - 1], ids[i]) if b == 2 else (ids[i],)
            s = shift.get(block, skip)
            if s:
                i += s
                continue
            found = bucket[block].get(tuple(ids[i - m + 1:i + 1]))
            if found:
                yield i - m + 1, found
            i += 1


def searchers(rows, window: int) -> tuple[dict, list[Searcher]]:
    """Word ids and one searcher per pattern length for (item, text) rows."""
    vocab: dict[bytes, int] = {}
    by_length: dict[int, Searcher] = {}
    for item, text in rows:
        ids = [vocab.setdefault(w, len(vocab)) for w in words_of((text or "").encode("utf-8"))]
        m = min(window, len(ids))
        for i in range(len(ids) - m + 1 if m else 0):
            by_length.setdefault(m, Searcher(m)).add(tuple(ids[i:i + m]), {item})
    return vocab, list(by_length.values())


def _chunks(items: DataFrame, limit: int) -> list:
    """Benchmark rows in chunks of at most ``limit`` bytes of text (or one item)."""
    total = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, math.ceil((total[0] or 0) / limit))
    while n > 1:
        part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        size = items.groupBy(part.alias("p")).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("c"))
        if size.where((F.col("b") > limit) & (F.col("c") > 1)).isEmpty() or n > 2 * total[1]:
            return [items.where(part == i) for i in range(n)]
        n *= 2
    return [items]


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs(.., text)`` with spans (word intervals that are hit, flat start/end pairs) and found
    (item ids as strings)."""
    sc = docs.sparkSession.sparkContext
    out = docs.withColumns({"spans": F.array().cast("array<bigint>"), "found": F.array().cast("array<string>")})
    for chunk in _chunks(items, chunk_bytes):
        rows = sc.broadcast([(r.item, r.text) for r in chunk.collect()])

        def start(rows=rows):
            vocab, parts = searchers(rows.value, window)

            def f(texts):
                spans, found = [], []
                for t in texts:
                    ids = [vocab.get(w, -1) for w in words_of(t)]
                    cover, hit = [], set()
                    for p in parts:
                        for s, which in p.find(ids):
                            cover += (s, s + p.m)
                            hit |= which
                    spans.append(cover)
                    found.append([x for x in hit if x is not None])
                return [spans, found]

            return f

        step = add_columns(out, "text", start, "more array<bigint>, also array<string>")
        out = step.select(*docs.columns, F.concat("spans", "more").alias("spans"), F.concat("found", "also").alias("found"))
    return out


def _covered(flat) -> int:
    done = total = 0
    for s, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
        total += max(0, e - max(s, done))
        done = max(done, e)
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    hits = find_items(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, window)

    def counted(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                texts = b.column(1).cast(pa.binary()).to_pylist()
                n = [len(words_of(t or b"")) for t in texts]
                hit = [_covered(x) for x in b.column(2).to_pylist()]
                found = [sorted(set(x)) for x in b.column(3).to_pylist()]
                digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()),
                     pa.array(digest), pa.array([x > 0 for x in hit]), pa.array(found, pa.list_(pa.string()))],
                    ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = hits.mapInArrow(counted, f"id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
                          "contaminated boolean, items array<string>")
    return out.withColumnRenamed("id", id_col)
