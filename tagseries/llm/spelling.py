"""Operator 11, spelling variants: k-d trees over letter-count vectors.

Words are counted over all texts.  One edit changes the letter counts of a word by at most one letter
more and one letter less (L1 distance of two at most): words of one length that are near differ by
exactly one more and one less, a word and its extension by one letter by exactly one more.  The same
bound holds for the counts of any fixed prefix (an inserted letter pushes another one out), so the
trees split on counts of the first half as well, which parts words that are permutations of each other.

A tree per word length cuts the words into cells.  Its cuts are fitted on a bounded sample
(about ``SAMPLE`` words, drawn by hash); every word is put into its cell, and as a query it visits each
cell, of the tree of its own length and of the next length, that the box bounds do not rule out.  A
cell and its queries meet in one task, where a local tree prunes again and the letters of the pairs
left are compared.  So each pair of lengths is searched once, without a list of all pairs.

Forms (the near word of largest n, at least ``ratio`` times the word's own) are followed to their root
by pointer doubling: n grows by the ratio with every step, so chains are short.

Edge cases: null and empty texts hold no words; a null id counts as the empty string; rows that repeat
are counted again; equal n goes to the smaller word; an empty table gives an empty result.  Very long
texts are read whole, one at a time.  Only the id and the text are read, so other columns may have any
name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagseries.llm.common import LOWER, UPPER, batch_bytes, stage, texts_of, unstage

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
DELETE_EVERY = 199
#: The cuts are fitted on about this many words; cells hold about ``CELL`` words while the sample gives that
#: many cells, and grow beyond (12,000 words at 100 million).
SAMPLE, CELL, LEAF = 1 << 16, 2048, 64
#: Distinct words that a counting task holds before it sends them on; pairs compared at once.
HELD, AT_ONCE = 1 << 18, 1 << 20
DIMS = 26 + 64


def count_words(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_count: int, delete_every: int) -> DataFrame:
    """(word, n) over all texts.  Each task sends partial counts, which are added by word."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        find, lower, held = re.compile(RUN).findall, bytes.maketrans(UPPER.encode(), LOWER.encode()), Counter()

        def out():
            part = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return part

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                base = zlib.crc32(f"{i}:".encode())
                for w, n in Counter(find(t.translate(lower).decode())).items():
                    if len(w) < min_chars:
                        continue
                    h = zlib.crc32(w.encode(), base)
                    if delete_every and h % delete_every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < min_chars:
                            continue
                    held[w] += n
            if len(held) >= HELD:
                yield out()
        yield out()

    return src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- vectors and trees

def codes_of(words: list[str]) -> np.ndarray:
    """Letters of words of one length as numbers 0 to ``DIMS`` - 1: (words, length)."""
    c = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return np.where(c >= 0xC0, c - 0xC0 + 26, c - ord("a")).astype(np.uint8)


def vectors_of(codes: np.ndarray, half: int) -> np.ndarray:
    """Letter counts of the whole words and of their first ``half`` letters: (words, 2 * DIMS)."""
    n, size = codes.shape
    out = np.zeros((n, 2 * DIMS), np.uint8 if size < 256 else np.uint32)
    rows = np.arange(n)
    for j in range(size):
        out[rows, codes[:, j]] += 1
        if j < half:
            out[rows, codes[:, j] + DIMS] += 1
    return out


def grow(vec: np.ndarray, rows: np.ndarray, leaf: int):
    """A tree over ``rows`` of ``vec``: (dimension, cut, low side, high side), or the rows of a leaf.
    The dimension whose cut parts the rows most evenly is taken; equal vectors stay together."""
    if len(rows) <= leaf:
        return rows
    v = vec[rows]
    low = np.stack([(v <= c).sum(0) for c in range(4)])
    gain = np.minimum(low, len(rows) - low)
    cut, dim = divmod(int(gain.argmax()), vec.shape[1])
    if not gain[cut, dim]:
        width = v.max(0) - v.min(0)
        dim = int(width.argmax())
        if not width[dim]:
            return rows
        cut = int(v[:, dim].min())
    side = v[:, dim] <= cut
    return dim, cut, grow(vec, rows[side], leaf), grow(vec, rows[~side], leaf)


def number(tree, first: int = 0):
    """The same tree with a running number in place of each leaf, and the next number."""
    if isinstance(tree, np.ndarray):
        return first, first + 1
    dim, cut, a, b = tree
    a, first = number(a, first)
    b, first = number(b, first)
    return (dim, cut, a, b), first


def visit(tree, vec: np.ndarray, rows: np.ndarray, more: np.ndarray, less: np.ndarray):
    """(leaf, rows of ``vec`` that may have a near word there).  ``more`` and ``less`` (2, rows): letters that
    a near word may still have more or less of, in the whole and in the first half.  A box one letter away
    takes that allowance; two away it is ruled out."""
    if not len(rows):
        return
    if not isinstance(tree, tuple):
        yield tree, rows
        return
    dim, cut, a, b = tree
    g = dim // DIMS
    v = vec[rows, dim].astype(np.int64)
    for side, need, left in ((a, v - cut, less), (b, cut + 1 - v, more)):
        step = need == 1
        ok = (need <= 0) | (step & (left[g] > 0))
        spent = left.copy()
        spent[g] -= step
        yield from visit(side, vec, rows[ok], *((more[:, ok], spent[:, ok]) if left is less else (spent[:, ok], less[:, ok])))


def allowance(n: int, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """Letters that a near word may have more and less of: a word longer by one has none less in the whole."""
    more, less = np.ones((2, n), np.int8), np.ones((2, n), np.int8)
    if longer:
        less[0] = 0
    return more, less


def is_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of codes ``a`` and ``b`` (as long, or longer by one) differ by exactly one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    front = np.cumprod(a == b[:, :-1], 1, np.uint8).sum(1)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], 1, np.uint8).sum(1)
    return front + back >= a.shape[1]


def hash_rows(codes: np.ndarray) -> np.ndarray:
    """A number per row; equal rows have equal numbers."""
    out = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[:, j] + np.uint64(1)
    return out


def near_pairs(home: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, home) of all near pairs of two code tables, by a local tree over ``home``.

    One edit leaves the letters before the middle of the query, or those after it, as they are: pairs in
    a leaf that agree on neither are left out before the letters are compared one by one."""
    half, mid = home.shape[1] // 2, query.shape[1] // 2
    hv, qv = vectors_of(home, half), vectors_of(query, half)
    heads = [hash_rows(x[:, :mid]) for x in (query, home)]
    tails = [hash_rows(x[:, x.shape[1] - query.shape[1] + mid:]) for x in (query, home)]
    tree, found = grow(hv, np.arange(len(home)), LEAF), []
    for leaf, rows in visit(tree, qv, np.arange(len(query)), *allowance(len(query), home.shape[1] > query.shape[1])):
        step = max(1, AT_ONCE // len(leaf))
        for i in range(0, len(rows), step):
            r = rows[i:i + step]
            q, h = np.nonzero((heads[0][r][:, None] == heads[1][leaf]) | (tails[0][r][:, None] == tails[1][leaf]))
            q, h = r[q], leaf[h]
            ok = is_near(query[q], home[h])
            found.append((q[ok], h[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# --- the search

def fit_cells(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, tuple]:
    """A numbered tree per word length, fitted on about ``sample`` words or all, if fewer; leaves are cells."""
    sizes = {r["size"]: r["n"] for r in words.groupBy(F.char_length("word").alias("size")).agg(F.count("*").alias("n")).collect()}
    share = int((1 << 30) * min(1.0, sample / max(1, sum(sizes.values()))))
    took = [r["word"] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share).select("word").collect()]
    trees = {}
    for size, n in sizes.items():
        some = [w for w in took if len(w) == size]
        if some:
            vec = vectors_of(codes_of(some), size // 2)
            trees[size] = number(grow(vec, np.arange(len(some)), max(8, cell * len(some) // n)))[0]
        else:
            trees[size] = 0
    return trees


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, near, near_n): every ordered pair of words that differ by exactly one edit."""
    trees = fit_cells(words, sample, cell)
    schema = pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def deal(batches):
        for b in batches:
            table = b.to_pandas()
            for size, part in table.groupby(table["word"].str.len()):
                codes, rows = codes_of(part["word"].tolist()), np.arange(len(part))
                for target in (size, size + 1):
                    if target not in trees:
                        continue
                    vec = vectors_of(codes, target // 2)
                    none = np.zeros((2, len(part)), np.int8)
                    sides = [(False, visit(trees[target], vec, rows, *allowance(len(part), target > size)))]
                    if target == size:
                        sides.append((True, visit(trees[size], vec, rows, none, none)))
                    for home, cells in sides:
                        hits = list(cells)
                        if hits:
                            out = part.iloc[np.concatenate([at for _, at in hits])]
                            out = out.assign(size=target, cell=np.repeat([c for c, _ in hits], [len(at) for _, at in hits]), home=home)
                            yield pa.RecordBatch.from_pandas(out[["size", "cell", "home", "word", "n"]], schema, preserve_index=False)

    def search(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        home, out = t[t["home"]], []
        hw, hn = home["word"].to_numpy(), home["n"].to_numpy()
        if len(home):
            codes = codes_of(hw.tolist())
            asks = t[~t["home"]]
            for size, part in asks.groupby(asks["word"].str.len()):
                qw, qn = part["word"].to_numpy(), part["n"].to_numpy()
                q, h = near_pairs(codes, codes_of(qw.tolist()))
                out.append(pd.DataFrame({"word": qw[q], "near": hw[h], "near_n": hn[h]}))
                if size < key[0]:
                    out.append(pd.DataFrame({"word": hw[h], "near": qw[q], "near_n": qn[q]}))
        return pd.concat(out) if out else pd.DataFrame({"word": [], "near": [], "near_n": []})

    dealt = words.select("word", "n").mapInArrow(deal, "size int, cell int, home boolean, word string, n bigint")
    # few bytes, much work: a fixed number of partitions, which is not folded into fewer
    spread = dealt.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "size", "cell")
    return spread.groupBy("size", "cell").applyInPandas(search, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words with a form, by pointer doubling; each round is written once."""
    cur = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stage(cur.join(nxt, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        unstage(cur)
        cur = new
        if cur.where("moved").isEmpty():
            return cur.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = MIN_CHARS,
                    min_count: int = MIN_COUNT, ratio: int = RATIO, delete_every: int = DELETE_EVERY,
                    sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.  ``delete_every`` plants slips: runs whose
    hash it divides lose a letter (0: none do)."""
    if ratio <= 1:
        raise ValueError("ratio must be above 1, so that n grows along the forms")
    with batch_bytes(docs.sparkSession):
        words = stage(count_words(docs, id_col, text_col, min_chars, min_count, delete_every), "words")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(words, sample, cell).groupBy("word").agg(F.count("*").alias("n_near"), first)
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).cast("long").alias("form_n")), "spellings")
    out = found.join(roots(found.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
