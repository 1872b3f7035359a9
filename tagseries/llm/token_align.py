"""Operator 12, cross-tokenizer alignment: merge-path partitioning of two lists of token ends.

Each text is encoded twice.  The ends of the A and the B tokens of a batch of documents are two sorted lists
of byte offsets.  Binary searches along the diagonals of their merge cut it into pieces of ``step`` items
each, whatever the lengths of documents and tokens; every piece is merged by itself and emits its
overlaps (each distinct end closes the overlap of one A and one B token).  An end that falls on the
boundary of two pieces, A's in one and B's in the next, is stitched: it is one overlap, and a common end.
Common ends close groups.

How often ids are linked is counted over all documents: per document, then per batch, then by id pair.  The
counts come back to the documents in two exact parts.  Pairs with more than one in ``HOT_SHARE`` of all
links (fewer than ``HOT_SHARE`` pairs, 24 MB at most, whatever the corpus) go to every task; the rest, none of them
frequent, by a shuffle join.  The highest count of each B id is a table of one row per id of the vocabulary.

Whole texts are encoded, in stretches: a space after a character that is not white space starts a new one
for both tokenizers (checked for the pieces of B), so the ids of a text are those of its stretches, which
are encoded once and looked up (``Stretches``).  Where the file of A allows it (``merges_by_rank``, checked on the
driver), A's merges run by rank, which is faster and gives the same ids; otherwise the file's own tokenizer runs.

Edge cases: null and empty texts, and texts whose joined token bytes are not a space and the text (such as
those with U+2581), have no tokens, zeros and an empty groups column; rows that repeat count again; an
empty table gives an empty result.  Very long texts are encoded whole, in one task; their links are as many
as their tokens at most.  Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagseries.llm.common import add_columns, batch_bytes, stage

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
STEP = 1 << 16
#: Stretches that a task remembers; bytes of text that it aligns at once (a longer text is taken alone).
HELD, AT_ONCE = 1 << 18, 1 << 20
#: Where a stretch ends: a space after a character that is not white space.
STRETCH = r"(?<=\S) "
HOT_SHARE = 1 << 20
#: An id pair as one number: A's id times ``PAIR`` plus B's.
PAIR = 1 << 20
# Fixed value: how vocabulary A cuts text before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def printable_bytes() -> dict[int, int]:
    """How a byte-level vocabulary writes bytes: printable Latin-1 characters stand for themselves, the
    other bytes, in order, for the code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


def read_vocab(path: str) -> tuple[dict, list[bytes]]:
    """The file's contents and the bytes of every id (none for special tokens)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    back = {c: b for b, c in printable_bytes().items()}
    vocab = data["model"]["vocab"]
    table = [b""] * (max(vocab.values()) + 1)
    special = {t["id"] for t in data["added_tokens"]}
    for token, i in vocab.items():
        if i not in special:
            table[i] = bytes(back[ord(c)] for c in token)
    return data, table


def merges_by_rank(path: str) -> bool:
    """Whether merging the pair whose union has the smallest id gives what the file's list of merges gives.

    It does if ids follow that list and every token, merged by itself, becomes that token: the last two parts
    of a token are then the listed pair, inside any text, so no other pair with that union ever meets."""
    from tokenizers import Tokenizer

    data, table = read_vocab(path)
    pre, vocab = data["pre_tokenizer"], data["model"]["vocab"]
    if data["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        return False
    pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    ids = [vocab["".join(m)] for m in pairs]
    model = Tokenizer.from_file(path).model
    return ids == sorted(ids) and all([t.id for t in model.tokenize(token)] == [i] for token, i in vocab.items() if table[i])


def load_a(path: str, by_rank: bool) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """An encoder that puts a space before its text, and the bytes of every id."""
    data, table = read_vocab(path)
    if by_rank:
        import tiktoken

        ranks = {token: i for i, token in enumerate(table) if token}
        encode = tiktoken.Encoding("a", pat_str=CUT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: encode(" " + text), table

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(" " + text, add_special_tokens=False).ids, table


def load_b(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """As ``load_a``; this model puts the space itself."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(re.search("[^\u2581]\u2581", p) for p in pieces):
        raise ValueError("a piece holds a space after other characters, so stretches are not independent")
    table = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
    return sp.encode, table


class Stretches:
    """Ids of stretches of text in both vocabularies, remembered by number.

    New ones are joined by spaces and encoded as one text, which is cut at their ends.  Those that end in
    white space, which would run into the next, or hold U+2581 are encoded one by one; a stretch whose
    token bytes are not its own is marked."""

    def __init__(self, sides: list[tuple]):
        self.sides = [(encode, table, np.array([len(t) for t in table], np.int64)) for encode, table in sides]
        self.clear()

    def clear(self) -> None:
        self.held, self.bad = {}, np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int64) for _ in self.sides]
        self.start = [np.zeros(1, np.int64) for _ in self.sides]

    def numbers(self, stretches: list[str]) -> np.ndarray:
        if len(self.held) > HELD:
            self.clear()
        new = list(set(stretches).difference(self.held))
        if new:
            joined = [s for s in new if s and not s[-1].isspace() and "\u2581" not in s]
            if not self._add(joined):
                for s in joined:
                    self._add([s], force=True)
            for s in set(new).difference(self.held):
                self._add([s], force=True)
        return np.fromiter(map(self.held.__getitem__, stretches), np.int64, len(stretches))

    def _add(self, new: list[str], force: bool = False) -> bool:
        if not new:
            return True
        text = " ".join(new)
        raw = b" " + text.encode()
        ends = np.cumsum([1 + len(s.encode()) for s in new])
        got = []
        for encode, table, size in self.sides:
            # a lone space is the end of a longer text: the model of B has no token for an empty one
            ids = np.array(encode(text) if text else encode("x ")[-1:], np.int64)
            at = np.cumsum(size[ids])
            cut = np.searchsorted(at, ends)
            same = b"".join(map(table.__getitem__, ids.tolist())) == raw and (at[cut] == ends).all()
            if not same and not force:
                return False
            got.append((ids, cut + 1 if same else np.array([len(ids)]), same))
        for i, s in enumerate(new):
            self.held[s] = len(self.bad) + i
        for k, (ids, cut, _) in enumerate(got):
            self.start[k] = np.append(self.start[k], len(self.ids[k]) + cut)
            self.ids[k] = np.append(self.ids[k], ids)
        self.bad = np.append(self.bad, np.full(len(new), not all(same for *_, same in got)))
        return True

    def ids_of(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a list of stretches, and how many each has."""
        first, size = self.start[side][numbers], self.start[side][numbers + 1] - self.start[side][numbers]
        shift = np.repeat(first - (np.cumsum(size) - size), size)
        return self.ids[side][np.arange(len(shift)) + shift], size


# --- the merge

def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many items of ``a`` are among the first 0, step, 2 * step, ... of the merge of ``a`` and ``b``
    (``a`` first where equal), by a binary search on each diagonal."""
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        more = a[mid] <= b[d[open_] - 1 - mid]
        low[open_] = np.where(more, mid + 1, low[open_])
        high[open_] = np.where(more, high[open_], mid)
    return low


def pieces(a: np.ndarray, b: np.ndarray, step: int) -> Iterator[tuple]:
    """Per piece of the merge: (ends, A token, B token, whether both end there)."""
    at = diagonals(a, b, step)
    for k in range(len(at) - 1):
        i, i2 = at[k], at[k + 1]
        j, j2 = k * step - i, min((k + 1) * step, len(a) + len(b)) - i2
        merged = np.concatenate([a[i:i2] * 2, b[j:j2] * 2 + 1])
        merged.sort(kind="stable")
        of_b, ends = merged & 1, merged >> 1
        new = np.append(True, ends[1:] != ends[:-1]) if len(ends) else np.zeros(0, bool)
        both = np.append(~new[1:], False)[new] if len(ends) else new
        done_b = np.cumsum(of_b) - of_b
        done_a = np.arange(len(ends)) - done_b
        yield ends[new], i + done_a[new], j + done_b[new], both


def overlaps(a: np.ndarray, b: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, A token, B token, common) of all overlaps of two sorted lists of ends, stitched from the pieces."""
    got = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]]
    for ends, ta, tb, both in pieces(a, b, step):
        if len(got[-1][0]) and len(ends) and got[-1][0][-1] == ends[0]:  # A's end there, B's here
            got[-1][3][-1] = True
            ends, ta, tb, both = ends[1:], ta[1:], tb[1:], both[1:]
        if len(ends):
            got.append([ends, ta, tb, both])
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def group_order(ta: np.ndarray, tb: np.ndarray, both: np.ndarray) -> tuple:
    """From the overlaps: places of the A and B tokens in the order of groups (A's of a group before B's), and
    which tokens are the last of their group."""
    group = np.cumsum(both) - both
    last_a, last_b = (np.flatnonzero(np.append(t[1:] != t[:-1], len(t) > 0)) for t in (ta, tb))
    upto_a, upto_b = ta[both] + 1, np.append(0, tb[both] + 1)
    return (np.arange(len(last_a)) + upto_b[group[last_a]], np.arange(len(last_b)) + upto_a[group[last_b]],
            both[last_a], both[last_b])


def aligner(a_file: str, b_file: str, by_rank: bool, step: int, digest: bool) -> Callable[[list[bytes]], list]:
    """From texts to columns n_a, n_b, n_groups, n_links, groups, pairs, times."""
    known = Stretches([load_a(a_file, by_rank), load_b(b_file)])
    (_, bytes_a, len_a), (_, bytes_b, len_b) = known.sides
    cut = re.compile(STRETCH).split

    def texts_with(size, sep):
        return np.array([f"{i}{sep}".encode() for i in range(size)], object)

    a_comma, a_bar, b_comma, b_semi = (texts_with(len(t), s) for t, s in (
        (bytes_a, ","), (bytes_a, "|"), (bytes_b, ","), (bytes_b, ";")))

    def encode(texts):
        """Ids of both sides, all texts in a row, and how many each text has."""
        parts = [cut(t.decode()) if t else [] for t in texts]
        numbers = known.numbers([s for p in parts for s in p])
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        odd = np.bincount(doc, known.bad[numbers], len(texts)) > 0
        numbers, doc = numbers[~odd[doc]], doc[~odd[doc]]
        out = []
        for side in (0, 1):
            ids, size = known.ids_of(side, numbers)
            out += [ids, np.bincount(doc, size, len(texts)).astype(np.int64)]
        return out

    def f(texts):
        size = np.cumsum([len(t) for t in texts]) // AT_ONCE
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(texts)]
        done = [run(texts[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        return [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else [x for part in c for x in part] for c in zip(*done, strict=True)]

    def run(texts):
        ids_a, na, ids_b, nb = encode(texts)
        a, b = np.cumsum(len_a[ids_a]), np.cumsum(len_b[ids_b])
        ends, ta, tb, both = overlaps(a, b, step)
        common = ends[both]
        # documents end at common ends, so each one's share of the lists is a slice
        to_a, to_b = np.cumsum(na), np.cumsum(nb)
        last = np.append(0, a)[to_a]
        to_link, to_group = np.searchsorted(ends, last, "right"), np.searchsorted(common, last, "right")
        links, groups = np.diff(to_link, prepend=0), np.diff(to_group, prepend=0)
        doc = np.repeat(np.arange(len(texts)), links)
        key = np.sort(doc * (PAIR * PAIR >> 1) + ids_a[ta] * PAIR + ids_b[tb])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key)))
        key = key[first]
        doc, pair = key // (PAIR * PAIR >> 1), key % (PAIR * PAIR >> 1)
        cuts = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))).astype(np.int32)
        at_a, at_b, end_a, end_b = group_order(ta, tb, both)
        words = np.empty(len(a) + len(b), object)
        words[at_a] = np.where(end_a, a_bar[ids_a], a_comma[ids_a])
        words[at_b] = np.where(end_b, b_semi[ids_b], b_comma[ids_b])
        out, p = [], 0
        for q in (to_a + to_b).tolist():
            text = b"".join(words[p:q].tolist())[:-1]
            out.append((hashlib.sha256(text).hexdigest() if digest else text.decode()) if q > p else "")
            p = q
        return [na, nb, groups, links, out, pa.ListArray.from_arrays(pa.array(cuts), pa.array(pair)),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32)))]

    return f


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, a_file: str = A_FILE, b_file: str = B_FILE,
          step: int = STEP, digest: bool = True) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups (their text, or its SHA-256), and its
    distinct id pairs with how often each is linked there."""
    by_rank = merges_by_rank(a_file)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = add_columns(src, "text", lambda: aligner(a_file, b_file, by_rank, step, digest),
                      "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>")
    return out.drop("text")


# --- counts over all documents

def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): each id pair's links over all documents, and whether its B id has no more frequent
    one.  Tasks add up their batches before the shuffle."""
    def run(batches):
        for b in batches:
            pair, times = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            found, where = np.unique(pair, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.bincount(where, times, len(found)).astype(np.int64))], ["pair", "links"])

    part = aligned.select("pairs", "times").mapInArrow(run, "pair bigint, links bigint")
    counts = stage(part.groupBy("pair").agg(F.sum("links").alias("links")), "pair-counts")
    b = F.col("pair") % PAIR
    top = counts.groupBy(b.alias("b")).agg(F.max("links").alias("top"))  # one row per id of B
    out = counts.join(top, b == F.col("b"))
    return out.select("pair", "links", (F.col("links") == F.col("top")).alias("best"))


def with_corpus_counts(aligned: DataFrame) -> DataFrame:
    """``aligned`` (written once) with n_best and count_sum in place of the pairs."""
    spark = aligned.sparkSession
    counts = stage(pair_counts(aligned), "pair-best")
    often = counts.select(F.floor(F.sum("links") / HOT_SHARE)).first()[0] or 0
    hot = counts.where(F.col("links") > often).toPandas().sort_values("pair")  # fewer than HOT_SHARE rows
    shared = spark.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "links", "best")))
    names = ["row", "pairs", "times"]

    def known(batches, cold):
        pairs, links, best = shared.value
        for b in batches:
            row, lists, times = b.column(0).to_numpy(), b.column(1), b.column(2).flatten().to_numpy(zero_copy_only=False)
            pair = lists.flatten().to_numpy(zero_copy_only=False)
            size = lists.value_lengths().fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            owner = np.repeat(np.arange(len(row)), size)
            if cold:
                cols = [row[owner[~hit]], pair[~hit], times[~hit].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row", "pair", "times"])
            else:
                w, x = owner[hit], at[hit]
                n = times[hit].astype(np.int64)
                n_best, total = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
                np.add.at(n_best, w, n * best[x])
                np.add.at(total, w, n * links[x])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (row, n_best, total)], ["row", "n_best", "count_sum"])

    lists = aligned.select(*names)
    from_hot = lists.mapInArrow(lambda x: known(x, False), "row bigint, n_best bigint, count_sum bigint")
    rare = lists.mapInArrow(lambda x: known(x, True), "row bigint, pair bigint, times bigint")
    rare = rare.join(counts.where(F.col("links") <= often), "pair").select(
        "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("links")).alias("count_sum"))
    sums = from_hot.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "row")


def token_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum."""
    with batch_bytes(docs.sparkSession):
        aligned = align(docs, id_col, text_col, **options).withColumn("row", F.monotonically_increasing_id())
        aligned = stage(aligned, "aligned")
    return with_corpus_counts(aligned).select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
