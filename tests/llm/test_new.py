"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables
and columns whose names clash with internal ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagseries.llm import line_dedup, spelling, token_align

SCHEMA = "doc_id bigint, text string, doc bigint, body string, word string, n int, pos int, rid int"
rng = random.Random(8)


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "b", "w", 2, 3, 4) for i, t in pairs], SCHEMA).repartition(3)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# --- 13, lines

def brute_lines(pairs, min_chars=20, min_docs=3):
    blank = " \t\n\x0b\f\r"
    key = lambda x: re.sub("[A-Z]+", lambda m: m.group().lower(), x.strip(blank))
    held = defaultdict(set)
    for i, t in pairs:
        for x in (t or "").split("\n"):
            held[key(x)].add((i, t if i is None else 0))
    keep = {k: max((i for i, _ in d if i is not None), default=None) for k, d in held.items()
            if len(k) >= min_chars and len(d) >= min_docs}
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (key(x) in keep and (i is None or i != keep[key(x)]))]
        out.append((i, len(lines), len(lines) - len(left), sha("\n".join(left))))
    return sorted(out, key=repr)


def line_pairs():
    common = ["This line is SHARED by many documents", "  this line is shared by many documents\t", "x" * 20, "y" * 19,
              "É" * 20, "é" * 20, "short", "", "\r", "a line with other white space   "]
    pairs = [(i, "\n".join(rng.choice(common + [f"line number {j} of document {i % 9}"]) for j in range(rng.randint(0, 9))))
             for i in range(40)]
    pairs += [(90, None), (91, ""), (92, "\n\n"), (None, "x" * 20), (None, "x" * 20 + "\nend"), (None, None)]
    pairs += [(93, "\n".join(f"a long document's line {j % 700}" for j in range(4000)))]
    pairs += [(94, "q" * 30), (None, "q" * 30), (94, "q" * 30 + "\nother"), (95, "w" * 25 + "\n" + "w" * 25), (96, "w" * 25)]
    pairs += [(None, "null only held line of text " + c) for c in "aaa"]
    pairs += [(None, "null only held by three texts\n" + c) for c in "abc"]
    return pairs + pairs[:4]


def lines_of(spark, pairs, **kw):
    out = line_dedup.dedup_lines(frame(spark, pairs), **kw)
    return sorted(((r[0], r[1], r[2], sha(r[3])) for r in out.collect()), key=repr)


@pytest.mark.parametrize("share", [1, 8192])
def test_lines_equal_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)  # 1: no key is frequent; 8192: all are
    pairs = line_pairs()
    assert lines_of(spark, pairs) == brute_lines(pairs)


def test_lines_other_thresholds_and_empty_table(spark):
    pairs = line_pairs()
    assert lines_of(spark, pairs, min_chars=1, min_docs=2) == brute_lines(pairs, 1, 2)
    assert lines_of(spark, []) == []


# --- 11, spelling

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(pairs, every=199):
    count = Counter()
    for i, t in pairs:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = re.sub("[A-Z]+", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    count = {w: n for w, n in count.items() if n >= 5 and len(w) >= 6}
    form, n_near = {}, {}
    for w, n in count.items():
        by = sorted((-count[x], x) for x in count if near(w, x))
        n_near[w] = len(by)
        form[w] = by[0][1] if by and -by[0][0] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, n_near[w], count.get(form[w])) for w, n in count.items())


def edit(w, letters="abc\u00e9z"):
    i = rng.randrange(len(w))
    return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])


def spelling_pairs():
    base = ["".join(rng.choice("abc\u00e9z") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    words = [(w, 300) for w in base] + [(edit(w), 40) for w in base * 3] + [(edit(edit(w)), 6) for w in base * 4]
    words += [("".join(rng.sample("abcdefg", 7)), 5) for _ in range(150)] + [("\u00c9CLAIR\u00d7\u00f7", 7), ("\u00c9clair\u00d7", 6)]
    bag = [w.upper() if rng.random() < 0.2 and w.isascii() else w for w, n in words for _ in range(n)]
    rng.shuffle(bag)
    pairs = [(i, " ".join(bag[j:j + 97])) for i, j in enumerate(range(0, len(bag), 97))]
    return pairs + [(None, "a" * 300 + ", " + " ".join(["b" * 300, "b" * 299] * 6)), (7, None), (8, ""), (9, "12 \u0100\u017f")] + pairs[:2]


@pytest.mark.parametrize("sample, cell", [(1 << 16, 2048), (200, 16)])
def test_spelling_equals_brute_force(spark, sample, cell):
    pairs = spelling_pairs()
    out = spelling.spelling_groups(frame(spark, pairs), sample=sample, cell=cell)
    want = brute_spelling(pairs)
    assert sum(r[1] is not None for r in want) > 50 and any(r[2] != r[1] for r in want if r[1])
    assert sorted(tuple(r) for r in out.collect()) == want


def test_spelling_of_an_empty_table(spark):
    assert spelling.spelling_groups(frame(spark, [])).count() == 0
    assert spelling.spelling_groups(frame(spark, [(1, None), (2, "few short words")])).count() == 0


def test_box_bounds_keep_every_near_word():
    words = sorted({"".join(rng.choice("abcd") for _ in range(7)) for _ in range(400)})
    longer = sorted({edit(w, "abcd") for w in words * 2})
    longer = [w for w in longer if len(w) == 8]
    for a, b in ((words, words), (words, longer)):
        q, h = spelling.near_pairs(spelling.codes_of(b), spelling.codes_of(a))
        assert {(a[i], b[j]) for i, j in zip(q, h, strict=True)} == {(x, y) for x in a for y in b if near(x, y)}
    tree = spelling.grow(spelling.vectors_of(spelling.codes_of(words), 3), np.arange(len(words)), 8)
    assert isinstance(tree, tuple)


# --- 12, token alignment

def brute_alignment(pairs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_align.A_FILE)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=token_align.B_FILE)
    back = {chr(c): x for x, c in token_align.printable_bytes().items()}
    a_bytes = lambda i: bytes(back[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()

    rows, count = [], Counter()
    for i, t in pairs:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        parts = [[f(x) for x in ids[k]] for k, f in enumerate((a_bytes, b_bytes))]
        if not t or any(b"".join(p) != b" " + t.encode() for p in parts):
            rows.append((i, [], [], [], []))
            continue
        spans = [[(sum(map(len, p[:j])), sum(map(len, p[:j + 1]))) for j in range(len(p))] for p in parts]
        links = [(x, y) for x, (s, e) in zip(ids[0], spans[0], strict=True) for y, (u, v) in zip(ids[1], spans[1], strict=True)
                 if s < v and u < e]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [tuple([x for x, (_, e) in zip(ids[k], spans[k], strict=True) if lo < e <= hi] for k in (0, 1))
                  for lo, hi in zip([0, *common], common)]
        rows.append((i, *ids, groups, links))
        count.update(links)
    top = Counter()
    for (x, y), n in count.items():
        top[y] = max(top[y], n)
    text = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return sorted([(i, len(x), len(y), len(g), len(l), sum(count[k] == top[k[1]] for k in l), sum(count[k] for k in l), text(g))
                   for i, x, y, g, l in rows], key=repr)


def token_pairs():
    words = ["alignment", "tokenizers", "na\u00efve", "\u6771\u4eac", "don't", "3.14159", "\U0001f600\U0001f44d", "\n\n", "  ", "\t", "WAL", "e\u0301",
             "<s>", "<0x41>", "<|endoftext|>", "\x00\x1f", "\u00a0", "\u3000", "\u0085", "antidisestablishmentarianism", "\r\n", "\x1c "]
    texts = [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [None, "", " ", "  ", "a ", "\n", "a \u2581b", "\u2581", "\ufffd", "x" * 3000, "same text here", "same text here"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]


@pytest.mark.parametrize("step, share", [(1, 1 << 20), (7, 30), (1 << 16, 1)])
def test_alignment_equals_brute_force(spark, monkeypatch, step, share):
    monkeypatch.setattr(token_align, "HOT_SHARE", share)  # 1: no pair is frequent; 2 ** 20: all are
    pairs = token_pairs()
    out = token_align.token_links(frame(spark, pairs), step=step, digest=False)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_alignment(pairs)


def test_alignment_of_empty_rows(spark):
    assert token_align.token_links(frame(spark, [])).count() == 0
    assert [tuple(r) for r in token_align.token_links(frame(spark, [(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_ranks_give_the_same_merges():
    assert token_align.merges_by_rank(token_align.A_FILE)
    by_rank, table = token_align.load_a(token_align.A_FILE, True)
    by_file, _ = token_align.load_a(token_align.A_FILE, False)
    for _, t in token_pairs():
        if t:
            assert by_rank(t) == by_file(t)
            assert b"".join(table[i] for i in by_rank(t)) == b" " + t.encode()


@pytest.mark.parametrize("step", [1, 2, 5, 100])
def test_pieces_are_equal_work_and_stitch(step):
    for _ in range(30):
        a, b = (np.cumsum([rng.randint(1, 4) for _ in range(rng.randint(1, 40))]) for _ in range(2))
        end = max(a[-1], b[-1]) + 1
        a, b = np.append(a, end), np.append(b, end)
        at = token_align.diagonals(a, b, step)
        d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
        merged = sorted([(int(x), 0) for x in a] + [(int(x), 1) for x in b])
        assert list(at) == [sum(side == 0 for _, side in merged[:n]) for n in d]
        ends, ta, tb, both = token_align.overlaps(a, b, step)
        want = sorted({*a.tolist(), *b.tolist()})
        assert ends.tolist() == want
        assert ta.tolist() == [int(np.searchsorted(a, e)) for e in want] and tb.tolist() == [int(np.searchsorted(b, e)) for e in want]
        assert both.tolist() == [e in a and e in b for e in want]
