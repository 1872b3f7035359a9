"""Each operator against a brute-force version, on small rows with nulls, empty and long texts, ties,
repeated rows, empty tables and columns whose names clash with internal ones."""

import hashlib
import math
import os
import pickle
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tagseries.llm import (
    common,
    decontaminate,
    hash_forest,
    jaccard_join,
    lm_score,
    mixing,
    repeats,
    secret_scan,
    token_counts,
    toxicity,
    url_filter,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, id string, k1 bigint, node string, rid int"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def make_rows():
    base, passage = prose(120), prose(60)
    ws = base.split()
    texts = [None, "", "   \n", "one two", "one two", base, base, " ".join(ws[:60] + ["edit"] + ws[60:]),
             " ".join(ws[1:]), prose(40) + "\n" + passage + " " + prose(30), prose(20) + " " + passage,
             "x" * 450, prose(3000), "Token: 'abcdef123' AKIA" + "Z9" * 9 + " é " + "0a" * 14,
             "password = example1234 token=abc", "token=token:abcdef see " + "k3Jq9Zt7Wm2Xv5Rb8Ly4Nc6Pd1Hf0GsQ" + " end"]
    texts += [prose(rng.randint(1, 80)) for _ in range(25)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", "x", 1, "n", 2) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[9]]  # repeated rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expect(f):
    return sorted((f(r[0], r[1] or "") for r in ROWS), key=repr)


def test_secret_scan(docs, no_docs):
    rules = [(k, re.compile(p, re.A), g, n) for k, p, g, n in (
        ("assign", secret_scan.RULES[0][1], 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))]

    def brute(i, t):
        found = [[(m.start(), k, m.end(), kind) for m in p.finditer(t) if len(m.group(g)) >= n]
                 for k, (kind, p, g, n) in enumerate(rules)]
        text = ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(sum(found, [])))
        return (i, *map(len, found), hashlib.sha256(text.encode()).hexdigest())

    out = secret_scan.secret_scan(docs)
    assert got(out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) == expect(brute)
    live = out.where("n_live > 0").collect()
    assert [r.doc_id for r in live] == [15] and "live:" in live[0].spans
    assert secret_scan.secret_scan(no_docs).count() == 0


def test_secret_in_many_blocks(spark):
    text = " ".join(f"token=secret{i:05d}" for i in range(1000))
    out = secret_scan.secret_scan(spark.createDataFrame([(1, text, None)], "doc_id int, text string, source string")).first()
    spans = [x.split(":") for x in out.spans.split(",")]
    assert out.n_assign == 1000 and all(text[int(a):int(b)].startswith("token=secret") for _, a, b in spans)


def test_copied_example_is_not_live(spark):
    key = "k3Jq9Zt7Wm2Xv5Rb8Ly4Nc6Pd1Hf0GsQ"
    df = spark.createDataFrame([(i, key, f"o{i}") for i in range(4)], "doc_id int, text string, source string")
    assert {r.n_live for r in secret_scan.secret_scan(df).collect()} == {0}


def test_secret_counted_by_owners_and_repositories(spark):
    key, wide, doc = "k3Jq9Zt7Wm2Xv5Rb8Ly4Nc6Pd1Hf0GsQ", "Zp7Lw2Kd9Xc4Vb6Nm1Qa8Ws3Er5TyHuJ", "a b token='Xk29fLq8Zr4mWc7T'"
    rows = [(i, f"my {key}", f"o{i}") for i in range(5)]              # exact copies of one text by five owners
    rows += [(10 + i, f"{i} {wide}", "one") for i in range(101)]      # one owner, very many different repositories
    rows += [(200 + i, f"{i} {doc}", f"o{i}") for i in range(2)]      # two owners, two texts
    rows += [(300 + i, f"{i} {doc[:-1]}0'", f"o{i}") for i in range(3)]     # three owners, three texts
    out = {r.doc_id: r for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert all((out[i].n_live, out[i].n_specific, out[i].n_copied) == (1, 1, 0) for i in range(5))
    assert all((out[10 + i].n_live, out[10 + i].n_copied) == (0, 1) for i in range(101))
    assert (out[200].n_copied, out[300].n_specific, out[300].n_copied) == (0, 0, 1)
    assert [(out[i].most_owners, out[i].most_repos) for i in (0, 10, 200, 300)] == [(5, 5), (1, 101), (2, 2), (3, 3)]


def test_short_and_chance_values_are_live(spark):
    hexes = "0b96a8c8d79c4a5085c919698889f5{}2ab7bb"
    far = "abab" * 100 + "k3Jq9Zt7Wm2Xv5Rb8Ly4Nc6Pd1Hf0GsQ"  # varied only after 256 characters
    live = ["password=hunter2x", "api_key: s3cr3tPw", hexes.format("1234"), hexes.format("0000"), "token=" + far]
    dead = ["password=12345678", "password=aaaaaaa", "token=example1234", "secret=00000000", "0123456789" * 3]
    df = spark.createDataFrame([(i, t, f"o{i}") for i, t in enumerate(live + dead)], "doc_id int, text string, source string")
    out = {r.doc_id: r.n_specific for r in secret_scan.secret_scan(df).collect()}
    assert [out[i] for i in range(len(live + dead))] == [1] * len(live) + [0] * len(dead)


def shingles(t):
    w = t.encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("leaf", [2048, 2])
def test_near_duplicates(docs, no_docs, leaf):
    sets, root = {r[0]: shingles(r[1] or "") for r in ROWS}, {r[0]: r[0] for r in ROWS}
    for _ in ROWS:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    out = jaccard_join.near_duplicates(docs, leaf=leaf, rounds=1 if leaf == 2 else 3)
    assert got(out) == expect(lambda i, t: (i, len(sets[i]), root[i]))
    assert root[8] == root[5] == 5
    if leaf == 2:
        assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_large_family_of_near_copies(spark, monkeypatch):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(200)], []
    for _ in range(150):
        ws = list(base)
        for at in r.sample(range(200), r.randint(0, 9)):
            ws[at] = word()
        texts.append(" ".join(ws))
    texts += [" ".join(word() for _ in range(60)) for _ in range(30)]
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    links = [(a, b) for a in root for b in root[:a] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(texts)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    staged, plain = [], jaccard_join.stage

    def counting(df, name):
        out = plain(df, name)
        staged.append((name, out.count(), out.staged_path))
        return out

    monkeypatch.setattr(jaccard_join, "stage", counting)
    monkeypatch.setattr(jaccard_join, "MANY", 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    out = jaccard_join.near_duplicates(docs, leaf=10, depth=2, rounds=1).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in out} == {(i, len(sets[i]), root[i]) for i in range(len(texts))}
    most = lambda name: max((n for x, n, _ in staged if x == name), default=0)
    assert 0 < most("rest") and most("cells") <= 2 * most("rest")  # every set's window reaches every cell
    assert sum(n for x, n, _ in staged if x == "near") > most("near") > most("pairs")  # nearest pairs first: few others are left
    gone = {x for x, *_ in staged} - {"sets", "classes", "links", "windows", "cells", "rest"}
    exists = lambda p: os.path.exists(p.removeprefix("file:"))
    assert gone >= {"led", "members", "regions", "pairs", "wanted", "near", "best"}
    assert not [x for x, _, path in staged if x in gone and exists(path)]


def test_shuffle_files_go_with_their_job(spark, tmp_path):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    held = lambda: {f for d in dirs for _, _, names in os.walk(str(d)) for f in names if f.startswith("shuffle_")}
    before = held()
    with common.drop_shuffles(spark):
        spark.range(10000).selectExpr("id % 7 k", "id").groupBy("k").count().write.parquet(f"{tmp_path}/a")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(key, None) is None
    assert spark.read.parquet(f"{tmp_path}/a").count() == 7


def test_lm_score(docs, no_docs):
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in ROWS}
    toks = lambda t: t.encode().lower().split() + [None]
    c = Counter(w for r in ROWS if not held[r[0]] for w in toks(r[1] or ""))
    n, v = sum(c.values()), len(c)
    out = {r.doc_id: r for r in lm_score.lm_score(docs).collect()}
    for i, t in {r[0]: r[1] or "" for r in ROWS}.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t))
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(toks(t)), sum(c[w] > 0 for w in toks(t)), n)
        assert r.base_score == pytest.approx(base) and r.score < 0 and math.isfinite(r.score)
    assert lm_score.lm_score(no_docs).count() == 0


def test_lm_probabilities_sum_to_one():
    m = lm_score.Model(40)
    r = np.random.default_rng(1)
    m.a[:], m.b[:] = r.normal(size=m.a.shape), r.normal(size=m.b.shape)
    for p1, p2 in ((0, 5), (40, 40)):
        sym = np.arange(40)
        assert np.exp(m.logp(sym, np.full(40, p1), np.full(40, p2))).sum() == pytest.approx(1, abs=1e-4)


def test_lm_symbols_beyond_the_first_254(spark):
    words = [f"w{i}" for i in range(390)]
    r, rows = random.Random(1), []
    for i in range(900):  # frequent words at random, the rarer ones (rank 270 on) always in one order
        at = 270 + r.randrange(120)
        rows.append((i, " ".join([r.choice(words[:270]) for _ in range(300)] + [words[270 + (at + j) % 120] for j in range(60)])))
    held = [x for x in range(1000, 1020) if zlib.crc32(str(x).encode()) % 5 == 1]
    rows += [(x, " ".join(words[270 + j % 120] for j in range(x, x + 60))) for x in held]
    out = {x.doc_id: x for x in lm_score.lm_score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert held and all(out[x].score > 0.5 * out[x].base_score for x in held), [out[x].score / out[x].base_score for x in held]


def test_lm_words_without_a_symbol_as_context_and_target(spark):
    r, words, rows = random.Random(2), [f"w{i}" for i in range(400)], []
    for i in range(500):  # 400 frequent words at random; of 60 pairs of rarer ones, the second after the first only
        rows.append((i, " ".join([r.choice(words) for _ in range(300)] + [f"a{j} b{j}" for j in r.choices(range(60), k=10)])))
    held = [x for x in range(1000, 1400) if zlib.crc32(str(x).encode()) % 5 == 1][:40]
    rows += [(x, " ".join(f"a{j} b{(j + x % 2) % 60}" for j in range(60))) for x in held]
    out = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    out = {x.doc_id: x.score for x in lm_score.lm_score(out).collect()}
    together, apart = (np.mean([out[x] for x in held if x % 2 == k]) / 60 for k in (0, 1))
    assert together > apart + 0.2, (together, apart)


def test_lm_tree_probabilities_sum_to_one():
    r = np.random.default_rng(4)
    mass = r.integers(0, 9, 1 << 9) + 1e-9
    m = lm_score.Model(40, odds=lm_score.log_odds(mass))
    leaf, one = np.arange(1 << 9), np.ones(1 << 9, np.int64)
    assert m.log_lift(leaf, one, one) == pytest.approx(0)
    m.t[:] = r.normal(size=m.t.shape)
    for p, q in ((3, 5), (lm_score.CODE + (1 << 32) - 1, 40)):
        lift = m.log_lift(leaf, p * one, q * one)
        assert abs(lift).max() > 1 and (np.exp(lift) * mass).sum() / mass.sum() == pytest.approx(1, abs=1e-4)


def test_lm_tree_learns_and_grows_with_the_words():
    assert [lm_score.depth_of(v) for v in (1, 16, 17, 10**6, 10**12)] == [1, 1, 1, 16, 20]
    m = lm_score.Model(40, odds=lm_score.log_odds(np.ones(1 << 10)))
    code, p, q = np.random.default_rng(3).integers(0, 1 << 32, (3, 400))
    uses = np.zeros(m.rows)
    for _ in range(5):
        m.learn_tree(code, p, q, uses)
    assert m.log_lift(code, p, q).min() > 0.5 and uses.sum() == 5 * 400 * 3 * 2
    assert np.isfinite(m.log_lift(code, q, p)).all()


@pytest.mark.parametrize("rows", [300, 1 << 17])
def test_lm_row_sums(rows):
    r = np.random.default_rng(6)
    flat, of, g = np.minimum(r.zipf(1.3, 5000), rows - 1), r.integers(0, 700, 5000), r.normal(size=(700, 20)).astype(np.float32)
    want = np.zeros((rows, 20))
    np.add.at(want, flat, g[of])
    row, total = lm_score.row_sums(flat, of, g, rows)
    assert sorted(row) == sorted(set(flat)) and total == pytest.approx(want[row], abs=1e-2)


def test_lm_scores_are_probabilities_of_all_words(spark):
    words = [f"w{i}" for i in range(900)]
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(words) for _ in range(200))) for i in range(300)]
    seen = sorted({w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split()})
    one = [x for x in range(1000, 9000) if zlib.crc32(str(x).encode()) % 5 == 1][:len(seen) + 1]
    rows += [(x, w + " w0") for x, w in zip(one, [*seen, "unseen"], strict=True)]
    out = {x.doc_id: x.score for x in lm_score.lm_score(spark.createDataFrame(rows, "doc_id bigint, text string"), rounds=1).collect()}
    assert sum(10 ** out[x] for x in one) < 1 and len({out[x] for x in one}) > 400


def test_lm_weights_from_a_broadcast_are_of_numpys_own_type():
    m = lm_score.Model(40, odds=lm_score.log_odds(np.ones(1 << 4)))
    sent = pickle.loads(pickle.dumps((m.a, m.b, m.t, m.odds), 5))
    got = lm_score.Model(40, *(x.copy() for x in sent[:2]), t=sent[2].copy(), odds=sent[3])
    # another type object, though an equal one, makes numpy's add.at and subtract.at convert number by number
    assert all(x.dtype is np.dtype(np.float32) for x in (got.a, got.b, got.t, got.odds))


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_lm_words_of_odd_texts(size):
    texts = [None, "", "  ", "a\x0b\x0cB\x1cÉ \r\n", " X", None, "y\x00 z\u00a0\u2003 A", "k " * 9, "K"]
    frequent, got = ["a", "k"], []
    codes = lm_score.Codes(frequent, np.array([5, 3]))
    for piece in lm_score.pieces(pa.array(["cut", *texts]).slice(1), size):
        words, sizes = lm_score.words_of(piece)
        at, number = codes.of(words)
        assert at.tolist() == [frequent.index(w) if w in frequent else -1 for w in words.to_pylist()]
        number, first = lm_score.with_ends(number, sizes, 9)
        got += [x.tolist() for x in np.split(number, first[1:])]
    code = lambda w: {b"a": 5, b"k": 3}.get(w, lm_score.CODE + zlib.crc32(w))
    assert got == [[*map(code, (t or "").encode().lower().split()), 9] for t in texts]


def test_lm_large_weights():
    m, r = lm_score.Model(40), np.random.default_rng(5)
    m.a[:], m.b[:] = r.normal(size=m.a.shape) * 300, r.normal(size=m.b.shape) * 300
    sym = np.arange(40)
    log = m.logp(sym, np.full(40, 3), np.full(40, 7))
    assert np.isfinite(log).all() and np.exp(log).sum() == pytest.approx(1, abs=1e-4)
    m.learn(sym, np.full(40, 3), np.full(40, 7), [np.zeros(m.rows) for _ in "ab"], [np.zeros(m.rows) for _ in "ab"])
    assert np.isfinite(m.a).all() and np.isfinite(m.b).all()


def test_lm_size_grows_with_training_tokens():
    assert [lm_score.side_of(n) for n in (0, 10**6, 10**8, 10**12)] == [20, 20, 34, 64]
    m = lm_score.Model(900, side=34)
    assert m.rows > lm_score.ROWS and m.rows % lm_score.BLOCK_ROWS == 0
    sym, p1, p2 = (np.random.default_rng(k).integers(0, 900, 500) for k in range(3))
    squares, uses = [np.zeros(m.rows) for _ in "ab"], [np.zeros(m.rows) for _ in "ab"]
    before = m.logp(sym, p1, p2).sum()
    for _ in range(5):
        m.learn(sym, p1, p2, squares, uses)
    assert m.logp(sym, p1, p2).sum() > before and uses[0].sum() == uses[1].sum() == 5 * 4 * 500
    every = np.arange(900)
    assert np.exp(m.logp(every, np.full(900, 899), np.full(900, 900))).sum() == pytest.approx(1, abs=1e-4)


def test_section_tokens(docs, no_docs):
    enc, _ = token_counts.load_encoder(token_counts.RANKS, token_counts.PATTERN)

    def brute(i, t):
        raw, at, sections = t.encode(), 0, []
        for part in re.findall(rb"[^\n]*\n+|[^\n]+", raw):
            sections.append((at, at + len(part)))
            at += len(part)
        counts, pos, ids = [0] * len(sections), 0, enc.encode_ordinary(t)
        for x in ids:
            end = pos + len(enc.decode_single_token_bytes(x))
            share = [min(end, b) - max(pos, a) for a, b in sections]
            counts[share.index(max(share))] += 1
            pos = end
        return i, len(ids), counts

    assert got(token_counts.section_tokens(docs).select("doc_id", "n_tokens", "section_tokens")) == expect(brute)
    assert token_counts.section_tokens(no_docs).count() == 0


def test_boundary_crossing_rule():
    counts, crossing = token_counts.attribute(np.array([3, 4, 2]), np.array([5, 8]), 9)
    assert counts.tolist() == [2, 1, 0] and crossing == 2  # ties go to the earlier section


def test_mix_sources(docs, no_docs):
    out = mixing.mix_sources(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in out) == sorted((r[0], size(r[1])) for r in ROWS)
    per = Counter()
    for r in ROWS:
        per[r[3]] += size(r[1])
    names = sorted((s for s in per if s is not None)) + [None]
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(per.values())
    target, open_ = {}, set(names)
    while True:
        level = (total - sum(3 * per[s] for s in names if s not in open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * per[s]}
        open_ -= full
        if not full:
            break
    target = {s: weight[s] * level if s in open_ else 3 * per[s] for s in names}
    taken, source = Counter(), {r[0]: r[3] for r in ROWS}
    for r in out:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 3 + 0.01 * target[s]
    assert sorted(map(tuple, mixing.mix_sources(docs).collect())) == sorted(map(tuple, out))
    assert mixing.mix_sources(no_docs).count() == 0


def test_url_filter(spark):
    schema = "page_id int, url string, html string, rank int, walk int"
    link = lambda *h: "".join(f'<a href="https://{x}/p">' for x in h)
    rows = [(0, None, None), (1, "http://a.net", ""), (2, "http://A.NET/x?y#z", link("b.org")), (3, "nothing", "<a href='/x'>"),
            (4, "https://s.example.net/en/1", link("good.com")), (5, "https://example.com/de/", None),
            (6, "https://xexample.com/de/", link("a.net", "a.net")), (7, "http://good.com/a", ""), (8, "http://b.org/fr/?q", "")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], schema)
    out = {r.page_id: r for r in url_filter.url_filter(df).collect()}
    assert [(out[i].host, out[i].path, out[i].rule) for i in range(9)] == [
        ("", "", None), ("a.net", "", None), ("a.net", "/x", "net/"), ("", "", None), ("s.example.net", "/en/1", "example.net/en/"),
        ("example.com", "/de/", "example.com/de/"), ("xexample.com", "/de/", None), ("good.com", "/a", None), ("b.org", "/fr/", "org/fr/")]
    assert out[5].verdict == "block" and out[4].verdict == "allow" and out[7].trust > 0 and out[7].verdict == "allow"
    assert out[0].verdict == "allow"
    assert url_filter.url_filter(spark.createDataFrame([], schema)).count() == 0


def test_distrust_runs_against_links(spark):
    rows = [(0, "http://bad.net/x", ""), (1, "http://fan.com/", '<a href="http://bad.net/">'), (2, "http://calm.com/", "")]
    out = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert out[1].verdict == "block" and out[1].distrust > 0 and out[2].verdict == "allow"


def test_toxicity(spark, no_docs):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        t, y = prose(r.randint(20, 60)).split(), i % 4 == 0
        for _ in range(3 if y else 0):
            t.insert(r.randrange(len(t)), r.choice(["zzidiot", "wworm", "vvfool" + r.choice("aeiou")]))
        rows.append((i, " ".join(t) + ".", "x"))
        labels.append((i, int(y)))
    rows += [(600, None, "x"), (601, "", "x"), (0, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    lab = spark.createDataFrame(labels + [(0, 1)], "doc_id bigint, toxic int")
    out = {x.doc_id: x for x in toxicity.toxicity(df, lab).collect()}
    held = [i for i, _ in labels if out[i].held_out]
    assert held == [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].predicted == labels[i][1] for i in held]) >= 0.98
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out.values())
    assert out[600].score == out[601].score and out[600].predicted == 0
    assert toxicity.toxicity(no_docs, lab).count() == 0
    assert {x.score for x in toxicity.toxicity(df, lab.limit(0)).collect()} == {0.0}


def test_grammar_states():
    g = toxicity.Grammar({"idiot": 1.0})
    weigh = lambda t: g.features(t)[0]
    assert weigh("you idiot") > weigh("the idiot") > weigh("they said an idiot") > 0
    assert weigh("not an idiot") < weigh("an idiot") and weigh("no way. an idiot") == weigh("an idiot")
    assert weigh("idiotic") == 0


def test_remove_repeats(docs, no_docs):
    texts = [(r[0], (r[1] or "").encode()) for r in ROWS]
    seen = Counter(t[k:k + 200] for _, t in texts for k in range(len(t) - 199))

    def brute(i, t):
        t = t.encode()
        on = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k:k + 200]] > 1:
                on[k:k + 200] = b"\1" * 200
        runs = sum(1 for j, x in enumerate(on) if x and not (j and on[j - 1]))
        return i, len(t), sum(on), runs, hashlib.sha256(bytes(x for x, o in zip(t, on, strict=True) if not o)).hexdigest()

    assert got(repeats.remove_repeats(docs)) == expect(brute)
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    test_remove_repeats(spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([], SCHEMA))


def test_nearest(spark):
    r = np.random.default_rng(2)
    vecs = [(i, [float(x) for x in r.normal(size=8).astype(np.float32)]) for i in range(400)]
    vecs += [(400, vecs[3][1]), (401, vecs[3][1]), (402, None), (403, [0.0] * 8), (404, [float("nan")] * 8),
             (405, [None] * 8), (420, [1.0, 2.0]), (None, vecs[1][1]), vecs[20]]
    df = spark.createDataFrame([(i, v, "x") for i, v in vecs], "vec_id bigint, embedding array<float>, block string")
    x = {i: np.array(v, float) for i, v in vecs if i is not None and i <= 401}

    def brute(k):
        return sorted((q, n + 1, i) for q in x if q % 20 == 0 for n, (_, i) in enumerate(
            sorted((-float((x[q] * x[i]).sum()), i) for i in x if i != q)[:k]))

    out = hash_forest.nearest(df).collect()
    assert sorted((o.query_id, o["rank"], o.vec_id) for o in out) == brute(20)
    few = hash_forest.nearest(df, candidates=150, block_rows=256).collect()
    exact = {(q, i) for q, _, i in brute(20)}
    assert len({(o.query_id, o.vec_id) for o in few} & exact) >= 0.8 * len(exact)
    assert hash_forest.nearest(df.limit(0)).count() == 0


def test_nearest_of_other_lengths_and_repeated_ids(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=4 if i % 3 else 6)]) for i in range(90)]
    rows += [(i, [float(x) for x in r.normal(size=4)]) for i in (20, 20, 40, 41)] + rows[:2]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    every = [(i, tuple(v)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows)]
    want = []
    for a, (q, v) in enumerate(every):
        if q % 20 == 0:
            near = sorted((-float((np.array(v) * np.array(w)).sum()), i) for b, (i, w) in enumerate(every) if b != a and len(w) == len(v))
            want += [(q, n + 1, i) for n, (_, i) in enumerate(near[:20])]
    out = hash_forest.nearest(df, block_rows=16, chunk_rows=2).collect()
    assert sorted((o.query_id, o["rank"], o.vec_id) for o in out) == sorted(want)


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_decontaminate(docs, no_docs, spark, chunk):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = lambda t: word.findall((t or "").translate(low))
    items = [(7, ROWS[12][1][50:400]), (10, "ONE two"), (11, "one, two!"), (2, None), (3, "..."), (4, ROWS[9][1][-150:]), (5, prose(30))]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id int, text string, found int")

    def brute(i, t):
        ws, hit, found = words(t), set(), set()
        for item, text in items:
            w = words(text)
            m = min(10, len(w))
            for a in range(len(w) - m + 1 if m else 0):
                for k in range(len(ws) - m + 1):
                    if ws[k:k + m] == w[a:a + m]:
                        hit.update(range(k, k + m))
                        found.add(str(item))
        return i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    src = docs.select(docs.doc_id.alias("id"), "text")
    if chunk < 1000:
        parts = decontaminate._chunks(bench.selectExpr("cast(item_id as string) item", "text"), chunk)
        assert len(parts) > 1
        many = decontaminate.find_items(src, bench.selectExpr("cast(item_id as string) item", "text"), chunk_bytes=chunk)
        assert sorted((r.id, sorted(set(r.found))) for r in many.collect()) == sorted(
            (r.id, sorted(set(r.found))) for r in decontaminate.find_items(src, bench.selectExpr("cast(item_id as string) item", "text")).collect())
        return
    assert got(decontaminate.decontaminate(docs, bench).drop("items")) == expect(brute)
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())
