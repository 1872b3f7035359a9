"""The pipeline on planted documents, and the entry module's registration."""

import random

import corpus_pipeline
from tagseries.llm import mixing, queries


def test_planted_cases(spark, tmp_path):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(3, 8))) for _ in range(500)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        t = prose(r.randint(30, 60)).split()
        if i % 5 == 0:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(["zzidiot", "qqworm"]))
        docs.append([i, " ".join(t) + ".", "en", f"s{i % 4}", 0])
        labels.append((i, 1, int(i % 5 == 0)))
    bench = prose(30)
    docs[1][1] = docs[2][1].rstrip(".") + " tail"                      # near copy of 2: 2 goes
    docs[3][1] += " " + bench                                           # contaminated
    docs[4][1] += ' token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"'  # live secret
    docs[6][1] = docs[7][1] = prose(20)                                 # exact copies: 7 goes
    docs += [[300, None, None, None, 0], [301, "", "en", "s1", 0]]
    for name, rows, schema in (
            ("documents", docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
            ("labels", labels, "doc_id bigint, quality int, toxic int"),
            ("benchmark", [(0, bench)], "item_id bigint, text string")):
        spark.createDataFrame([tuple(x) for x in rows], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    clean = set(range(302)) - {i for i in range(300) if i % 5 == 0} - {2, 3, 4, 7}
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = left.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == columns, name
    assert {x.doc_id for x in left.collect()} == clean
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} <= clean and all(0 < x.taken <= 3 * x.size for x in out)
    weight = {s: sum(x.taken for x in out if x.source == s) for s in ("s0", "s1", "s2", "s3")}
    assert weight["s0"] > weight["s1"] > weight["s2"]


def test_small_sources_meet_their_targets(spark):
    large = spark.range(1000).selectExpr("id doc_id", "repeat('a ', 3000) text", "'a' source")
    small = spark.range(1000, 1012).selectExpr("id doc_id", "'b c' text", "concat('z', id div 2) source")
    docs = large.unionByName(small)
    out = corpus_pipeline.mix(spark, docs, "").groupBy("source").agg(
        {"taken": "sum", "target": "max"}).collect()  # these sources are smaller than a slot's share of all words
    assert len(out) == 7 and all(abs(x["sum(taken)"] - x["max(target)"]) <= 0.5 for x in out)
    got = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        {"taken": "sum", "target": "max", "first_slot": "min"}).collect()
    assert all(x["sum(taken)"] == (12 if x["source"] != "a" else 3_000_024 - 72) for x in got)
    slots = sorted(x["min(first_slot)"] for x in got)
    assert slots[0] == 0 and len(set(slots)) == 7


def test_blocks_of_a_source_are_of_equal_length(spark):
    docs = spark.range(60).selectExpr("id doc_id", "repeat('w ', int(1 + id * 7 % 50)) text", "concat('s', id % 4) source")
    out = mixing.mix_sources(docs, slots=37).join(docs.select("doc_id", "source"), "doc_id").collect()
    for source in {x.source for x in out}:
        rows = [x for x in out if x.source == source]
        assert abs(sum(x.taken for x in rows) - rows[0].target) <= 0.5
        assert all(x.taken <= 3 * x.size for x in rows)
    few = mixing.mix_sources(docs, slots=1).collect()
    assert {(x.doc_id, x.taken) for x in few} == {(x.doc_id, x.taken) for x in out}
    sizes = docs.selectExpr("source src", "false nul", "length(text) div 2 n").groupBy("src", "nul").agg({"n": "sum"})
    targets = mixing.source_targets(sizes.withColumnRenamed("sum(n)", "s")).selectExpr("*", "bigint(round(target)) words")
    plan = mixing.schedule(targets, 37).collect()
    assert sorted(p.slot for p in plan if p.slot < 37) == list(range(37)) and len(plan) == 37
    for source in {p.src for p in plan}:
        mine = sorted((p.block, p.slot, p.n) for p in plan if p.src == source)
        assert [b for b, *_ in mine] == list(range(len(mine))) and mine == sorted(mine, key=lambda x: x[1])
        assert {n for *_, n in mine} == {len(mine)}


SECRET = ' token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"'
CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, target string, taken int, key_ int, row_ int, Mix_size int, id int"


def odd_rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    bench, copy = prose(30), prose(40)
    texts = [(None, prose(40)), (None, prose(40) + SECRET), (None, None), (None, ""), (5, prose(40)), (5, prose(40) + " " + bench),
             (5, None), (6, prose(30)), (6, prose(30)), (7, copy), (8, copy), (None, copy), (9, "same"), (9, "same"),
             (10, prose(20000)), (10, prose(40) + " zzidiot qqworm zzidiot")]
    return bench, [(i, t, "en", f"s{k % 3}", 0, k, "t", 1, 2, 3, 4, 5) for k, (i, t) in enumerate(texts)]


def test_rows_are_judged_one_by_one(spark, tmp_path):
    bench, rows = odd_rows()
    spark.createDataFrame([(0, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 0, int(i % 5 == 0)) for i in range(100, 400)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    r = random.Random(4)
    more = [(i, " ".join("".join(r.choice("hijk") for _ in range(5)) for _ in range(40)) + (" zzidiot qqworm" * 3 if toxic else ""),
             "en", "s1", 0, -1, "t", 1, 2, 3, 4, 5) for i, _, toxic in labels]
    docs = spark.createDataFrame(rows + more, CLASHING).repartition(4)
    left = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        got = out.collect()
        left[name] = sorted(x.size for x in got if x.size >= 0)
        if name != "mixing sources to target weights":
            assert out.columns == docs.columns
    every = list(range(len(rows)))
    assert left["toxicity"] == every[:-1]
    assert left["n-gram Jaccard join"] == [i for i in every if i not in (10, 11, 13)] or left["n-gram Jaccard join"] == [
        i for i in every if i not in (10, 11, 12)]
    assert left["benchmark decontamination"] == [i for i in every if i != 5]
    assert left["secret scans"] == [i for i in every if i != 1]
    assert out.columns == docs.columns + ["mix_mix_size", "source_size", "mix_target", "mix_taken", "first_slot"]
    for x in got:
        assert 0 < x.mix_taken <= 3 * x.mix_mix_size * (2 if x.text == "same" else 1)
    none = spark.createDataFrame([], CLASHING)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, none, str(tmp_path)).count() == 0


def test_texts_are_dealt_by_key_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, None), (None, "x"), (None, "x")], "doc_id bigint, text string")
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(key, before)
    dealt = [line for line in plan.split("\n") if "Exchange" in line and "row_#" in line]
    assert len(dealt) == 1 and "hashpartitioning(row_#" in dealt[0], plan  # the join deals by what rows are made distinct by
    assert sorted((x.doc_id or 0, x.text or "") for x in out.collect()) == [(0, ""), (0, "x"), (1, "a b c d e f")]


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
