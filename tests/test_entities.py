"""Entity keys: every operator run over two assets at once equals running each alone."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tagseries.operators.features import tag_features
from tagseries.operators.labels import event_starts, upset_labels
from tagseries.operators.resample import fill_forward, regularise, resample, to_wide

SCHEMA = "plant string, ts timestamp_ntz, tag string, value double, status int"
T0 = dt.datetime(2024, 3, 1)


def readings(spark):
    rnd = random.Random(1)
    rows = []
    for plant, n, shift in (("p1", 4000, 0), ("p2", 3000, 700)):
        for i in range(n):
            m = shift + i * 5 + rnd.randint(0, 4)
            v = 100.0 if not (1500 < i < 1700) else 10.0
            rows.append((plant, T0 + dt.timedelta(minutes=m), "flow", v + rnd.random(), 192 if rnd.random() > 0.1 else 0))
            if i % 3 == 0:
                rows.append((plant, T0 + dt.timedelta(minutes=m), "temp", rnd.random() * 50, 192))
    return spark.createDataFrame(rows, SCHEMA)


def chain(r, entity, block):
    b = resample(r, entity=entity)
    tags = r.select(*entity, "tag").distinct()
    g = regularise(b, entity=entity, tags=tags, block_slots=block)
    f = fill_forward(g, entity=entity, block_slots=block)
    flow = f.filter("tag = 'flow'").select(*entity, "slot", "ts", "value")
    lab = upset_labels(flow, entity=entity, baseline_steps=300, min_history=50, horizons={"h": 24},
                       block_slots=block)
    st = event_starts(lab, entity=entity, block_slots=block)
    feats = tag_features(f.select(*entity, "tag", "slot", "ts", "value"), keys=[*entity, "tag"],
                         windows={"a": 6, "b": 30}, lags={"a": 6}, block_slots=block)
    wide = to_wide(f, ["flow", "temp"], entity=entity)
    return f, lab, st, feats, wide


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_entities_equal_separate_runs(spark):
    r = readings(spark)
    together = chain(r, ["plant"], 700)
    for p in ("p1", "p2"):
        alone = chain(r.filter(F.col("plant") == p).drop("plant"), [], None)
        for t, a in zip(together, alone):
            assert same(t.filter(F.col("plant") == p).drop("plant"), a)
    assert together[2].count() >= 2  # one excursion per plant
