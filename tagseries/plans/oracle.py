"""DuckDB SQL that computes the same results as the stage plans, for the value-hash check.

Built from shared CTEs so every query restates the whole chain from the raw ``events``
view.  Floats are compared after ``round(x + 1e-8, 6)`` on both sides.  On the complete
grid, ROWS frames here equal the RANGE-on-slot frames of the Spark side.
"""

from __future__ import annotations

from ..operators.features import ROC_LAGS, STATS, WINDOWS
from . import config as C

STEP_US = C.STEP_S * 1_000_000


def r6(expr: str, digits: int = 6) -> str:
    return f"round(({expr}) + 1e-8, {digits})"


def tag_list() -> str:
    return "[" + ", ".join(f"'{t}'" for t in C.TAGS) + "]"


READINGS = """
r AS (
  SELECT ts, event_type AS tag,
         CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0 THEN -999.0::DOUBLE
              ELSE value END AS value,
         CAST(CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0 THEN 0 ELSE 192 END
              AS INTEGER) AS status
  FROM events)"""

BUCKETS = READINGS + f""",
b AS (
  SELECT tag, CAST(floor(epoch_us(ts) / {STEP_US}.0) AS BIGINT) AS slot,
         avg(CASE WHEN status = 192 THEN value END) AS value,
         avg(CAST(status = 192 AS INTEGER)) AS quality_frac,
         count(*) AS n_raw
  FROM r GROUP BY 1, 2)"""

GRID = BUCKETS + f""",
ext AS (SELECT min(slot) AS lo, max(slot) AS hi FROM b),
tg AS (SELECT unnest({tag_list()}) AS tag),
g0 AS (SELECT tg.tag, unnest(generate_series(ext.lo, ext.hi)) AS slot FROM tg, ext),
g AS (
  SELECT g0.tag, g0.slot, make_timestamp(g0.slot * {STEP_US}) AS ts,
         b.value, b.quality_frac, b.n_raw
  FROM g0 LEFT JOIN b ON g0.tag = b.tag AND g0.slot = b.slot)"""

FILLED = GRID + """,
f AS (
  SELECT tag, slot, ts,
         last_value(value IGNORE NULLS) OVER w AS value,
         last_value(quality_frac IGNORE NULLS) OVER w AS quality_frac,
         CAST(value IS NULL AS INTEGER) AS is_gap_filled
  FROM g
  WINDOW w AS (PARTITION BY tag ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def wide_cte() -> str:
    vals = ",\n         ".join(f"max(CASE WHEN tag = '{t}' THEN value END) AS {t}" for t in C.TAGS)
    qs = ",\n         ".join(f"max(CASE WHEN tag = '{t}' THEN quality_frac END) AS {t}_q" for t in C.TAGS)
    return FILLED + f""",
wd AS (
  SELECT ts, min(slot) AS slot,
         {vals},
         {qs}
  FROM f GROUP BY ts)"""


def labels_cte(threshold: float = C.DROP_THRESHOLD, tag: str = C.LABEL_TAG) -> str:
    factor = f"(1.0::DOUBLE - {threshold!r}::DOUBLE)"
    return FILLED + f""",
s AS (SELECT slot, ts, value FROM f WHERE tag = '{tag}'),
bl AS (
  SELECT slot, ts, value,
         avg(value) OVER w AS baseline_raw,
         count(value) OVER w AS baseline_count
  FROM s WINDOW w AS (ORDER BY slot ROWS BETWEEN 2016 PRECEDING AND 1 PRECEDING)),
fl AS (
  SELECT slot, ts, value, {r6('baseline_raw')} AS baseline_7d, baseline_count,
         baseline_raw, CAST((baseline_raw > 10.0::DOUBLE) AND (value < baseline_raw * {factor}) AS INTEGER) AS is_upset_raw
  FROM bl WHERE baseline_count >= 288),
mg AS (
  SELECT *, max(is_upset_raw) OVER (ORDER BY slot ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS is_upset
  FROM fl),
lb0 AS (
  SELECT *,
         max(is_upset) OVER (ORDER BY slot ROWS BETWEEN 24 FOLLOWING AND 72 FOLLOWING) AS upset_4h,
         max(is_upset) OVER (ORDER BY slot ROWS BETWEEN 24 FOLLOWING AND 168 FOLLOWING) AS upset_12h,
         max(is_upset) OVER (ORDER BY slot ROWS BETWEEN 24 FOLLOWING AND 312 FOLLOWING) AS upset_24h
  FROM mg),
lb AS (SELECT * FROM lb0 WHERE upset_4h IS NOT NULL AND upset_12h IS NOT NULL AND upset_24h IS NOT NULL)"""


def with_(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body.strip()


def stage_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["readings_union"] = with_(READINGS, """
SELECT ts, tag, value, status, CAST(status = 192 AS INTEGER) AS good_quality FROM r""")
    q["resample_5min"] = with_(BUCKETS, f"""
SELECT tag, slot, make_timestamp(slot * {STEP_US}) AS ts, {r6('value')} AS value,
       {r6('quality_frac')} AS quality_frac, n_raw FROM b""")
    q["catalogue_resample"] = q["resample_5min"]
    q["stored_by_year"] = with_(wide_cte(), """
SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS rows, min(ts) AS earliest, max(ts) AS latest
FROM wd GROUP BY 1""")
    q["sink_round_trip"] = with_(BUCKETS + f""",
t AS (SELECT tag, make_timestamp(slot * {STEP_US}) AS ts, value FROM b),
s AS (
  SELECT 'by_year' AS kind, ts - INTERVAL 366 DAY AS ts, value FROM t
  UNION ALL SELECT 'by_year', ts, value * 2 FROM t WHERE tag IN ('{C.TAGS[0]}', '{C.TAGS[1]}')
  UNION ALL SELECT 'plain', ts, value FROM t WHERE tag = '{C.LABEL_TAG}')""", f"""
  SELECT kind, CAST(year(ts) AS INTEGER) AS year, count(*) AS rows, min(ts) AS earliest, max(ts) AS latest,
         {r6("sum(value)", 4)} AS total FROM s GROUP BY 1, 2""")
    q["grid_left_join"] = with_(GRID, f"""
SELECT tag, slot, ts, {r6('value')} AS value, {r6('quality_frac')} AS quality_frac, n_raw FROM g""")
    q["forward_fill"] = with_(FILLED, f"""
SELECT tag, slot, ts, {r6('value')} AS value, {r6('quality_frac')} AS quality_frac, is_gap_filled
FROM f""")
    q["forward_fill_capped"] = with_(GRID + """,
fc AS (
  SELECT tag, slot, ts,
         last_value(value IGNORE NULLS) OVER w AS value,
         last_value(quality_frac IGNORE NULLS) OVER w AS quality_frac,
         CAST(value IS NULL AS INTEGER) AS is_gap_filled,
         slot - last_value(CASE WHEN value IS NOT NULL THEN slot END IGNORE NULLS) OVER w AS age_steps
  FROM g
  WINDOW w AS (PARTITION BY tag ORDER BY slot ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))""", f"""
SELECT tag, slot, ts, {r6('value')} AS value, {r6('quality_frac')} AS quality_frac, is_gap_filled,
       age_steps FROM fc""")
    wide_cols = ", ".join([f"{r6(t)} AS {t}" for t in C.TAGS] + [f"{r6(t + '_q')} AS {t}_q" for t in C.TAGS])
    q["wide_pivot"] = with_(wide_cte(), f"""
SELECT ts, {wide_cols}, CAST(year(ts) AS INTEGER) AS year FROM wd""")
    q["rolling_baseline"] = with_(labels_cte(), f"""
SELECT slot, ts, {r6('value')} AS value, baseline_7d, baseline_count FROM fl""")
    q["upset_flag"] = with_(labels_cte(), f"""
SELECT slot, ts, {r6('value')} AS value, baseline_7d, is_upset_raw FROM fl""")
    q["merged_events"] = with_(labels_cte(), """
SELECT slot, ts, is_upset_raw, is_upset FROM mg""")
    q["forward_labels"] = with_(labels_cte(), f"""
SELECT ts, {r6('value')} AS flow, baseline_7d, is_upset, upset_4h, upset_12h, upset_24h FROM lb""")
    q["forward_labels_raw_lead"] = with_(labels_cte() + """,
rl AS (
  SELECT ts, value, baseline_7d, is_upset,
         max(is_upset_raw) OVER (ORDER BY slot ROWS BETWEEN 24 FOLLOWING AND 72 FOLLOWING) AS upset_4h,
         max(is_upset_raw) OVER (ORDER BY slot ROWS BETWEEN 24 FOLLOWING AND 168 FOLLOWING) AS upset_12h,
         max(is_upset_raw) OVER (ORDER BY slot ROWS BETWEEN 24 FOLLOWING AND 312 FOLLOWING) AS upset_24h
  FROM mg)""", f"""
SELECT ts, {r6('value')} AS flow, baseline_7d, is_upset, upset_4h, upset_12h, upset_24h FROM rl
WHERE upset_4h IS NOT NULL AND upset_12h IS NOT NULL AND upset_24h IS NOT NULL""")
    q["forward_labels_full_horizon"] = with_(labels_cte() + """,
fh AS (
  SELECT ts, value, baseline_7d, is_upset,
         CASE WHEN slot + 72 <= (SELECT max(slot) FROM mg) THEN upset_4h END AS upset_4h,
         CASE WHEN slot + 168 <= (SELECT max(slot) FROM mg) THEN upset_12h END AS upset_12h,
         CASE WHEN slot + 312 <= (SELECT max(slot) FROM mg) THEN upset_24h END AS upset_24h
  FROM lb0)""", f"""
SELECT ts, {r6('value')} AS flow, baseline_7d, is_upset, upset_4h, upset_12h, upset_24h FROM fh
WHERE upset_4h IS NOT NULL AND upset_12h IS NOT NULL AND upset_24h IS NOT NULL""")
    q["event_starts"] = with_(labels_cte() + """,
ev AS (SELECT ts, is_upset, lag(is_upset) OVER (ORDER BY slot) AS prev FROM lb)""", """
SELECT ts FROM ev WHERE is_upset = 1 AND (prev = 0 OR prev IS NULL)""")
    q["event_count"] = with_(labels_cte() + """,
ev AS (SELECT ts, is_upset, lag(is_upset) OVER (ORDER BY slot) AS prev FROM lb)""", """
SELECT count(*) AS n_distinct_upset_events FROM ev WHERE is_upset = 1 AND (prev = 0 OR prev IS NULL)""")
    rates = ", ".join(f"{r6(f'CAST(sum({l}) AS DOUBLE) / CAST(count(*) AS DOUBLE)')} AS {l}_rate"
                      for l in C.LABEL_COLS)
    q["label_summary"] = with_(labels_cte(), f"""
SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
       CAST(sum(CASE WHEN is_upset = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_upset_rows,
       CAST(sum(CASE WHEN is_upset = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_normal_rows,
       {rates}
FROM lb""")
    return q


# ---------------------------------------------------------------- stage 3: features
def _q(name: str) -> str:
    return f'"{name}"'


def stat_names() -> list[str]:
    return [f"{w}_{s}" for w in WINDOWS for s in STATS]


def roc_names() -> list[str]:
    return [f"roc_{w}" for w in ROC_LAGS]


def long_features_cte() -> str:
    exprs = []
    for w, k in WINDOWS.items():
        win = f"(PARTITION BY tag ORDER BY slot ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        exprs += [f"avg(value) OVER {win} AS {_q(w + '_mean')}",
                  f"stddev_samp(value) OVER {win} AS {_q(w + '_std')}",
                  f"min(value) OVER {win} AS {_q(w + '_min')}",
                  f"max(value) OVER {win} AS {_q(w + '_max')}",
                  f"max(value) OVER {win} - min(value) OVER {win} AS {_q(w + '_range')}"]
    for w, k in ROC_LAGS.items():
        lag = f"lag(value, {k}) OVER (PARTITION BY tag ORDER BY slot)"
        exprs.append(f"(value - {lag}) / (abs({lag}) + 1e-6) AS {_q('roc_' + w)}")
    tags = ", ".join(f"'{t}'" for t in C.SENSOR_COLS)
    return FILLED + f""",
tf AS (
  SELECT tag, slot, ts, value, quality_frac,
         {(',' + chr(10) + '         ').join(exprs)}
  FROM f WHERE tag IN ({tags}))"""


def wide_features_cte() -> str:
    cols = []
    for t in C.SENSOR_COLS:
        cols.append(f"max(CASE WHEN tag = '{t}' THEN value END) AS {t}")
        cols.append(f"max(CASE WHEN tag = '{t}' THEN quality_frac END) AS {t}_q")
        names = stat_names() + (roc_names() if t in C.ROC_COLS else [])
        cols += [f"max(CASE WHEN tag = '{t}' THEN {_q(n)} END) AS {_q(t + '_' + n)}" for n in names]
    return long_features_cte() + f""",
wf AS (
  SELECT ts, {(',' + chr(10) + '         ').join(cols)}
  FROM tf GROUP BY ts)"""


def cross_exprs() -> dict[str, str]:
    out = {}
    for name, (a, b) in C.SHARE.items():
        out[name] = f"{a} / (({a} + {b}) + 1e-6)"
    for name, (a, b) in C.IMBALANCE.items():
        out[name] = f"abs({a} - {b}) / (({a} + {b}) + 1e-6)"
    for name, (a, b) in C.RATIO.items():
        out[name] = f"{a} / ({b} + 1e-6)"
    for name, cols in C.SPREAD.items():
        out[name] = f"greatest({', '.join(cols)}) - least({', '.join(cols)})"
    return out


def quality_expr() -> str:
    qs = [f"{t}_q" for t in C.SENSOR_COLS]
    num = " + ".join(f"coalesce({q}, 0.0::DOUBLE)" for q in qs)
    den = " + ".join(f"CAST({q} IS NOT NULL AS DOUBLE)" for q in qs)
    return f"({num}) / NULLIF({den}, 0)"


CALENDAR = {"hour_of_day": "CAST(hour(ts) AS INTEGER)",
            "day_of_week": "CAST(isodow(ts) - 1 AS INTEGER)",
            "is_weekend": "CAST(isodow(ts) IN (6, 7) AS INTEGER)"}


def feature_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    sn = stat_names()
    q["rolling_stats"] = with_(long_features_cte(), f"""
SELECT tag, slot, ts, {', '.join(f"{r6(_q(n))} AS {_q(n)}" for n in sn)} FROM tf""")
    q["rate_of_change"] = with_(long_features_cte(), f"""
SELECT tag, slot, ts, {', '.join(f"{r6(_q(n))} AS {_q(n)}" for n in roc_names())}
FROM tf WHERE tag IN ({', '.join(f"'{t}'" for t in C.ROC_COLS)})""")
    cx = cross_exprs()
    q["cross_tag_features"] = with_(wide_cte(), f"""
SELECT ts, {', '.join(f'{r6(e)} AS {n}' for n, e in cx.items())} FROM wd""")
    q["row_quality"] = with_(wide_cte(), f"""
SELECT ts, {r6(quality_expr())} AS overall_quality FROM wd""")
    q["calendar_features"] = with_(wide_cte(), f"""
SELECT ts, {', '.join(f'{e} AS {n}' for n, e in CALENDAR.items())} FROM wd""")
    q["baseline_deviation"] = with_(_baseline_dev_ctes(), f"""
SELECT j.ts, {r6(f'(j.{C.LABEL_TAG} - j.baseline_7d) / (j.baseline_7d + 1e-6)')} AS flow_vs_baseline FROM j""")
    q["feature_matrix"] = feature_matrix_sql()
    return q


def _labels_only_ctes() -> str:
    """The label CTEs (s .. lb) without the stage-1 prefix (to append to another chain)."""
    full = labels_cte()
    return full[len(FILLED):]


def _baseline_dev_ctes() -> str:
    return wide_cte() + _labels_only_ctes() + f""",
j AS (SELECT wd.ts, wd.{C.LABEL_TAG}, lb.baseline_raw AS baseline_7d FROM wd JOIN lb ON wd.ts = lb.ts)"""


def feature_matrix_sql() -> str:
    ctes = wide_features_cte() + _labels_only_ctes() + """,
j AS (SELECT wf.*, lb.is_upset, lb.upset_4h, lb.upset_12h, lb.upset_24h, lb.baseline_raw AS baseline_7d
      FROM wf JOIN lb ON wf.ts = lb.ts)"""
    cols = ["ts", "is_upset", "upset_4h", "upset_12h", "upset_24h", f"{r6('baseline_7d')} AS baseline_7d"]
    for t in C.SENSOR_COLS:
        names = stat_names() + (roc_names() if t in C.ROC_COLS else [])
        cols += [f"{r6(_q(t + '_' + n))} AS {_q(t + '_' + n)}" for n in names]
    cols += [f"{r6(e)} AS {n}" for n, e in cross_exprs().items()]
    cols.append(f"{r6(quality_expr())} AS overall_quality")
    cols += [f"{e} AS {n}" for n, e in CALENDAR.items()]
    cols.append(f"{r6(f'({C.LABEL_TAG} - baseline_7d) / (baseline_7d + 1e-6)')} AS flow_vs_baseline")
    return with_(ctes, f"""
SELECT {', '.join(cols)}
FROM j WHERE ts >= TIMESTAMP '{C.WARMUP_UNTIL}' AND {C.TARGET} IS NOT NULL""")


# ---------------------------------------------------------------- audits, slices, metrics
SCORES = """
sc AS (
  SELECT event_id, ts,
         CAST(CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AS INTEGER) AS label,
         round(value / (value + 50.0::DOUBLE) + 1e-8, 6) AS score
  FROM events)"""

CONFUSION = SCORES + """,
cm AS (
  SELECT CAST(sum(CASE WHEN score < 0.5 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN score >= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN score < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM sc)"""

CUMULATIVE = SCORES + """,
d AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
      FROM sc GROUP BY score),
c AS (SELECT score, pos, neg,
             sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
      FROM d)"""


def _dz(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0::DOUBLE END"


def audit_eval_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    cols = ", ".join(f"{r6(t)} AS {t}" for t in C.TAGS)
    q["time_slice_topk"] = with_(wide_cte(), f"""
SELECT ts, {cols} FROM wd
WHERE ts BETWEEN TIMESTAMP '{C.SLICE_START}' AND TIMESTAMP '{C.SLICE_END}'
ORDER BY ts LIMIT 50""")
    q["time_split_balance"] = with_(wide_features_cte() + _labels_only_ctes() + f""",
m AS (SELECT lb.ts, lb.{C.TARGET} AS y FROM wf JOIN lb ON wf.ts = lb.ts
      WHERE lb.ts >= TIMESTAMP '{C.WARMUP_UNTIL}' AND lb.{C.TARGET} IS NOT NULL),
sp AS (SELECT 'train' AS split, y FROM m WHERE ts <= TIMESTAMP '{C.TRAIN_END}'
       UNION ALL SELECT 'test' AS split, y FROM m WHERE ts >= TIMESTAMP '{C.TEST_START}')""", f"""
SELECT split, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
       {r6('CAST(sum(y) AS DOUBLE) / CAST(count(*) AS DOUBLE)')} AS pos_rate,
       {r6('CAST(sum(1 - y) AS DOUBLE) / CAST(greatest(sum(y), 1) AS DOUBLE)')} AS scale_pos_weight
FROM sp GROUP BY split""")
    q["tag_health"] = with_(READINGS, f"""
SELECT tag, date_trunc('month', ts) AS period, count(*) AS n_readings,
       {r6("avg(CASE WHEN status = 192 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)")} AS bad_share,
       {r6("avg(CASE WHEN value = -999.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS sentinel_share,
       {r6("avg(CASE WHEN status = 192 THEN value END)")} AS mean_value,
       {r6("min(CASE WHEN status = 192 THEN value END)")} AS min_value,
       {r6("max(CASE WHEN status = 192 THEN value END)")} AS max_value,
       {r6("min(value)")} AS min_raw
FROM r GROUP BY 1, 2""")
    q["tag_status"] = with_(READINGS + """,
ts0 AS (
  SELECT tag, count(*) AS n_readings, count(CASE WHEN status = 192 THEN value END) AS n_good,
         min(CASE WHEN status = 192 THEN value END) AS min_value,
         max(CASE WHEN status = 192 THEN value END) AS max_value,
         max(abs(CASE WHEN status = 192 THEN value END)) AS max_abs,
         avg(CASE WHEN value = -999.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sentinel_share
  FROM r GROUP BY tag)""", f"""
SELECT tag, n_readings, n_good, {r6('min_value')} AS min_value, {r6('max_value')} AS max_value,
       {r6('sentinel_share')} AS sentinel_share,
       CASE WHEN n_good = 0 THEN 'no_data' WHEN max_abs = 0.0 THEN 'dead'
            WHEN min_value = max_value THEN 'stuck' WHEN max_value < 0.0 THEN 'out_of_range'
            WHEN sentinel_share > 0.5 THEN 'failing' ELSE 'ok' END AS status
FROM ts0""")
    q["level_shift"] = with_(READINGS, f"""
SELECT tag, {r6(f"avg(CASE WHEN status = 192 AND ts < TIMESTAMP '{C.SHIFT_AT}' THEN value END)")} AS mean_before,
       {r6(f"avg(CASE WHEN status = 192 AND ts >= TIMESTAMP '{C.SHIFT_AT}' THEN value END)")} AS mean_after,
       {r6(f"avg(CASE WHEN status = 192 AND ts >= TIMESTAMP '{C.SHIFT_AT}' THEN value END) / NULLIF(avg(CASE WHEN status = 192 AND ts < TIMESTAMP '{C.SHIFT_AT}' THEN value END), 0)")} AS shift_ratio
FROM r GROUP BY tag""")
    q["confusion"] = with_(CONFUSION, f"""
SELECT tn, fp, fn, tp,
       {r6('100.0::DOUBLE * tp / greatest(tp + fn, 1)')} AS caught_pct,
       {r6('CAST(fp AS DOUBLE) / greatest(fp + tn, 1)')} AS false_alarm_share
FROM cm""")
    tp, fp, fn, tn = ("CAST(tp AS DOUBLE)", "CAST(fp AS DOUBLE)", "CAST(fn AS DOUBLE)", "CAST(tn AS DOUBLE)")
    p1, r1 = _dz(tp, f"{tp} + {fp}"), _dz(tp, f"{tp} + {fn}")
    p0, r0 = _dz(tn, f"{tn} + {fn}"), _dz(tn, f"{tn} + {fp}")
    q["classification_report"] = with_(CONFUSION + f""",
pr AS (SELECT {p0} AS p0, {r0} AS r0, {p1} AS p1, {r1} AS r1, {tn} + {fp} AS s0, {tp} + {fn} AS s1,
              {_dz(f'{tp} + {tn}', f'{tp} + {tn} + {fp} + {fn}')} AS acc FROM cm),
pf AS (SELECT *, {_dz('2 * p0 * r0', 'p0 + r0')} AS f0, {_dz('2 * p1 * r1', 'p1 + r1')} AS f1,
              s0 + s1 AS n FROM pr)""", f"""
SELECT 'Normal' AS class, {r6('p0')} AS precision, {r6('r0')} AS recall, {r6('f0')} AS f1_score,
       CAST(s0 AS BIGINT) AS support FROM pf
UNION ALL SELECT 'Upset', {r6('p1')}, {r6('r1')}, {r6('f1')}, CAST(s1 AS BIGINT) FROM pf
UNION ALL SELECT 'accuracy', NULL, NULL, {r6('acc')}, CAST(n AS BIGINT) FROM pf
UNION ALL SELECT 'macro avg', {r6('(p0 + p1) / 2')}, {r6('(r0 + r1) / 2')}, {r6('(f0 + f1) / 2')},
       CAST(n AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', {r6(_dz('p0 * s0 + p1 * s1', 'n'))}, {r6(_dz('r0 * s0 + r1 * s1', 'n'))},
       {r6(_dz('f0 * s0 + f1 * s1', 'n'))}, CAST(n AS BIGINT) FROM pf""")
    q["roc_auc_ap"] = with_(CUMULATIVE, f"""
SELECT {r6('(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) + sum(pos * (0.5::DOUBLE * neg - fp))) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))')} AS roc_auc,
       {r6('sum(pos * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))) / CAST(sum(pos) AS DOUBLE)')} AS average_precision,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM c""")
    q["pr_curve"] = with_(CUMULATIVE, f"""
SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       {r6('CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)')} AS precision,
       {r6('CAST(tp AS DOUBLE) / greatest((SELECT sum(pos) FROM d), 1)')} AS recall
FROM c""")
    q["threshold_sweep"] = with_(SCORES + """,
th AS (SELECT k, 0.1::DOUBLE + k * ((0.1::DOUBLE + 0.05::DOUBLE) - 0.1::DOUBLE) AS t FROM range(16) r(k)),
sw AS (SELECT th.t, CAST(sum(CASE WHEN sc.score >= th.t AND sc.label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
              CAST(sum(CASE WHEN sc.score >= th.t AND sc.label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
              CAST(sum(CASE WHEN sc.score < th.t AND sc.label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
       FROM th, sc GROUP BY th.t)""", """
SELECT round(t, 2) AS threshold,
       round(CAST(tp AS DOUBLE) / greatest(tp + fn, 1) + 1e-8, 3) AS recall,
       round(CAST(tp AS DOUBLE) / greatest(tp + fp, 1) + 1e-8, 3) AS precision,
       CAST(fp AS INTEGER) AS false_alarms, CAST(tp AS INTEGER) AS upsets_caught,
       CAST(fn AS INTEGER) AS upsets_missed
FROM sw""")
    q["score_timeline"] = with_(SCORES, """
SELECT ts, score, label, CAST(score >= 0.5 AS INTEGER) AS alarm FROM sc""")
    q["top_scores"] = with_(SCORES, """
SELECT event_id, score, label FROM sc ORDER BY score DESC, event_id LIMIT 25""")
    circular = " OR ".join(f"starts_with(c, '{p}')" for p in C.CIRCULAR_PREFIXES)
    kept = ", ".join(f"'{c}'" for c in C.KEEP_COLS)
    q["feature_selection"] = f"""
WITH m AS ({feature_matrix_sql()}),
n AS (SELECT count(COLUMNS(lambda c: c NOT IN ({kept}) AND NOT ({circular}))) FROM m)
SELECT feature, n_values FROM (UNPIVOT n ON COLUMNS(*) INTO NAME feature VALUE n_values)"""
    q["gbt_scored_rows"] = f"""
WITH m AS ({feature_matrix_sql()})
SELECT count(*) AS n_rows, CAST(sum({C.TARGET}) AS BIGINT) AS n_pos, count(*) AS n_scored, min(ts) AS first_ts, max(ts) AS last_ts
FROM m WHERE ts >= TIMESTAMP '{C.TEST_START}'"""
    q["total_order"] = with_(READINGS, """
  SELECT ts, tag, value, status,
         row_number() OVER (ORDER BY ts NULLS FIRST, tag NULLS FIRST, value NULLS FIRST, status NULLS FIRST) AS position FROM r""")
    q["sample_rows"] = with_(SCORES, """
SELECT * FROM sc ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 2000""")
    return q
