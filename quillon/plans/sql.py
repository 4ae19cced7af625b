"""DuckDB SQL that the credit-risk queries must equal."""

from __future__ import annotations

from quillon.operators.features import EVENT_TYPES
from quillon.operators.labels import EDGES
from quillon.operators.portfolio import BANDS, LGD, LGD_OTHER, SCENARIOS

_STAMP = "'%Y-%m-%d %H:%M:%S'"
_MONEY = "sum({}::DECIMAL(18,2))::DOUBLE"

_BASE = """base AS (
  SELECT o_orderkey AS account, c_custkey AS borrower, o_totalprice AS exposure, o_orderdate AS opened, o_orderstatus AS status,
         c_acctbal AS balance, c_mktsegment AS segment, n_name AS nation, r_name AS region
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
_LABEL = """label AS (
  SELECT l_orderkey AS account, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS missed,
         CASE WHEN 2 * count(*) FILTER (WHERE l_returnflag = 'R') >= count(*) THEN 1 ELSE 0 END::BIGINT AS bad FROM lineitem GROUP BY 1
)"""
_Z = "(-0.6 - 0.8 * (balance / 10000) + 1.2 * (exposure / 500000) + 0.3 * CASE WHEN status = 'P' THEN 1 ELSE 0 END)::DOUBLE"
_CARD = f"""card AS (
  SELECT *, round(p0, 6) AS pd, round(500.0 + 20.0 / ln(2.0::DOUBLE) * ln((1 - p0) / p0), 6) AS points
  FROM (SELECT *, 1 / (1 + exp(-{_Z}))::DOUBLE AS p0 FROM base)
)"""
_SCORED = f"{_BASE}, {_LABEL}, {_CARD}, scored AS (SELECT card.*, bad FROM card JOIN label USING (account))"
_LGD = "CASE segment " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in LGD) + f" ELSE {LGD_OTHER} END::DOUBLE"
_LOSS = f"{_BASE}, {_CARD}, losses AS (SELECT *, {_LGD} AS lgd, round(pd * {_LGD} * exposure, 2) AS loss FROM card)"
_LINES = "lines AS (SELECT o_orderkey, o_custkey, o_orderdate, l_shipdate, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_OPENED = """opened AS (
  SELECT o_orderkey AS account, count(*) OVER w AS opened, (sum(o_totalprice::DECIMAL(18,2)) OVER w)::DOUBLE AS opened_exposure
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW)
)"""
_COUNTS = f"""{_SCORED}, counts AS (SELECT pd AS score, count(*) FILTER (WHERE bad = 0) AS g, count(*) FILTER (WHERE bad = 1) AS b FROM scored GROUP BY 1),
runs AS (SELECT *, sum(g) OVER (ORDER BY score) AS cg, sum(b) OVER (ORDER BY score) AS cb, sum(g) OVER () AS tg, sum(b) OVER () AS tb FROM counts)"""


def _cuts(table: str, column: str, n: int) -> str:
    return f"(SELECT quantile_disc({column}, [{', '.join(str(round(i / n, 10)) for i in range(1, n))}]) AS q FROM {table})"


def _bin(column: str) -> str:
    return f"(1 + len(list_filter(q, lambda c: c < {column})))::BIGINT"


_BINNED = f"{_SCORED}, binned AS (SELECT s.*, {_bin('pd')} AS bin FROM scored s, {_cuts('scored', 'pd', 10)} c)"

SQL: dict[str, str] = {}

SQL["read_orders"] = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderstatus = 'F'"
SQL["profile_customer"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest FROM customer"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
)
SQL["key_check_lines"] = """
WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM k) AS surplus_rows, (SELECT count(*) FROM k WHERE n > 1) AS repeated_keys,
       (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphan_rows"""
SQL["account_base"] = f"WITH {_BASE} SELECT * REPLACE (strftime(opened, {_STAMP}) AS opened) FROM base"
SQL["borrower_features"] = f"""
WITH l AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS missed FROM lineitem GROUP BY 1)
SELECT o_custkey AS borrower, count(*) AS accounts, {_MONEY.format('o_totalprice')} AS exposure, round({_MONEY.format('o_totalprice')} / count(*), 6) AS mean_exposure,
       round(sum(missed)::DOUBLE / sum(lines), 6) AS missed_share,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS accounts_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS accounts_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS accounts_p
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1"""
SQL["velocity"] = f"WITH {_OPENED} SELECT * FROM opened"
SQL["recency"] = """
SELECT o_orderkey AS account, row_number() OVER w AS sequence, date_diff('day', lag(o_orderdate::DATE) OVER w, o_orderdate::DATE) AS days_since
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
_LAST = "r AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2)"
SQL["asof_features"] = f"""
WITH {_LAST} SELECT event_id, o_orderkey, o_totalprice, strftime(o_orderdate, {_STAMP}) AS asof
FROM events e ASOF LEFT JOIN r ON e.user_id = r.o_custkey AND e.ts >= r.o_orderdate"""
SQL["asof_ship_dates"] = f"""
WITH {_LINES}, {_LAST} SELECT r.o_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS missed
FROM lines l ASOF LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.l_shipdate >= r.o_orderdate GROUP BY 1"""
SQL["status_pivot"] = f"WITH {_BASE} SELECT borrower, " + ", ".join(f"coalesce(sum(exposure::DECIMAL(18,2)) FILTER (WHERE status = '{s}'), 0)::DOUBLE AS exposure_{s.lower()}" for s in "FOP") + " FROM base GROUP BY 1"
SQL["winsorise"] = f"WITH {_BASE}, c AS (SELECT quantile_disc(exposure, 0.05) AS lo, quantile_disc(exposure, 0.95) AS hi FROM base) SELECT account, exposure, greatest(least(exposure, hi), lo) AS exposure_w FROM base, c"
SQL["impute"] = """
WITH m AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 != 0 THEN c_acctbal END AS v FROM customer), q AS (SELECT c_mktsegment, quantile_disc(v, 0.5) AS d FROM m GROUP BY 1)
SELECT c_custkey, m.c_mktsegment, coalesce(v, d) AS c_acctbal, v IS NULL AS c_acctbal_missing FROM m JOIN q USING (c_mktsegment)"""
SQL["policy_rules"] = f"""
WITH {_BASE}, {_OPENED}, f AS (
  SELECT account, list_filter([CASE WHEN balance < 0 THEN 'balance_negative' END, CASE WHEN exposure > 450000 THEN 'exposure_cap' END, CASE WHEN opened.opened > 2 THEN 'velocity_cap' END], lambda x: x IS NOT NULL) AS r
  FROM base JOIN opened USING (account)
) SELECT account, array_to_string(r, ',') AS reasons, len(r)::BIGINT AS n_reasons FROM f"""
SQL["event_features"] = "SELECT user_id AS borrower, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in EVENT_TYPES) + f""", {_MONEY.format('round(value, 2)')} AS value,
       round(sum((props::JSON ->> 'k')::INT)::DOUBLE / count((props::JSON ->> 'k')::INT), 6) AS mean_k FROM events GROUP BY 1"""
SQL["default_label"] = f"WITH {_LABEL} SELECT * FROM label"
_BUCKET = "CASE " + " ".join(f"WHEN d > {e} THEN {k}" for k, e in reversed([*enumerate(EDGES, 1)])) + " ELSE 0 END::BIGINT"
SQL["delinquency_bucket"] = f"""
WITH {_LINES}, late AS (SELECT *, greatest(0, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS d FROM lines)
SELECT {_BUCKET} AS bucket, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS missed, sum(d)::BIGINT AS days_late FROM late GROUP BY 1"""
SQL["roll_rates"] = f"""
WITH {_LINES}, days AS (SELECT o_custkey, l_shipdate::DATE AS day, max((l_returnflag = 'R')::INT) AS missed FROM lines GROUP BY 1, 2),
moves AS (SELECT lag(missed) OVER (PARTITION BY o_custkey ORDER BY day) AS before, missed AS after FROM days)
SELECT before, after, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY before), 6) AS share FROM moves WHERE before IS NOT NULL GROUP BY 1, 2"""
SQL["vintage_curve"] = f"""
WITH {_LINES}, aged AS (
  SELECT o_orderkey, date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS quarter,
         min(CASE WHEN l_returnflag = 'R' THEN greatest(0, CASE WHEN l_shipdate::DATE >= o_orderdate::DATE THEN datesub('year', o_orderdate::DATE, l_shipdate::DATE) ELSE 0 END) END) AS age
  FROM lines GROUP BY ALL
), totals AS (SELECT quarter, count(*) AS accounts FROM aged GROUP BY 1)
SELECT t.quarter, a.age::BIGINT AS age, accounts, (SELECT count(*) FROM aged x WHERE x.quarter = t.quarter AND x.age <= a.age) AS missed_by,
       round((SELECT count(*) FROM aged x WHERE x.quarter = t.quarter AND x.age <= a.age)::DOUBLE / accounts, 6) AS missed_share
FROM totals t, range(0, 7) a(age)"""
SQL["quantile_bins"] = f"WITH {_BASE} SELECT {_bin('balance')} AS bin, count(*) AS n, min(balance) AS least, max(balance) AS greatest FROM base, {_cuts('base', 'balance', 10)} c GROUP BY 1"
SQL["woe_iv"] = f"""
WITH {_SCORED}, b AS (SELECT bad, {_bin('balance')} AS bin FROM scored, {_cuts('scored', 'balance', 10)} c),
per AS (SELECT bin, count(*) FILTER (WHERE bad = 0) AS goods, count(*) FILTER (WHERE bad = 1) AS bads FROM b GROUP BY 1),
s AS (SELECT *, (goods + 0.5::DOUBLE) / (sum(goods) OVER () + 0.5::DOUBLE) AS x, (bads + 0.5::DOUBLE) / (sum(bads) OVER () + 0.5::DOUBLE) AS y FROM per)
SELECT bin, goods, bads, round(ln(x / y), 6) AS woe, round((x - y) * ln(x / y), 6) AS iv FROM s"""
SQL["split"] = f"WITH {_BASE} SELECT CASE WHEN opened >= TIMESTAMP '2000-07-01' THEN 'out_of_time' WHEN account % 10 < 3 THEN 'holdout' ELSE 'train' END AS part, count(*) AS n, sum(account)::BIGINT AS keys FROM base GROUP BY 1"
SQL["apply_scorecard"] = f"WITH {_BASE}, {_CARD} SELECT account, pd, points FROM card"
SQL["reason_codes"] = f"""
WITH {_BASE}, parts AS (
  SELECT account, unnest([struct_pack(v := round(-0.8::DOUBLE * (balance / 10000), 9), name := 'balance'), struct_pack(v := round(1.2::DOUBLE * (exposure / 500000), 9), name := 'exposure'),
                          struct_pack(v := round(0.3::DOUBLE * CASE WHEN status = 'P' THEN 1 ELSE 0 END, 9), name := 'pending')]) AS p FROM base
), ranked AS (SELECT account, p.name AS name, row_number() OVER (PARTITION BY account ORDER BY p.v DESC, p.name) AS k FROM parts)
SELECT account, string_agg(name, ',' ORDER BY k) AS reasons FROM ranked WHERE k <= 2 GROUP BY 1"""
SQL["auc_gini"] = f"WITH {_COUNTS}, a AS (SELECT sum(b * (cg - g / 2.0::DOUBLE)) / max(tg * tb) AS x FROM runs) SELECT round(x, 6) AS auc, round(2 * x - 1, 6) AS gini FROM a"
SQL["ks"] = f"WITH {_COUNTS}, d AS (SELECT score, round(abs(cg::DOUBLE / tg - cb::DOUBLE / tb), 9) AS gap FROM runs) SELECT round(gap, 6) AS ks, score FROM d ORDER BY gap DESC, score LIMIT 1"
SQL["gains_table"] = f"""
WITH {_BINNED}, per AS (SELECT bin, count(*) AS accounts, sum(bad)::BIGINT AS bads FROM binned GROUP BY 1)
SELECT bin, accounts, bads, round(bads::DOUBLE / accounts, 6) AS bad_rate, round(sum(bads) OVER (ORDER BY bin DESC)::DOUBLE / sum(bads) OVER (), 6) AS capture,
       round((bads::DOUBLE / accounts) / (sum(bads) OVER ()::DOUBLE / sum(accounts) OVER ()), 6) AS lift FROM per"""
SQL["confusion"] = f"""
WITH {_SCORED}, t(threshold) AS (VALUES (0.3::DOUBLE), (0.4), (0.5), (0.6)),
c AS (SELECT threshold, count(*) FILTER (WHERE pd >= threshold AND bad = 1) AS tp, count(*) FILTER (WHERE pd >= threshold AND bad = 0) AS fp,
             count(*) FILTER (WHERE pd < threshold AND bad = 1) AS fn, count(*) FILTER (WHERE pd < threshold AND bad = 0) AS tn FROM scored, t GROUP BY 1)
SELECT threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) END, 6) AS f1, (fp + 5.0 * fn)::DOUBLE AS cost FROM c"""
SQL["calibration"] = f"""
WITH {_BINNED}, per AS (
  SELECT bin, count(*) AS n, sum(pd::DECIMAL(18,6))::DOUBLE AS p, sum(bad)::BIGINT AS b, sum(round((pd - bad) * (pd - bad), 12)::DECIMAL(24,12))::DOUBLE AS s FROM binned GROUP BY 1
) SELECT bin, n AS accounts, round(p / n, 6) AS mean_pd, round(b::DOUBLE / n, 6) AS bad_rate, round(sum(s) OVER () / sum(n) OVER (), 6) AS brier,
         round(sum((b - p) * (b - p) / (p * (1 - p / n))) OVER (), 4) AS hosmer_lemeshow FROM per"""
SQL["psi"] = f"""
WITH {_BINNED}, c AS (SELECT strftime(opened, '%Y') AS year, bin, count(*) AS n FROM binned GROUP BY 1, 2),
s AS (SELECT year, bin, n::DOUBLE / sum(n) OVER (PARTITION BY year) AS share FROM c),
g AS (SELECT y.year, b.bin, greatest(coalesce(a.share, 0), 0.0001) AS a, greatest(coalesce(e.share, 0), 0.0001) AS e
      FROM (SELECT DISTINCT year FROM s) y CROSS JOIN (SELECT DISTINCT bin FROM s) b LEFT JOIN s a ON a.year = y.year AND a.bin = b.bin LEFT JOIN s e ON e.year = '1995' AND e.bin = b.bin)
SELECT year, round(sum((a - e) * ln(a / e)), 6) AS psi FROM g GROUP BY 1"""
SQL["segment_outliers"] = f"""
WITH {_SCORED}, per AS (SELECT region, segment, count(*) AS n, sum(bad) AS b, sum(bad)::DOUBLE / count(*) AS rate FROM scored GROUP BY 1, 2),
z AS (SELECT *, (rate - sum(b) OVER ()::DOUBLE / sum(n) OVER ()) / stddev_samp(rate) OVER () AS z0 FROM per)
SELECT region, segment, round(rate, 6) AS bad_rate, round(z0, 4) AS z FROM z WHERE abs(z0) > 1"""
SQL["expected_loss"] = f"WITH {_LOSS} SELECT account, pd, lgd, loss FROM losses"
_AMOUNTS = f"{_MONEY.format('exposure')} AS exposure, {_MONEY.format('loss')} AS loss"
SQL["expected_loss_rollup"] = f"WITH {_LOSS} SELECT region, segment, count(*) AS accounts, {_AMOUNTS}, grouping(region, segment)::BIGINT AS level FROM losses GROUP BY ROLLUP (region, segment)"
for _name, _form in (("exposure_cube", "CUBE (region, segment, status)"), ("exposure_rollup", "ROLLUP (region, segment, status)"), ("exposure_sets", "GROUPING SETS ((region), (segment), (status), ())")):
    SQL[_name] = f"WITH {_LOSS} SELECT region, segment, status, {_AMOUNTS}, grouping(region, segment, status)::BIGINT AS level FROM losses GROUP BY {_form}"
SQL["concentration"] = f"""
WITH {_BASE}, per AS (SELECT region, borrower, {_MONEY.format('exposure')} AS exposure FROM base GROUP BY 1, 2),
s AS (SELECT *, exposure / {_MONEY.format('exposure').replace('::DOUBLE', '')} OVER (PARTITION BY region)::DOUBLE AS share FROM per),
h AS (SELECT region, round(sum(round(share * share, 15)::DECIMAL(30,15))::DOUBLE, 9) AS herfindahl FROM s GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY exposure DESC, borrower) AS rank FROM s)
SELECT region, rank, borrower, exposure, round(share, 9) AS share, herfindahl FROM k JOIN h USING (region) WHERE rank <= 3"""
_SCENARIOS = ", ".join(f"('{n}', {p}::DOUBLE, {v}::DOUBLE)" for n, p, v in SCENARIOS)
SQL["stress"] = f"""
WITH {_LOSS}, t(scenario, fp, fl) AS (VALUES {_SCENARIOS})
SELECT scenario, region, sum(round(least(1.0::DOUBLE, pd * fp) * least(1.0::DOUBLE, lgd * fl) * exposure, 6)::DECIMAL(24,6))::DOUBLE AS loss FROM losses, t GROUP BY 1, 2"""
SQL["watchlist"] = f"""
WITH {_BASE}, a AS (SELECT DISTINCT borrower FROM base WHERE status = 'P' AND opened < TIMESTAMP '1999-01-01' AND exposure > 400000),
b AS (SELECT DISTINCT borrower FROM base WHERE status = 'P' AND opened >= TIMESTAMP '1999-01-01' AND exposure > 400000),
m AS (SELECT borrower, CASE WHEN a.borrower IS NULL THEN 'new' WHEN b.borrower IS NULL THEN 'cleared' ELSE 'kept' END AS move FROM a FULL JOIN b USING (borrower))
SELECT borrower, move FROM m WHERE borrower NOT IN (SELECT borrower FROM base WHERE balance > 9500)"""
_BAND = "CASE " + " ".join(f"WHEN pd >= {a} AND pd < {b} THEN '{r}'" for r, a, b in BANDS) + " END"
SQL["risk_bands"] = f"WITH {_BASE}, {_CARD} SELECT account, pd, {_BAND} AS rating FROM card"
SQL["dedup_events"] = f"SELECT event_id, user_id, event_type, strftime(ts, {_STAMP}) AS at FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1"
SQL["activity_windows"] = f"SELECT strftime(date_trunc('day', ts), {_STAMP}) AS start, event_type, count(*) AS n, {_MONEY.format('round(value, 2)')} AS value FROM events GROUP BY 1, 2"
SQL["activity_windows_sliding"] = f"""
SELECT strftime(date_trunc('day', ts) - to_days(o::INT), {_STAMP}) AS start, event_type, count(*) AS n, {_MONEY.format('round(value, 2)')} AS value FROM events, range(0, 2) t(o) GROUP BY 1, 2"""
SQL["activity_sessions"] = f"""
WITH f AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS, FALSE)::INT AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM f)
SELECT user_id, strftime(min(ts), {_STAMP}) AS start, strftime(max(ts), {_STAMP}) AS last, count(*) AS n FROM s GROUP BY user_id, k"""
SQL["score_stream"] = f"""
WITH b AS (SELECT o_custkey, count(*) AS accounts, {_MONEY.format('o_totalprice')} AS exposure FROM orders GROUP BY 1)
SELECT event_id, user_id, accounts, exposure FROM events LEFT JOIN b ON user_id = o_custkey"""
SQL["velocity_alerts"] = """
SELECT user_id, event_id, n FROM (
  SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         - (SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND x.ts < e.ts - INTERVAL 24 HOURS) AS n FROM events e
) WHERE n >= 3"""
SQL["write_scores"] = f"""
WITH {_BASE}, {_CARD} SELECT account, pd, CASE WHEN strftime(opened, '%Y') = '1997' THEN -points ELSE points END AS points, strftime(opened, '%Y') AS as_of FROM card"""
SQL["late_rows"] = """
SELECT count(*) AS late FROM events, (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
WHERE ts < TIMESTAMP '2024-01-10' AND (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-20') > 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <= mark"""
SQL["upsert_scores"] = f"""
SELECT user_id AS borrower, strftime(ts, {_STAMP}) AS at, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
SQL["dedup_repeats"] = f"""
SELECT event_id, 1 + (event_id % 5 = 0)::BIGINT AS times, strftime(ts + CASE WHEN event_id % 5 = 0 THEN INTERVAL 100 DAYS ELSE INTERVAL 0 DAYS END, {_STAMP}) AS last FROM events"""
SQL["read_csv_orders"] = """
SELECT o_orderkey % 7 != 0 AS fits, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, CASE WHEN o_orderkey % 7 != 0 THEN count(*) ELSE 0 END AS prices,
       CASE WHEN o_orderkey % 7 != 0 THEN sum(o_totalprice::DECIMAL(18,2))::DOUBLE END AS price FROM orders GROUP BY o_orderkey % 7 != 0"""
# of a line of JSON that is cut off nothing can be read
SQL["read_json_orders"] = SQL["read_csv_orders"].replace("sum(o_orderkey)::BIGINT AS keys", "CASE WHEN o_orderkey % 7 != 0 THEN sum(o_orderkey) END::BIGINT AS keys")
SQL["score_foreign"] = f"WITH {_BASE} SELECT account, round(1 / (1 + exp(-(-0.5::DOUBLE - 0.00008::DOUBLE * balance + 0.000002::DOUBLE * exposure))), 6) AS pd FROM base"


def _newton(steps: int = 8) -> str:
    """Weights of evidence of two attributes, counts per pair of them, and Newton steps, each solved by Cramer's rule."""
    woe = """{0}_woe AS (
  SELECT bin, round(ln(((g + 0.5::DOUBLE) / (sum(g) OVER () + 0.5::DOUBLE)) / ((b + 0.5::DOUBLE) / (sum(b) OVER () + 0.5::DOUBLE))), 6) AS w
  FROM (SELECT {0}_bin AS bin, count(*) FILTER (WHERE bad = 0) AS g, count(*) FILTER (WHERE bad = 1) AS b FROM binned GROUP BY 1)
)"""
    parts = [
        f"{_SCORED}, train AS (SELECT balance, exposure, bad FROM scored WHERE account % 10 >= 3)",
        f"binned AS (SELECT bad, {_bin('balance').replace('(1 + len(list_filter(q', '(1 + len(list_filter(c1.q')} AS balance_bin, {_bin('exposure').replace('(1 + len(list_filter(q', '(1 + len(list_filter(c2.q')} AS exposure_bin FROM train, {_cuts('train', 'balance', 10)} c1, {_cuts('train', 'exposure', 10)} c2)",
        woe.format("balance"),
        woe.format("exposure"),
        "counts AS MATERIALIZED (SELECT x.w AS x, y.w AS y, count(*) AS n, sum(bad) AS b FROM binned JOIN balance_woe x ON x.bin = balance_bin JOIN exposure_woe y ON y.bin = exposure_bin GROUP BY 1, 2)",
        "b0 AS (SELECT 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS w)",
    ]
    for k in range(steps):
        parts.append(f"""s{k} AS (
  SELECT any_value(u) AS u, any_value(v) AS v, any_value(w) AS w, sum(h) AS a, sum(h * x) AS d, sum(h * y) AS e, sum(h * x * x) AS f, sum(h * x * y) AS i, sum(h * y * y) AS j,
         sum(r) AS p, sum(r * x) AS q, sum(r * y) AS t
  FROM (SELECT *, n * z * (1 - z) AS h, b - n * z AS r FROM (SELECT *, 1 / (1 + exp(-(u + v * x + w * y))) AS z FROM counts, b{k}))
), b{k + 1} AS MATERIALIZED (
  SELECT u + (p * (f * j - i * i) - d * (q * j - i * t) + e * (q * i - f * t)) / m AS u, v + (a * (q * j - i * t) - p * (d * j - i * e) + e * (d * t - q * e)) / m AS v,
         w + (a * (f * t - q * i) - d * (d * t - q * e) + p * (d * i - f * e)) / m AS w
  FROM (SELECT *, a * (f * j - i * i) - d * (d * j - i * e) + e * (d * i - f * e) AS m FROM s{k})
)""")
    return f"WITH {', '.join(parts)} SELECT unnest(['intercept', 'balance_woe', 'exposure_woe']) AS name, unnest([round(u, 5), round(v, 5), round(w, 5)]) AS coefficient FROM b{steps}"


SQL["fit_pd_counts"] = _newton()
