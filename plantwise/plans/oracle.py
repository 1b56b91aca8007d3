"""DuckDB oracle SQL for the registered queries.

The oracle never sees the messy sheet text: it computes the same answers from the clean
numbers behind the test views (FIXTURES.md B1), so it shares no cleaning logic with the
Spark side. Rows that carry an injected defect are identified by the same rules that
injected it; those rules are part of the fixture, not a sample of the data.
"""

from __future__ import annotations

# Fixed values of the test views (same as plantwise.sources.fixtures).
P0, P1 = "2024-01-02", "2024-01-15"

PRELUDE = f"""
ev AS (
  SELECT event_id, event_type, CAST(ts AS DATE) AS d, CAST(hour(ts) AS INTEGER) AS h,
         101 + user_id % 12 AS m
  FROM events
), ev2 AS (
  SELECT *, CASE WHEN h BETWEEN 6 AND 12 THEN 1 WHEN h IN (13, 14) THEN 1 + event_id % 2
                 WHEN h BETWEEN 15 AND 21 THEN 2 ELSE 3 END AS code
  FROM ev
), ev3 AS (
  SELECT *, (event_type = 'error' OR (day(d) * 24 + h) % 11 = 0
             OR (h IN (13, 14) AND code = 1 AND day(d) % 2 = 0)) AS idle
  FROM ev2
), nums AS (
  SELECT *,
    CASE WHEN idle THEN 0 ELSE (event_id * 37) % 1001 END AS a10,
    CASE WHEN idle THEN 0 ELSE 400 + (event_id * 53) % 601 END AS p10,
    CASE WHEN idle THEN 0 ELSE 800 + (event_id * 71) % 201 END AS q10
  FROM ev3
), nums2 AS (
  SELECT *, (a10 * p10 * q10) // 1000000 AS o10 FROM nums
), nums3 AS (
  SELECT *, (2 * o10) // 3 AS t10 FROM nums2
), sheet AS (
  SELECT event_id AS row_id,
    CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'Turno 1'
         ELSE CAST(m AS VARCHAR) || '- CX-360G' END AS maquina,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE d END AS data,
    CASE code WHEN 1 THEN 'Turno A' WHEN 2 THEN 'Turno B' END AS turno,
    CASE WHEN event_id % 89 = 0 THEN 'x' WHEN event_id % 3 = 0 THEN strftime(d, '%Y-%m-%d')
         WHEN event_id % 3 = 1 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%-d/%-m/%Y') END AS data_text,
    CAST(code AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '' ELSE '.0' END AS turno_text,
    CASE WHEN event_id % 83 = 0 THEN 'n/d' ELSE CAST(h AS VARCHAR) END AS hora_text,
    CASE WHEN event_id % 79 = 0 THEN '1.234,5' ELSE (a10 // 10) || ',' || (a10 % 10) || CASE WHEN event_id % 2 = 0 THEN '%' ELSE ' %' END END AS disp_text,
    (p10 // 10) || ',' || (p10 % 10) || CASE WHEN event_id % 2 = 0 THEN '%' ELSE ' %' END AS perf_text,
    (q10 // 10) || ',' || (q10 % 10) || CASE WHEN event_id % 2 = 0 THEN '%' ELSE ' %' END AS qual_text,
    (t10 // 10) || ',' || (t10 % 10) || CASE WHEN event_id % 2 = 0 THEN '%' ELSE ' %' END AS teep_text,
    (o10 // 10) || ',' || (o10 % 10) || CASE WHEN event_id % 2 = 0 THEN '%' ELSE ' %' END AS oee_text,
    d AS d_true,
    CASE WHEN event_id % 83 = 0 THEN NULL ELSE CAST(h AS DOUBLE) END AS hora,
    CASE WHEN event_id % 79 = 0 THEN NULL ELSE CAST(a10 AS DOUBLE) / 1000 END AS disp_or_null,
    CASE WHEN event_id % 79 = 0 THEN 0.0 ELSE CAST(a10 AS DOUBLE) / 1000 END AS disponibilidade,
    CAST(p10 AS DOUBLE) / 1000 AS performance,
    CAST(q10 AS DOUBLE) / 1000 AS qualidade,
    CAST(t10 AS DOUBLE) / 1000 AS teep,
    CAST(o10 AS DOUBLE) / 1000 AS oee
  FROM nums3
), typed_all AS (
  SELECT * FROM sheet WHERE data IS NOT NULL
), typed AS (
  SELECT * FROM typed_all WHERE maquina IS NOT NULL AND maquina NOT LIKE '%Turno%'
), facts AS (
  SELECT * FROM typed WHERE turno IN ('Turno A', 'Turno B') AND hora BETWEEN 6 AND 21
), raw_facts AS (
  SELECT * FROM typed_all WHERE turno IN ('Turno A', 'Turno B') AND hora BETWEEN 6 AND 21
), pf AS (
  SELECT * FROM facts WHERE data BETWEEN DATE '{P0}' AND DATE '{P1}'
), pf_wd AS (
  SELECT * FROM pf WHERE isodow(data) <= 5
), slots_wd AS (
  SELECT data, hora FROM pf_wd GROUP BY data, hora HAVING sum(oee) > 0
), std AS (
  SELECT * FROM pf_wd f WHERE EXISTS (SELECT 1 FROM slots_wd s WHERE s.data = f.data AND s.hora = f.hora)
), pf_slots AS (
  SELECT data, hora FROM pf GROUP BY data, hora HAVING sum(oee) > 0
), pf_flag AS (
  SELECT f.*, EXISTS (SELECT 1 FROM pf_slots s WHERE s.data = f.data AND s.hora = f.hora) AS active FROM pf f
), rpf AS (
  SELECT * FROM raw_facts WHERE data BETWEEN DATE '{P0}' AND DATE '{P1}'
)
"""

SQL: dict[str, tuple[str, tuple[str, ...]]] = {}


def add(name: str, body: str, doubles: tuple[str, ...] = (), ctes: str = "") -> None:
    SQL[name] = (ctes + "\n" + body, doubles)


def render(name: str) -> str:
    body, doubles = SQL[name]
    ctes, _, select = body.rpartition("\n@@\n") if "\n@@\n" in body else ("", "", body)
    extra = (", " + ctes.strip().lstrip(",")) if ctes.strip() else ""
    if doubles:
        repl = ", ".join(f"round({c}, 6) AS {c}" for c in doubles)
        return f"WITH {PRELUDE}{extra}, q__ AS (\n{select}\n) SELECT * REPLACE ({repl}) FROM q__"
    return f"WITH {PRELUDE}{extra}\n{select}"


MEAN3 = "count(*) AS n_rows, avg(teep) AS teep_mean, avg(oee) AS oee_mean"

add("oee_overall", f"SELECT {MEAN3} FROM std", ("teep_mean", "oee_mean"))
add("oee_by_shift", f"SELECT turno, {MEAN3} FROM std GROUP BY turno", ("teep_mean", "oee_mean"))
add("oee_by_day_shift", f"SELECT data, turno, {MEAN3} FROM std GROUP BY data, turno", ("teep_mean", "oee_mean"))
for _name, _key in (("mean_of_daily", "data"), ("mean_of_machine", "maquina")):
    add(_name, f"""
inner_all AS (SELECT {_key}, avg(teep) AS t, avg(oee) AS o FROM std GROUP BY {_key}),
inner_shift AS (SELECT {_key}, turno, avg(teep) AS t, avg(oee) AS o FROM std GROUP BY {_key}, turno)
@@
SELECT 'all' AS scope, count(*) AS n_groups, avg(t) AS teep_mean, avg(o) AS oee_mean FROM inner_all
UNION ALL
SELECT turno AS scope, count(*) AS n_groups, avg(t) AS teep_mean, avg(o) AS oee_mean FROM inner_shift GROUP BY turno
""", ("teep_mean", "oee_mean"))
add("weighted_daily", """
daily AS (SELECT turno, data, avg(teep) AS m, count(*) AS n FROM std GROUP BY turno, data)
@@
SELECT turno, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, avg(m) AS simple_mean, sum(m * n) / sum(n) AS weighted_mean
FROM daily GROUP BY turno
""", ("simple_mean", "weighted_mean"))
add("slot_activity", """
SELECT data, hora, sum(oee) AS oee_total, CASE WHEN sum(oee) > 0 THEN 'ATIVA' ELSE 'INATIVA' END AS status
FROM pf_wd GROUP BY data, hora
""", ("oee_total",))
add("rows_per_date", "SELECT data, count(*) AS n_rows FROM std GROUP BY data")
add("shift_sets", """
SELECT data, turno, count(*) AS n_rows,
  array_to_string(list_sort(list_distinct(list(maquina))), ',') AS machines,
  array_to_string(list_transform(list_sort(list_distinct(list(CAST(hora AS INTEGER)))), lambda x: CAST(x AS VARCHAR)), ',') AS hours,
  array_to_string(list_transform(list_sort(list_distinct(list(CASE WHEN oee = 0 THEN CAST(hora AS INTEGER) END))), lambda x: CAST(x AS VARCHAR)), ',') AS zero_hours
FROM pf_wd GROUP BY data, turno
""")
add("filter_funnel", f"""
per AS (SELECT * FROM typed WHERE data BETWEEN DATE '{P0}' AND DATE '{P1}'),
per_s AS (SELECT * FROM per WHERE turno IN ('Turno A', 'Turno B')),
per_h AS (SELECT * FROM per_s WHERE hora BETWEEN 6 AND 21),
sl AS (SELECT data, hora FROM per_h GROUP BY data, hora HAVING sum(oee) > 0)
@@
SELECT (SELECT count(*) FROM typed) AS n_valid, (SELECT count(*) FROM per) AS n_period,
       (SELECT count(*) FROM per_s) AS n_shift, (SELECT count(*) FROM per_h) AS n_hour,
       (SELECT count(*) FROM per_h f WHERE EXISTS (SELECT 1 FROM sl WHERE sl.data = f.data AND sl.hora = f.hora)) AS n_active
""")
add("threshold_sweep", """
th AS (SELECT CAST(i AS INTEGER) AS step, CAST(i AS DOUBLE) * CAST(0.05 AS DOUBLE) AS threshold FROM range(10) t(i))
@@
SELECT th.step, th.threshold,
  avg(CASE WHEN r.disponibilidade > th.threshold THEN r.oee END) AS oee_mean_avail,
  CAST(count_if(r.disponibilidade > th.threshold) AS BIGINT) AS n_avail,
  avg(CASE WHEN r.oee > th.threshold THEN r.oee END) AS oee_mean_oee,
  CAST(count_if(r.oee > th.threshold) AS BIGINT) AS n_oee,
  abs(avg(CASE WHEN r.disponibilidade > th.threshold THEN r.oee END) - 0.6247) AS diff_avail,
  abs(avg(CASE WHEN r.oee > th.threshold THEN r.oee END) - 0.6247) AS diff_oee
FROM th, rpf r GROUP BY th.step, th.threshold
""", ("threshold", "oee_mean_avail", "oee_mean_oee", "diff_avail", "diff_oee"))
add("scope_means", f"""
sp AS (SELECT * FROM typed_all WHERE data BETWEEN DATE '{P0}' AND DATE '{P1}'),
sc AS (
  SELECT 0 AS scope_order, 'all' AS scope, * FROM sp
  UNION ALL SELECT 1, 'shifts_ab', * FROM sp WHERE turno IN ('Turno A', 'Turno B')
  UNION ALL SELECT 2, 'workdays', * FROM sp WHERE isodow(data) <= 5
  UNION ALL SELECT 3, 'shifts_ab_hours', * FROM sp WHERE turno IN ('Turno A', 'Turno B') AND hora BETWEEN 6 AND 21
  UNION ALL SELECT 4, 'workdays_ab_hours', * FROM sp WHERE isodow(data) <= 5 AND turno IN ('Turno A', 'Turno B') AND hora BETWEEN 6 AND 21)
@@
SELECT scope_order, scope, count(*) AS n_rows, avg(oee) AS oee_mean, avg(teep) AS teep_mean FROM sc GROUP BY scope_order, scope
""", ("oee_mean", "teep_mean"))
add("dates_present", f"""
SELECT DISTINCT data, dayname(data) AS weekday,
  CASE dayname(data) WHEN 'Monday' THEN 'Segunda-feira' WHEN 'Tuesday' THEN 'Terca-feira'
    WHEN 'Wednesday' THEN 'Quarta-feira' WHEN 'Thursday' THEN 'Quinta-feira' WHEN 'Friday' THEN 'Sexta-feira'
    WHEN 'Saturday' THEN 'Sabado' WHEN 'Sunday' THEN 'Domingo' END AS weekday_pt
FROM typed_all WHERE data BETWEEN DATE '{P0}' AND DATE '{P1}'
""")
add("active_slots_global", f"SELECT turno, {MEAN3} FROM std GROUP BY turno", ("teep_mean", "oee_mean"))
add("active_slots_shift", f"""
sl3 AS (SELECT data, turno, hora FROM pf_wd GROUP BY data, turno, hora HAVING sum(oee) > 0)
@@
SELECT turno, {MEAN3} FROM pf_wd f
WHERE EXISTS (SELECT 1 FROM sl3 s WHERE s.data = f.data AND s.turno = f.turno AND s.hora = f.hora)
GROUP BY turno
""", ("teep_mean", "oee_mean"))
add("active_hours_one_day", """
day AS (SELECT * FROM facts WHERE isodow(data) <= 5 AND data = DATE '2024-01-10'),
hrs AS (SELECT hora FROM day GROUP BY hora HAVING sum(oee) > 0)
@@
SELECT maquina, data, turno, hora, teep, oee FROM day WHERE hora IN (SELECT hora FROM hrs)
""", ("hora", "teep", "oee"))
add("valid_rows", "SELECT maquina, data, oee FROM typed", ("oee",))
add("raw_population", f"SELECT turno, {MEAN3} FROM rpf GROUP BY turno", ("teep_mean", "oee_mean"))
add("recent_machines", """
SELECT maquina, count(*) AS n_rows, min(data) AS first_date, max(data) AS last_date
FROM typed WHERE data >= DATE '2024-01-20' GROUP BY maquina
""")
add("positive_only_means", """
SELECT count(*) AS n_rows, avg(oee) AS oee_mean,
  avg(CASE WHEN oee > 0 THEN oee END) AS oee_positive_mean,
  CAST(count_if(oee > 0) AS BIGINT) AS n_oee_positive,
  avg(CASE WHEN disponibilidade > 0 THEN oee END) AS oee_mean_avail_positive,
  avg(CASE WHEN teep > 0 THEN teep END) AS teep_positive_mean,
  avg(CASE WHEN oee > 0 THEN oee END) * (16.0::DOUBLE / 24.0::DOUBLE) AS teep_nonzero
FROM rpf
""", ("oee_mean", "oee_positive_mean", "oee_mean_avail_positive", "teep_positive_mean", "teep_nonzero"))

METHODS = """
act_rows AS (SELECT * FROM pf_flag WHERE active),
methods AS (
  SELECT 1 AS method_order, 'simple' AS method, (SELECT avg(teep) FROM pf) AS teep
  UNION ALL SELECT 2, 'active_slots', (SELECT avg(teep) FROM act_rows)
  UNION ALL SELECT 3, 'teep_positive', (SELECT avg(teep) FROM pf WHERE teep > 0)
  UNION ALL SELECT 4, 'daily_means', (SELECT avg(m) FROM (SELECT avg(teep) AS m FROM act_rows GROUP BY data))
  UNION ALL SELECT 5, 'machine_means', (SELECT avg(m) FROM (SELECT avg(teep) AS m FROM act_rows GROUP BY maquina))
),
scored AS (SELECT *, abs(0.15 * 100.0 - teep * 100.0) AS diff_points FROM methods)
"""
add("method_comparison", METHODS + "@@\nSELECT * FROM scored", ("teep", "diff_points"))
add("closest_method", METHODS + "@@\nSELECT * FROM scored ORDER BY diff_points, method_order LIMIT 1", ("teep", "diff_points"))
add("daytype_activity_grid", """
cells AS (
  SELECT 1 AS cell_order, 'all' AS day_type, 'active' AS activity, * FROM pf_flag WHERE active
  UNION ALL SELECT 2, 'all', 'unfiltered', * FROM pf_flag
  UNION ALL SELECT 3, 'mon_fri', 'active', * FROM pf_flag WHERE active AND isodow(data) <= 5
  UNION ALL SELECT 4, 'mon_fri', 'unfiltered', * FROM pf_flag WHERE isodow(data) <= 5
  UNION ALL SELECT 5, 'mon_sat', 'active', * FROM pf_flag WHERE active AND isodow(data) <= 6
  UNION ALL SELECT 6, 'mon_sat', 'unfiltered', * FROM pf_flag WHERE isodow(data) <= 6),
g AS (SELECT cell_order, day_type, activity, count(*) AS n_rows, avg(teep) AS teep_mean FROM cells GROUP BY ALL)
@@
SELECT *, abs(0.15 * 100.0 - teep_mean * 100.0) AS diff_points,
  CASE WHEN abs(0.15 * 100.0 - teep_mean * 100.0) < 0.5 THEN '<<<' ELSE '' END AS mark FROM g
""", ("teep_mean", "diff_points"))
add("activity_mode_fit", """
sg AS (SELECT data, hora FROM pf_wd GROUP BY data, hora HAVING sum(oee) > 0),
ss AS (SELECT data, turno, hora FROM pf_wd GROUP BY data, turno, hora HAVING sum(oee) > 0),
fl AS (SELECT f.*,
  EXISTS (SELECT 1 FROM sg WHERE sg.data = f.data AND sg.hora = f.hora) AS ag,
  EXISTS (SELECT 1 FROM ss WHERE ss.data = f.data AND ss.turno = f.turno AND ss.hora = f.hora) AS ash FROM pf_wd f),
modes AS (
  SELECT 1 AS mode_order, 'shift' AS mode, * FROM fl WHERE ash
  UNION ALL SELECT 2, 'global', * FROM fl WHERE ag
  UNION ALL SELECT 3, 'none', * FROM fl),
lg AS (SELECT turno, mode_order, mode, count(*) AS n_rows, avg(teep) AS teep_mean,
  CASE turno WHEN 'Turno A' THEN 0.16 WHEN 'Turno B' THEN 0.165 END::DOUBLE AS target FROM modes GROUP BY ALL),
lg2 AS (SELECT *, abs(target * 100.0 - teep_mean * 100.0) AS diff_points FROM lg),
tot AS (SELECT mode_order, mode, sum(diff_points) AS mode_total_diff FROM lg2 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (ORDER BY mode_total_diff, mode_order) = 1 AS is_best FROM tot)
@@
SELECT lg2.*, rk.mode_total_diff, rk.is_best FROM lg2 JOIN rk USING (mode_order, mode)
""", ("teep_mean", "target", "diff_points", "mode_total_diff"))
add("tolerance_bands", """
vals AS (
  SELECT 'all' AS scope, count(*) AS n_rows, avg(teep) AS teep_mean FROM std
  UNION ALL SELECT turno, count(*), avg(teep) FROM std GROUP BY turno),
t AS (SELECT *, CASE scope WHEN 'all' THEN 0.15 WHEN 'Turno A' THEN 0.16 WHEN 'Turno B' THEN 0.165 END::DOUBLE AS target FROM vals),
d AS (SELECT *, abs(target * 100.0 - teep_mean * 100.0) AS diff_points FROM t)
@@
SELECT *,
  CASE WHEN diff_points < 0.5 THEN 'PERFEITO' WHEN diff_points < 1.0 THEN 'EXCELENTE'
       WHEN diff_points < 2.0 THEN 'MUITO BOM' ELSE 'ACEITAVEL' END AS band_final,
  CASE WHEN diff_points < 0.5 THEN 'PERFEITO' WHEN diff_points < 1.5 THEN 'MUITO BOM' ELSE 'DIFERENCA' END AS band_short,
  CASE WHEN diff_points < 1.0 THEN 'OK' ELSE 'ATENCAO' END AS pass_fail,
  5.20 - diff_points AS improvement_points
FROM d
""", ("teep_mean", "target", "diff_points", "improvement_points"))
add("period_sensitivity", f"""
base AS (SELECT * FROM facts WHERE data BETWEEN DATE '{P0}' AND DATE '{P1}'),
bs AS (SELECT data, hora FROM base GROUP BY data, hora HAVING sum(oee) > 0),
bf AS (SELECT b.*, EXISTS (SELECT 1 FROM bs WHERE bs.data = b.data AND bs.hora = b.hora) AS active FROM base b),
per AS (
  SELECT 1 AS period_order, 'inclusive' AS period, * FROM bf WHERE data BETWEEN DATE '{P0}' AND DATE '{P1}'
  UNION ALL SELECT 2, 'half_open', * FROM bf WHERE data >= DATE '{P0}' AND data < DATE '{P1}'
  UNION ALL SELECT 3, 'from_next_day', * FROM bf WHERE data BETWEEN DATE '2024-01-03' AND DATE '{P1}')
@@
SELECT period_order, period, CAST(count_if(active) AS BIGINT) AS n_rows, avg(CASE WHEN active THEN teep END) AS teep_mean,
  min(data) AS first_date, max(data) AS last_date FROM per GROUP BY ALL
""", ("teep_mean",))
add("teep_formula_variants", """
v AS (SELECT count(*) AS n_rows, CAST(count_if(active) AS BIGINT) AS n_active, avg(teep) AS teep_file, avg(oee) AS oee_mean,
  avg(oee * (16.0::DOUBLE / 24.0::DOUBLE)) AS teep_per_row, avg(CASE WHEN active THEN oee END) AS oee_active_mean
  FROM pf_flag),
v2 AS (SELECT *, oee_mean * (16.0::DOUBLE / 24.0::DOUBLE) AS teep_from_mean_oee,
  oee_active_mean * (16.0::DOUBLE / 24.0::DOUBLE) AS teep_active,
  0.15::DOUBLE / (16.0::DOUBLE / 24.0::DOUBLE) AS implied_oee FROM v)
@@
SELECT *, CASE WHEN abs(0.15 * 100.0 - teep_active * 100.0) < 0.5 THEN 'active_formula'
  WHEN abs(0.15 * 100.0 - teep_file * 100.0) < 0.5 THEN 'sheet_column' ELSE 'none' END AS matched FROM v2
""", ("teep_file", "oee_mean", "teep_per_row", "oee_active_mean", "teep_from_mean_oee", "teep_active", "implied_oee"))

PCOLS = ("disponibilidade", "performance", "qualidade", "teep", "oee")
add("clean_percent", "SELECT row_id, disponibilidade, performance, qualidade, teep, oee FROM sheet", PCOLS)
add("clean_percent_null", "SELECT row_id, disp_or_null AS disponibilidade, performance, qualidade, teep, oee FROM sheet", PCOLS)
add("clean_date", "SELECT row_id, data FROM sheet")
add("shift_label", "SELECT row_id, turno FROM sheet")
add("shift_valid", "SELECT row_id, turno IS NOT NULL AS shift_ok FROM sheet")
add("clean_hour", "SELECT row_id, hora FROM sheet", ("hora",))
add("oee_product", """
SELECT maquina, data, hora, oee, round(disponibilidade * performance * qualidade, 9) AS oee_calc,
  CAST(round_even(CAST(disponibilidade AS DECIMAL(12, 6)) * CAST(performance AS DECIMAL(12, 6))
                  * CAST(qualidade AS DECIMAL(12, 6)), 4) AS DOUBLE) AS oee_calc_4 FROM typed
""")
add("nz_components", """
SELECT row_id, CASE WHEN performance = 0 THEN NULL ELSE performance END AS performance_nz,
  CASE WHEN qualidade = 0 THEN NULL ELSE qualidade END AS qualidade_nz FROM sheet
""", ("performance_nz", "qualidade_nz"))
add("calendar_attrs", """
SELECT DISTINCT data, CAST(isodow(data) - 1 AS INTEGER) AS weekday, strftime(data, '%d/%m') AS day_month,
  dayname(data) AS weekday_name,
  CASE dayname(data) WHEN 'Monday' THEN 'Segunda-feira' WHEN 'Tuesday' THEN 'Terca-feira'
    WHEN 'Wednesday' THEN 'Quarta-feira' WHEN 'Thursday' THEN 'Quinta-feira' WHEN 'Friday' THEN 'Sexta-feira'
    WHEN 'Saturday' THEN 'Sabado' WHEN 'Sunday' THEN 'Domingo' END AS weekday_pt
FROM typed
""")


def oracle_sql() -> dict[str, str]:
    return {name: render(name) for name in SQL}


# ---------------------------------------------------------------- money and rates
MONEY = r"""
mt AS (
  SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS order_date, o_totalprice AS p,
         o_orderkey % 6 AS k FROM orders
), mt2 AS (
  SELECT *,
    CASE k WHEN 0 THEN '$' || format('{:,.2f}', p)
           WHEN 1 THEN '$ ' || translate(format('{:,.2f}', p), ',.', '.,')
           WHEN 2 THEN NULL
           WHEN 3 THEN '$' || replace(format('{:,.0f}', floor(p)), ',', '.')
           WHEN 4 THEN '$' || format('{:.2f}', p)
           ELSE '$' || format('{:.2f}', p) || '.' END AS mention,
    CASE k WHEN 2 THEN NULL WHEN 3 THEN floor(p) WHEN 5 THEN round(p * 100) ELSE p END AS amount
  FROM mt
)
"""
# quotes of both sources on the order dates, and each order's newest fresh one
MONEY_RATED = MONEY + """,
qd AS (SELECT DISTINCT order_date AS d, datediff('day', DATE '1992-01-01', order_date) AS n FROM mt),
qh AS (
  SELECT d, unnest(CASE n % 5 WHEN 1 THEN [9, 15] WHEN 3 THEN [8] WHEN 4 THEN [0] ELSE [] END) AS h, 4.0::DOUBLE AS base, 'p' AS src FROM qd
  UNION ALL SELECT d, unnest(CASE n % 5 WHEN 2 THEN [10] WHEN 3 THEN [12] ELSE [] END), 3.0::DOUBLE, 's' FROM qd),
qs AS (SELECT src, CAST(d AS TIMESTAMP) + to_hours(h) AS q_ts,
              base + CAST(day(d) % 7 AS DOUBLE) / 10.0::DOUBLE + CAST(h AS DOUBLE) / 100.0::DOUBLE AS q_rate FROM qh),
pq AS (SELECT q_ts AS p_ts, q_rate AS p_rate FROM qs WHERE src = 'p'),
sq AS (SELECT q_ts AS s_ts, q_rate AS s_rate FROM qs WHERE src = 's'),
asked AS (SELECT *, CAST(order_date AS TIMESTAMP) + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS t FROM mt2),
as1 AS (SELECT asked.*, p_ts, p_rate FROM asked ASOF LEFT JOIN pq ON asked.t >= pq.p_ts),
as2 AS (SELECT as1.*, s_ts, s_rate FROM as1 ASOF LEFT JOIN sq ON as1.t >= sq.s_ts),
rated AS (SELECT *, coalesce(CASE WHEN t - p_ts < INTERVAL 6 HOUR THEN p_rate END, CASE WHEN t - s_ts < INTERVAL 30 HOUR THEN s_rate END) AS rate
          FROM as2)
"""
BRL = "translate(format('{:,.2f}', CASE WHEN (@X) > 0 AND (@X) < 0.01 THEN 0.01 ELSE (@X) END), ',.', '.,')"

add("money_mentions", MONEY + "@@\nSELECT o_orderkey, 0::INTEGER AS pos, mention FROM mt2 WHERE mention IS NOT NULL")
add("money_parse", MONEY + "@@\nSELECT o_orderkey, amount FROM mt2 WHERE mention IS NOT NULL", ("amount",))
add("money_format", f"SELECT o_orderkey, {BRL.replace('@X', 'o_totalprice')} AS brl FROM orders")
add("money_rewrite", MONEY_RATED + r"""@@
SELECT o_orderkey,
  CASE WHEN k <> 2 AND rate IS NULL THEN 'Pedido ' || o_orderkey || ' custa ' || mention || ' total'
       WHEN k = 2 THEN 'Pedido ' || o_orderkey || ' custa R$ ' || translate(format('{:,.2f}', p), ',.', '.,') || ' total'
       ELSE 'Pedido ' || o_orderkey || ' custa ' || replace(mention, '$', '\$') || ' (R\$ ' || """
    + BRL.replace("@X", "amount * rate") + r""" || ')' || ' total' || chr(10) || '(valores sem impostos)' END AS rewritten
FROM rated
""")
add("money_by_group", MONEY_RATED + """@@
SELECT o_orderpriority, count(*) AS n_mentions, count(amount) AS n_parsed, count(rate) AS n_converted,
  round(CAST(sum(CAST(amount AS DECIMAL(20, 2))) AS DOUBLE), 3) AS usd_total,
  round(CAST(sum(CAST(amount AS DECIMAL(20, 2)) * CAST(rate AS DECIMAL(6, 2))) AS DOUBLE), 3) AS brl_total
FROM rated WHERE mention IS NOT NULL GROUP BY o_orderpriority
""")
add("fx_asof", """
q1 AS (SELECT ts AS q_ts, event_id AS q_id, 4.0::DOUBLE + value / 1000.0::DOUBLE AS q_rate FROM events WHERE event_type = 'view'),
q2 AS (SELECT ts AS q_ts, event_id AS q_id, 4.0::DOUBLE + value / 1000.0::DOUBLE AS q_rate FROM events WHERE event_type = 'signup'),
dm AS (SELECT 'USD-BRL' AS pair, ts, event_id FROM events WHERE event_type = 'purchase'),
a1 AS (SELECT dm.*, q1.q_ts AS p_ts, q1.q_id AS p_id, q1.q_rate AS p_rate FROM dm ASOF LEFT JOIN q1 ON dm.ts >= q1.q_ts),
a2 AS (SELECT a1.*, q2.q_ts AS s_ts, q2.q_id AS s_id, q2.q_rate AS s_rate FROM a1 ASOF LEFT JOIN q2 ON a1.ts >= q2.q_ts),
a3 AS (SELECT pair, ts, event_id,
  CASE WHEN epoch_us(ts) - epoch_us(p_ts) < 600000000 THEN p_rate END AS primary_rate,
  CASE WHEN epoch_us(ts) - epoch_us(p_ts) < 600000000 THEN p_id END AS primary_id,
  CASE WHEN epoch_us(ts) - epoch_us(s_ts) < 3600000000 THEN s_rate END AS secondary_rate,
  CASE WHEN epoch_us(ts) - epoch_us(s_ts) < 3600000000 THEN s_id END AS secondary_id FROM a2)
@@
SELECT *, coalesce(primary_rate, secondary_rate) AS rate,
  CASE WHEN primary_rate IS NOT NULL THEN 'primary' WHEN secondary_rate IS NOT NULL THEN 'secondary' END AS source
FROM a3
""", ("primary_rate", "secondary_rate", "rate"))

# ---------------------------------------------------------------- links
LINKS = r"""
lt AS (SELECT page_id, url AS u, page_id % 6 AS k FROM pages),
lt2 AS (
  SELECT page_id, k,
    CASE k WHEN 0 THEN 'imagem' WHEN 1 THEN 'vídeo' ELSE '' END AS tag,
    CASE k WHEN 0 THEN u || '.png' WHEN 1 THEN u || '.mp4' WHEN 2 THEN u
           WHEN 3 THEN 'https://drive.google.com/file/d/ID' || page_id || '/view?usp=drive_link'
           WHEN 4 THEN 'https://drive.google.com/open?id=ID' || page_id || '&x=1' END AS raw_url,
    'Veja item ' || page_id || '. ' ||
    CASE k WHEN 0 THEN 'Link de Imagem: ' || u || '.png' WHEN 1 THEN 'LINK DE VÍDEO: ' || u || '.mp4).'
           WHEN 2 THEN u WHEN 3 THEN 'Link de Máquina: https://drive.google.com/file/d/ID' || page_id || '/view?usp=drive_link'
           WHEN 4 THEN 'https://drive.google.com/open?id=ID' || page_id || '&x=1' ELSE 'sem link' END AS text
  FROM lt
), lk AS (
  SELECT page_id, 0::INTEGER AS pos, tag, regexp_replace(raw_url, '[.)\]\s]+$', '') AS url FROM lt2 WHERE k <> 5
), lk2 AS (
  SELECT *, CASE
    WHEN regexp_matches(lower(url), '\.(mp4|mov|avi|m4v|webm|mkv)') THEN 'video'
    WHEN regexp_matches(lower(url), '\.(png|jpg|jpeg|webp|gif|bmp)') THEN 'image'
    WHEN contains(url, 'drive.google.com') THEN 'drive' ELSE 'unknown' END AS media_type FROM lk
), lk3 AS (
  SELECT *, CASE
    WHEN contains(tag, 'vídeo') OR contains(tag, 'video') OR media_type = 'video' THEN 'video'
    WHEN contains(tag, 'imagem') OR contains(tag, 'foto') OR media_type = 'image' THEN 'image'
    WHEN media_type = 'drive' AND regexp_matches(tag, 'máquina|foto|equipamento|mídia|apresentação') THEN 'image'
    ELSE 'button' END AS render_kind,
    CASE WHEN contains(url, '/file/d/') THEN nullif(split_part(split_part(url, '/file/d/', 2), '/', 1), '')
         WHEN contains(url, 'id=') THEN nullif(split_part(split_part(url, 'id=', 2), '&', 1), '') END AS drive_id
  FROM lk2
)
"""
add("link_mentions", LINKS + "@@\nSELECT page_id, pos, tag, url FROM lk3")
add("media_type", LINKS + "@@\nSELECT page_id, url, media_type FROM lk3")
add("render_kind", LINKS + "@@\nSELECT page_id, tag, media_type, render_kind FROM lk3")
add("drive_id", LINKS + """@@
SELECT page_id, drive_id,
  CASE WHEN contains(url, 'drive.google.com') THEN
    'https://drive.google.com/uc?' || CASE WHEN render_kind = 'video' THEN 'id=' ELSE 'export=download&id=' END || drive_id END AS direct_url
FROM lk3
""")
add("answer_parts", LINKS + """,
first_link AS (SELECT page_id, tag, url, media_type, render_kind, drive_id FROM lk3),
base AS (
  SELECT p.page_id, p.page_id % 6 AS k, p.url, '- Item ' || p.page_id || ' por $ ' || p.page_id || ' cada:' AS plain,
         'Item ' || p.page_id || ' por \\$ ' || p.page_id || ' (R\\$ ' || translate(format('{:,.2f}', p.page_id * 2.0), ',.', '.,') || ') cada:' AS lead
  FROM pages p),
parts AS (
  SELECT page_id, CASE WHEN k = 5 THEN 0 ELSE 0 END AS pos, 'text' AS kind,
    lead || CASE k WHEN 3 THEN ' Link de Máquina:' WHEN 5 THEN ' sem link e ainda' ELSE '' END || chr(10) || '(valores sem impostos)' AS text,
    NULL AS tag, NULL AS url, NULL AS media_type, NULL AS render_kind, NULL AS direct_url FROM base
  UNION ALL
  SELECT f.page_id, 1, 'link', NULL, f.tag, f.url, f.media_type, f.render_kind,
    CASE WHEN contains(f.url, 'drive.google.com') THEN
      'https://drive.google.com/uc?' || CASE WHEN f.render_kind = 'video' THEN 'id=' ELSE 'export=download&id=' END || f.drive_id END
  FROM first_link f
  UNION ALL
  SELECT page_id, 2, 'text', CASE k WHEN 1 THEN '). e ainda' ELSE 'e ainda' END, NULL, NULL, NULL, NULL, NULL FROM base WHERE k <> 5
  UNION ALL
  SELECT page_id, CASE WHEN k = 5 THEN 1 ELSE 3 END, 'link', NULL, 'foto', url || '.jpg',
    CASE WHEN regexp_matches(lower(url), '\\.(mp4|mov|avi|m4v|webm|mkv)') THEN 'video' ELSE 'image' END,
    CASE WHEN regexp_matches(lower(url), '\\.(mp4|mov|avi|m4v|webm|mkv)') THEN 'video' ELSE 'image' END, NULL FROM base
  UNION ALL
  SELECT page_id, CASE WHEN k = 5 THEN 2 ELSE 4 END, 'text', 'fim', NULL, NULL, NULL, NULL, NULL FROM base)
@@
SELECT page_id, CAST(pos AS INTEGER) AS pos, kind, text, tag, url, media_type, render_kind, direct_url FROM parts
""".replace("\\\\", "\\"))
add("strip_drive_links", LINKS + r"""@@
SELECT page_id, regexp_replace(text, 'https?://drive\.google\.com/file/d/[a-zA-Z0-9_-]+/view\?usp=drive_link', '', 'g') AS text
FROM lt2
""")
add("link_census", LINKS + r"""@@
SELECT render_kind, media_type, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1), '') AS host,
  count(*) AS n_links
FROM lk3 GROUP BY ALL
""")
add("answer_cleanup", r"""
ac AS (SELECT conv_id, turn,
  regexp_replace(regexp_replace(regexp_replace(text, '(?i)Links de imagens:?', '', 'g'), '^\s+|\s+$', '', 'g'),
                 '^\s*[*\-]\s*', '') AS text FROM conversations)
@@
SELECT conv_id, turn, text FROM ac WHERE text <> ''
""")
ROWLINE = r"""
rl AS (SELECT conv_id, turn, concat_ws(' | ', 'conv_id: ' || conv_id, 'turn: ' || turn,
  CASE WHEN role IS NOT NULL AND regexp_replace(role, '^\s+|\s+$', '', 'g') <> '' THEN 'role: ' || role END,
  CASE WHEN text IS NOT NULL AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' THEN 'text: ' || text END) AS line
  FROM conversations)
"""
add("links_in_texts", LINKS + r""",
corpora AS (
  SELECT 'pages' AS corpus, html AS text FROM pages UNION ALL SELECT 'conversations', text FROM conversations
  UNION ALL SELECT 'documents', text FROM documents),
counted AS (
  SELECT corpus, coalesce(len(regexp_extract_all(text, '(?i)https?://[^\s)]+')), 0) AS n FROM corpora
  UNION ALL SELECT 'answers', CASE WHEN k = 5 THEN 0 ELSE 1 END FROM lt)
@@
SELECT corpus, count(*) AS n_texts, count(*) FILTER (WHERE n > 0) AS n_with_link, CAST(sum(n) AS BIGINT) AS n_links FROM counted GROUP BY corpus
""")
add("row_lines", ROWLINE + "@@\nSELECT conv_id, turn, line FROM rl")
add("context_by_group", ROWLINE + r""",
cx AS (SELECT conv_id, '--- ' || conv_id || ' ---' || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS full_text
       FROM rl GROUP BY conv_id)
@@
SELECT conv_id, CASE WHEN length(full_text) > 1000 THEN substr(full_text, 1, 1000) || chr(10) || '...[CONTEXTO TRUNCADO]'
                     ELSE full_text END AS context FROM cx
""")


add("context_all_sources", """
ln AS (
  SELECT 0 AS no, c_custkey AS key, 'c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_nationkey: ' || c_nationkey
    || ' | c_acctbal: ' || c_acctbal || ' | c_mktsegment: ' || c_mktsegment || ' | nota: peca "' || c_name || '", furo,' || chr(10) || 'fim' AS line FROM customer
  UNION ALL SELECT 1, s_suppkey, 's_suppkey: ' || s_suppkey || ' | s_name: ' || s_name || ' | s_nationkey: ' || s_nationkey
    || ' | s_acctbal: ' || s_acctbal FROM supplier
  UNION ALL SELECT 2, n_nationkey, 'n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey FROM nation
  UNION ALL SELECT 3, r_regionkey, 'r_regionkey: ' || r_regionkey || ' | r_name: ' || r_name FROM region),
per_source AS (
  SELECT no, '--- ' || ['erros', 'dacen', 'psi', 'gerais'][no + 1] || ' ---' || chr(10) || string_agg(line, chr(10) ORDER BY key) AS part FROM ln GROUP BY no),
whole AS (SELECT string_agg(part, chr(10) ORDER BY no) AS body FROM per_source)
@@
SELECT CASE WHEN length(body) > 30000 THEN substr(body, 1, 30000) || chr(10) || '...[CONTEXTO TRUNCADO]' ELSE body END AS context FROM whole
""")


# ---------------------------------------------------------------- sources and browsing
add("scan_sheet", """
SELECT maquina, data_text AS data, turno_text AS turno, hora_text AS hora, disp_text AS disponibilidade,
  perf_text AS performance, qual_text AS qualidade, teep_text AS teep, oee_text AS oee FROM sheet
""")
add("scan_headerless", "SELECT DISTINCT s_name AS machine FROM supplier WHERE s_name IS NOT NULL")
add("record_scan", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment, 'peca "' || c_name || '", furo,' || chr(10) || 'fim' AS nota
FROM customer
""")
SQL["record_scan_split"] = SQL["record_scan"]
add("scan_from_first_row", """
SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'K-' ELSE '' END || s_suppkey AS c0, s_name AS c1, CAST(s_nationkey AS VARCHAR) AS c2 FROM supplier
UNION ALL VALUES ('PRODUCAO', NULL, NULL), (NULL, NULL, NULL), ('Cod', 'Maquina', 'Setor')
""")
add("scan_skipping", """
SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'K-' ELSE '' END || s_suppkey AS c0, s_name AS c1, CAST(s_nationkey AS VARCHAR) AS c2 FROM supplier
""")
add("source_profile", """
SELECT 'sheet-erros' AS file_path, count(*) AS n_records, 6::INTEGER AS n_cols, true AS has_time, true AS has_machine_column FROM customer
UNION ALL SELECT 'sheet-dacen', count(*), 4, true, true FROM supplier
UNION ALL SELECT 'sheet-psi', count(*), 3, true, true FROM nation
UNION ALL SELECT 'sheet-gerais', count(*), 2, true, true FROM region
""")
add("table_scan", """
SELECT p_partkey AS id, p_brand AS referencia, p_name AS produto, CAST(NULL AS VARCHAR) AS decoracao,
  CAST(NULL AS VARCHAR) AS data_cadastro, CAST(NULL AS DOUBLE) AS tempo_s,
  CAST((p_partkey * 3) % 97 AS DOUBLE) / 1000 AS cyan, CAST((p_partkey * 5) % 97 AS DOUBLE) / 1000 AS magenta,
  CAST((p_partkey * 7) % 97 AS DOUBLE) / 1000 AS yellow, CAST((p_partkey * 11) % 97 AS DOUBLE) / 1000 AS black,
  CAST((p_partkey * 13) % 97 AS DOUBLE) / 1000 AS white, CAST((p_partkey * 17) % 97 AS DOUBLE) / 1000 AS varnish,
  CAST(NULL AS DOUBLE) AS largura, CAST(NULL AS DOUBLE) AS altura, CAST(NULL AS DOUBLE) AS diametro,
  CAST(NULL AS VARCHAR) AS print_edge, CAST(NULL AS VARCHAR) AS powergrade, CAST(NULL AS VARCHAR) AS finish_time,
  CAST(NULL AS VARCHAR) AS intervalo, CAST(NULL AS VARCHAR) AS uv_lamp, CAST(NULL AS VARCHAR) AS obs,
  CAST(NULL AS VARCHAR) AS image_path
FROM part
""", ("tempo_s", "cyan", "magenta", "yellow", "black", "white", "varnish", "largura", "altura", "diametro"))
add("source_counts", """
SELECT 'erros' AS source, count(*) AS n_rows FROM customer
UNION ALL SELECT 'dacen', count(*) FROM supplier
UNION ALL SELECT 'psi', count(*) FROM nation
UNION ALL SELECT 'gerais', count(*) FROM region
UNION ALL SELECT 'trabalhos', CAST(0 AS BIGINT)
""")
add("ink_per_thousand", """
inks AS (
  SELECT p_partkey AS id, p_brand AS referencia, p_name AS produto, 'Ciano' AS ink, CAST((p_partkey * 3) % 97 AS DOUBLE) / 1000 AS ml_per_unit FROM part
  UNION ALL SELECT p_partkey, p_brand, p_name, 'Magenta', CAST((p_partkey * 5) % 97 AS DOUBLE) / 1000 FROM part
  UNION ALL SELECT p_partkey, p_brand, p_name, 'Amarelo', CAST((p_partkey * 7) % 97 AS DOUBLE) / 1000 FROM part
  UNION ALL SELECT p_partkey, p_brand, p_name, 'Preto', CAST((p_partkey * 11) % 97 AS DOUBLE) / 1000 FROM part
  UNION ALL SELECT p_partkey, p_brand, p_name, 'Branco', CAST((p_partkey * 13) % 97 AS DOUBLE) / 1000 FROM part
  UNION ALL SELECT p_partkey, p_brand, p_name, 'Verniz', CAST((p_partkey * 17) % 97 AS DOUBLE) / 1000 FROM part)
@@
SELECT id, referencia, produto, ink, ml_per_unit, ml_per_unit * 1000.0::DOUBLE AS ml_per_thousand FROM inks
""", ("ml_per_unit", "ml_per_thousand"))
add("head_tail", """
SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice, 'head' AS part FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL
SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice, 'tail' AS part FROM orders ORDER BY o_orderkey DESC LIMIT 5)
""", ("o_totalprice",))
add("paginate", """
n AS (SELECT count(*) AS n_total FROM orders)
@@
SELECT o_orderkey, o_custkey, 3::BIGINT AS page, CAST((n_total - 1) // 20 + 1 AS BIGINT) AS n_pages, 41::BIGINT AS first_row,
  60::BIGINT AS last_row, n_total
FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40), n
""")
add("paginate_deep", """
n AS (SELECT count(*) AS n_total, CAST((count(*) - 1) // 20 + 1 AS BIGINT) AS n_pages FROM orders)
@@
SELECT o_orderkey, o_custkey, n_pages AS page, n_pages, CAST((n_pages - 1) * 20 + 1 AS BIGINT) AS first_row, n_total AS last_row, n_total
FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS no FROM orders), n WHERE no > (n_pages - 1) * 20
""")
add("distinct_machines", "SELECT DISTINCT maquina FROM sheet WHERE maquina IS NOT NULL")
add("value_counts_top", f"""
SELECT teep_text AS value, count(*) AS n FROM sheet WHERE data BETWEEN DATE '{P0}' AND DATE '{P1}'
GROUP BY teep_text ORDER BY n DESC, value LIMIT 10
""")
add("point_lookup", """
SELECT maquina, data, turno, hora, teep, oee FROM typed
WHERE maquina = '105- CX-360G' AND data = DATE '2024-01-10' AND turno = 'Turno A'
""", ("hora", "teep", "oee"))
add("substring_one", "SELECT DISTINCT maquina FROM sheet WHERE contains(maquina, '11')")
add("substring_all_columns", """
lng AS (
  SELECT 'c_custkey' AS column_name, CAST(c_custkey AS VARCHAR) AS value FROM customer
  UNION ALL SELECT 'c_name', c_name FROM customer
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer
  UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer),
hits AS (SELECT column_name, value, count(*) AS c FROM lng WHERE contains(value, '12') GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rn FROM hits)
@@
SELECT column_name, CAST(sum(c) AS BIGINT) AS n_matches,
  string_agg(CASE WHEN rn <= 5 THEN value END, ', ' ORDER BY value) AS sample_values
FROM rk GROUP BY column_name
""")


# ---------------------------------------------------------------- streams
add("stream_ingest", "SELECT maquina, data, turno, hora, teep, oee FROM facts", ("hora", "teep", "oee"))
add("landing_refresh", "SELECT maquina, data, turno, hora, teep, oee FROM facts", ("hora", "teep", "oee"))
add("stream_slots", """
SELECT data, hora, turno, sum(oee) AS oee_sum, sum(teep) AS teep_sum, count(*) AS n_rows
FROM facts GROUP BY data, hora, turno
""", ("hora", "oee_sum", "teep_sum"))
# what the replayed landing ends with: the last version of every file
LANDED = """
landed AS (
  SELECT * FROM facts WHERE CASE row_id % 8 WHEN 2 THEN false WHEN 3 THEN row_id % 3 = 1 WHEN 4 THEN row_id % 3 = 2 ELSE true END)
@@
"""
add("landing_replaced", LANDED + "SELECT maquina, data, turno, hora, teep, oee FROM landed", ("hora", "teep", "oee"))
add("stream_slots_replaced", LANDED + """
SELECT data, hora, turno, sum(oee) AS oee_sum, sum(teep) AS teep_sum, count(*) AS n_rows
FROM landed GROUP BY data, hora, turno
""", ("hora", "oee_sum", "teep_sum"))
# n_parsed here counts mentions that contain a digit; that equals the decision-table parse
# on this corpus (its "$" runs carry no digits), not in general -- the parse itself is
# checked exactly by money_parse and by the property tests.
add("money_in_documents", r"""
SELECT lang, count(*) AS n_docs, CAST(sum(length(text) - length(replace(text, '$', ''))) AS BIGINT) AS n_dollar_signs,
  CAST(sum(len(regexp_extract_all(text, '(^|[^R])\$\s?([0-9.,]+)', 2))) AS BIGINT) AS n_mentions,
  CAST(sum(len(list_filter(regexp_extract_all(text, '(^|[^R])\$\s?([0-9.,]+)', 2),
                           lambda x: regexp_matches(x, '[0-9]')))) AS BIGINT) AS n_parsed
FROM documents GROUP BY lang
""")
add("page_index", """
SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS row_pos,
  CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 20) + 1 AS BIGINT) AS page
FROM orders
""")
add("stream_active_means", """
act AS (SELECT data, hora FROM facts GROUP BY data, hora HAVING sum(oee) > 0)
@@
SELECT turno, count(*) AS n_rows, avg(teep) AS teep_mean, avg(oee) AS oee_mean
FROM facts f WHERE EXISTS (SELECT 1 FROM act a WHERE a.data = f.data AND a.hora = f.hora) GROUP BY turno
""", ("teep_mean", "oee_mean"))
add("active_rows_global", "SELECT maquina, data, turno, hora, teep, oee FROM std", ("hora", "teep", "oee"))
add("active_rows_shift", """
by_shift AS (SELECT data, turno, hora FROM pf_wd GROUP BY data, turno, hora HAVING sum(oee) > 0)
@@
SELECT maquina, data, turno, hora, teep, oee FROM pf_wd f
WHERE EXISTS (SELECT 1 FROM by_shift s WHERE s.data = f.data AND s.turno = f.turno AND s.hora = f.hora)
""", ("hora", "teep", "oee"))
# the same figures from the stream's state
for _name in ("oee_overall", "oee_by_shift", "oee_by_day_shift", "period_sensitivity"):
    SQL[_name.replace("oee_", "state_") if _name.startswith("oee_") else f"state_{_name}"] = SQL[_name]
