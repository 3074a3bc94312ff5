"""DuckDB oracle SQL for every registered query that SQL can express.

Written from the rules, not from the Spark code: plain per-patient windows,
equi-joins and grouped aggregates over the pre-registered driver views. Thresholds
and bins are written out here, so a wrong value in the code cannot match itself.
"""

from __future__ import annotations

from .queries import ADHOC_SQL, CHART_PATIENT, PARAM_SQL, PARAM_VALUES

# --- fixed values: rules on the driver data ------------------------------------
DX = {
    "dx_neutropenia": ("Neutropenia (NPU02902) Neutrofilocytter", dict(code="click", below=100.0, days=2)),
    "dx_infection": ("Severe infection (NPU19748)", dict(code="error", above=200.0, days=1)),
    "dx_hepatic": ("Severe hepatic effects elevated liver enzyme (NPU19651)",
                   dict(liver="view", coagulation="click", bilirubin="purchase", liver_above=45.0,
                        coagulation_below=20.0, bilirubin_above=40.0, at="PL_DAY")),
    "dx_renal": ("Renal toxicity (NPU18016)", dict(code="click", above=150.0)),
    "dx_thrombocytopenia": ("Thrombocytopenia (NPU03568)", dict(code="view", below=30.0, hours=24)),
    "dx_pancreatitis": ("Pankreatit", dict(limits={"view": 20.0, "click": 20.0, "purchase": 20.0}, times=3.0,
                                           crp="error", crp_above=50.0, at="PL_DAY")),
    "dx_delayed_elimination": ("DME", dict(crea="click", mtx="purchase")),
}
# Hours after the start, lower < h <= upper: one bin before, one of 18 hours, one of 12
# named Time23, six-hour bins from 36 to 96, twelve-hour bins from 102 to 306.
BINS = ([(-7, 0, "Before"), (0, 18, "Time0"), (18, 30, "Time23")]
        + [(t, t + 6, f"Time{t}") for t in range(36, 96, 6)]
        + [(t, t + 12, f"Time{t}") for t in range(102, 306, 12)])
NO_BIN = "nan"
MEASURES = ("PL_MTX", "PL_PC")
# --- end fixed values ------------------------------------------------------------
#: White space that a cleaned text has at neither end, as Python's str.strip has it.
SPACES = " || ".join(f"chr({ord(c)})" for c in map(chr, range(0x3001)) if c.isspace())

SAMPLES = """SELECT user_id AS NOPHO_NR, event_id AS SAMPLE_ID, ts AS PL_DATETIME,
  event_type AS IUPAC_CODE, value AS PL_Value,
  '<' || json_extract_string(props, '$.k') || ',0' AS REFTEXT
FROM events WHERE event_type <> 'signup'"""

SAMPLES_DAY = f"""SELECT *, CAST(CAST(PL_DATETIME AS DATE) AS TIMESTAMP) AS PL_DAY FROM ({SAMPLES}) s0"""

INFUSIONS = """SELECT e.user_id AS NOPHO_NR,
  CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS INTEGER) AS INFNO,
  CAST(c.c_custkey % 3 AS INTEGER) AS SEX,
  CAST(CAST(floor(e.value) AS BIGINT) % 2 AS INTEGER) AS MP6_POST_STOP,
  e.ts AS INF_START_DATETIME
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
WHERE e.event_type = 'signup'"""

PLASMA = """SELECT user_id AS NOPHO_NR, event_id AS SAMPLE_ID,
  CASE WHEN event_type = 'click' THEN value END AS PL_PC,
  CASE WHEN event_type = 'purchase' THEN value END AS PL_MTX,
  ts AS PL_DATETIME
FROM events WHERE event_type IN ('click', 'purchase')
  AND json_extract_string(props, '$.k') IS DISTINCT FROM '0'"""

BLOCK_INFUSIONS = """SELECT user_id AS NOPHO_NR,
  CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts)) AS INTEGER) AS INFNO,
  ts AS INF_START_DATETIME FROM events WHERE event_type = 'signup'"""


def attributed(src: str) -> str:
    """Attribution, form A: equi-join to all infusions, then the highest number
    whose start is at or before the sample."""
    return f"""WITH src AS ({src}), inf AS ({INFUSIONS}),
k AS (SELECT x.SAMPLE_ID AS sid,
    max(CASE WHEN i.INFNO BETWEEN 1 AND 8 AND i.INF_START_DATETIME <= x.PL_DATETIME THEN i.INFNO END) AS kmax,
    max(CASE WHEN i.INFNO = 1 THEN 1 ELSE 0 END) AS has1,
    count(i.NOPHO_NR) AS ninf
  FROM src x LEFT JOIN inf i ON i.NOPHO_NR = x.NOPHO_NR GROUP BY x.SAMPLE_ID),
a0 AS (SELECT x.*, CAST(CASE WHEN x.PL_DATETIME IS NULL OR k.ninf = 0 THEN NULL
    WHEN k.kmax IS NOT NULL THEN k.kmax WHEN k.has1 = 1 THEN 0 END AS INTEGER) AS INFNO
  FROM src x JOIN k ON k.sid = x.SAMPLE_ID)
SELECT a0.*, st.INF_START_DATETIME AS MTX_INFDATE,
  CAST(floor((epoch_us(a0.PL_DATETIME) - epoch_us(st.INF_START_DATETIME)) / 3600000000.0) AS DOUBLE)
    AS HOUR_DIFF_SAMPLE_INF,
  sx.SEX AS SEX, sp.MP6_POST_STOP AS MP6_POST_STOP
FROM a0
LEFT JOIN inf st ON st.NOPHO_NR = a0.NOPHO_NR
  AND st.INFNO = CASE WHEN a0.INFNO = 0 THEN 1 ELSE a0.INFNO END
LEFT JOIN (SELECT DISTINCT NOPHO_NR, SEX FROM inf WHERE SEX <> 0) sx ON sx.NOPHO_NR = a0.NOPHO_NR
LEFT JOIN (SELECT DISTINCT NOPHO_NR, INFNO, MP6_POST_STOP FROM inf) sp
  ON sp.NOPHO_NR = a0.NOPHO_NR AND sp.INFNO = a0.INFNO"""


ATT = attributed(SAMPLES_DAY)
ATT_PLASMA = attributed(PLASMA)
OUT = "NOPHO_NR, SAMPLE_ID, PL_DATETIME, IUPAC_CODE, PL_Value, INFNO, SEX, MP6_POST_STOP"


def _f(x: float) -> str:
    return repr(float(x))


def streak_rows(rows: str, flag: str) -> str:
    """Adds _sid, _st, _et (run number, first and last time of the run) per patient."""
    w = "PARTITION BY NOPHO_NR ORDER BY PL_DATETIME, SAMPLE_ID"
    return f"""WITH r AS (SELECT *, {flag} AS _f FROM ({rows}) r0),
r1 AS (SELECT *, lag(_f) OVER ({w}) AS _prev, row_number() OVER ({w}) AS _rn FROM r),
r2 AS (SELECT *, CAST(sum(CASE WHEN _rn = 1 OR _prev <> _f THEN 1 ELSE 0 END)
    OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS _sid FROM r1)
SELECT *, min(PL_DATETIME) OVER (PARTITION BY NOPHO_NR, _sid) AS _st,
  max(PL_DATETIME) OVER (PARTITION BY NOPHO_NR, _sid) AS _et FROM r2"""


def _long(hours: float) -> str:
    return f"((epoch_us(_et) - epoch_us(_st)) / 3600000000.0 > {_f(hours)})"


# Limits of the counts over all rules.
STRICT = {"dx_neutropenia": dict(below=60.0, days=6), "dx_infection": dict(above=450.0, days=4),
          "dx_hepatic": dict(liver_above=200.0, coagulation_below=5.0, bilirubin_above=200.0), "dx_renal": dict(above=400.0),
          "dx_thrombocytopenia": dict(below=10.0, hours=60), "dx_pancreatitis": dict(times=10.0, crp_above=150.0)}


def dx_sql(key: str, strict: bool = False) -> str:
    _, p = DX[key]
    if strict:
        p = {**p, **STRICT.get(key, {})}
    if key == "dx_renal":
        return f"""SELECT {OUT}, coalesce(PL_Value > {_f(p['above'])}, false) AS detection
FROM ({ATT}) a WHERE IUPAC_CODE = '{p['code']}'"""
    if key in ("dx_neutropenia", "dx_thrombocytopenia"):
        hours = 24.0 * p["days"] if "days" in p else float(p["hours"])
        rows = f"SELECT {OUT} FROM ({ATT}) a WHERE IUPAC_CODE = '{p['code']}'"
        s = streak_rows(rows, f"coalesce(PL_Value < {_f(p['below'])}, false)")
        return f"SELECT {OUT}, (_f AND {_long(hours)}) AS detection FROM ({s}) q"
    if key == "dx_infection":
        rows = f"""SELECT {OUT},
  TRY_CAST(replace(replace(REFTEXT, '<', ''), ',', '.') AS DOUBLE) AS REFTEXT
FROM ({ATT}) a WHERE IUPAC_CODE = '{p['code']}'"""
        s = streak_rows(rows, "coalesce(PL_Value > REFTEXT, false)")
        return f"""SELECT {OUT}, REFTEXT,
  (coalesce(PL_Value > {_f(p['above'])}, false) OR (_f AND {_long(24.0 * p['days'])})) AS detection
FROM ({s}) q"""
    if key == "dx_hepatic":
        codes = (p["liver"], p["coagulation"], p["bilirubin"])
        rule = f"""coalesce(bool_or(CASE WHEN IUPAC_CODE = '{p['liver']}'
      THEN coalesce(PL_Value > {_f(p['liver_above'])}, false) END), false)
  AND (coalesce(avg(CASE WHEN IUPAC_CODE = '{p['coagulation']}' THEN PL_Value END) < {_f(p['coagulation_below'])}, false)
    OR coalesce(avg(CASE WHEN IUPAC_CODE = '{p['bilirubin']}' THEN PL_Value END) > {_f(p['bilirubin_above'])}, false))"""
        return _coincident_sql(codes, rule, p["at"], drop_null=False)
    if key == "dx_pancreatitis":
        lim = p["limits"]
        enzyme = " OR ".join(
            f"coalesce(avg(CASE WHEN IUPAC_CODE = '{c}' THEN PL_Value END) > {_f(v * p['times'])}, false)"
            for c, v in lim.items())
        rule = f"""({enzyme}) AND coalesce(avg(CASE WHEN IUPAC_CODE = '{p['crp']}' THEN PL_Value END)
  > {_f(p['crp_above'])}, false)"""
        return _coincident_sql(tuple(lim) + (p["crp"],), rule, p["at"], drop_null=True)
    if key == "dx_delayed_elimination":
        return dme_sql(p["crea"], p["mtx"])
    raise KeyError(key)


def _coincident_sql(codes, rule: str, at: str, drop_null: bool) -> str:
    code_list = ", ".join(f"'{c}'" for c in codes)
    nn = " AND PL_Value IS NOT NULL" if drop_null else ""
    return f"""WITH d AS (SELECT {OUT}, {at} FROM ({ATT}) a WHERE IUPAC_CODE IN ({code_list}){nn}),
k AS (SELECT NOPHO_NR, {at}, {rule} AS det FROM d GROUP BY NOPHO_NR, {at})
SELECT d.*, coalesce(k.det, false) AS detection
FROM d LEFT JOIN k ON k.NOPHO_NR = d.NOPHO_NR AND k.{at} = d.{at}"""


def baseline_sql(crea: str, src: str = ATT) -> str:
    return f"""SELECT NOPHO_NR, PL_Value AS baseline_crea FROM (
  SELECT NOPHO_NR, PL_Value, row_number() OVER (PARTITION BY NOPHO_NR
    ORDER BY HOUR_DIFF_SAMPLE_INF DESC, PL_DATETIME, SAMPLE_ID) AS rn
  FROM ({src}) a WHERE IUPAC_CODE = '{crea}' AND INFNO = 0 AND PL_Value IS NOT NULL
    AND HOUR_DIFF_SAMPLE_INF IS NOT NULL) b WHERE rn = 1"""


def dme_sql(crea: str, mtx: str) -> str:
    d = f"""SELECT {OUT}, HOUR_DIFF_SAMPLE_INF FROM ({ATT}) a
WHERE IUPAC_CODE IN ('{crea}', '{mtx}') AND INFNO IS NOT NULL AND PL_Value IS NOT NULL"""
    h, v = "HOUR_DIFF_SAMPLE_INF", "PL_Value"
    return f"""WITH d AS ({d}),
b AS ({baseline_sql(crea, d)}),
d3 AS (SELECT d.*, b.baseline_crea, lag(d.PL_Value) OVER (PARTITION BY d.NOPHO_NR, d.INFNO, d.IUPAC_CODE
    ORDER BY d.PL_DATETIME, d.SAMPLE_ID) AS prev_value FROM d JOIN b ON b.NOPHO_NR = d.NOPHO_NR),
d4 AS (SELECT *,
  coalesce(INFNO <> 0 AND IUPAC_CODE = '{crea}' AND (
      (prev_value IS NOT NULL AND {v} - prev_value > {_f(0.3 * 88.42)})
      OR (CASE WHEN baseline_crea = 0 THEN {v} > 0 ELSE {v} / baseline_crea > {_f(1.5)} END)),
    false) AS cc,
  coalesce(INFNO <> 0 AND IUPAC_CODE = '{mtx}' AND (
      ({h} >= 36 AND {h} < 42 AND {v} > {_f(20.0)})
      OR ({h} >= 42 AND {h} < 48 AND {v} > {_f(10.0)})
      OR ({h} > 48 AND {v} > {_f(5.0)})), false) AS mc
  FROM d3),
t AS (SELECT NOPHO_NR, INFNO, bool_or(cc) AND bool_or(mc) AS det FROM d4 GROUP BY NOPHO_NR, INFNO)
SELECT d4.{OUT.replace(', ', ', d4.')}, d4.{h}, d4.baseline_crea, d4.prev_value,
  coalesce(t.det, false) AS detection
FROM d4 LEFT JOIN t ON t.NOPHO_NR = d4.NOPHO_NR AND t.INFNO = d4.INFNO"""


def all_dx_sql(strict: bool = False) -> str:
    parts = []
    for key, name in [*((k, name) for k, (name, _) in DX.items()), ("dx_delayed_elimination", "HDM")]:
        parts.append(f"""SELECT '{name}' AS name, NOPHO_NR, SAMPLE_ID, PL_DATETIME, IUPAC_CODE,
  PL_Value, INFNO, detection FROM ({dx_sql(key, strict)}) q_{key}""")
    return "\nUNION ALL\n".join(parts)


def _bin_case(h: str) -> str:
    whens = " ".join(f"WHEN {h} > {lo} AND {h} <= {hi} THEN '{label}'" for lo, hi, label in BINS)
    return f"CASE {whens} ELSE '{NO_BIN}' END"


def time_bin_pivot_sql() -> str:
    h = "((epoch_us(m.PL_DATETIME) - epoch_us(m._inf_start)) / 3600000000.0)"
    cols = ",\n  ".join(
        f"arg_min({meas}, PL_DATETIME) FILTER (WHERE _bin = '{label}' AND {meas} IS NOT NULL) AS {meas}_{label}"
        for meas in MEASURES for label in [b[2] for b in BINS] + [NO_BIN])
    return f"""WITH p AS ({ATT_PLASMA}), inf AS ({INFUSIONS}),
m AS (SELECT p.*, i.INF_START_DATETIME AS _inf_start FROM p
  LEFT JOIN inf i ON i.NOPHO_NR = p.NOPHO_NR AND i.INFNO = p.INFNO
  WHERE p.NOPHO_NR IS NOT NULL AND p.INFNO IS NOT NULL),
mb AS (SELECT m.*, {_bin_case(h)} AS _bin FROM m)
SELECT INFNO, NOPHO_NR,
  {cols}
FROM mb GROUP BY INFNO, NOPHO_NR
HAVING count(PL_PC) FILTER (WHERE _bin IS NOT NULL) + count(PL_MTX) FILTER (WHERE _bin IS NOT NULL) > 0"""


def _flagged(code="click", below=100.0) -> str:
    return f"""SELECT NOPHO_NR, SAMPLE_ID, PL_DATETIME, PL_Value,
  coalesce(PL_Value < {_f(below)}, false) AS detection FROM ({SAMPLES}) s WHERE IUPAC_CODE = '{code}'"""


DOCS_LABELS = """SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


CODEBOOK_SHEET = """SELECT 'O' || CAST(l_orderkey AS VARCHAR) AS column_name,
  'order ' || CAST(l_orderkey AS VARCHAR) AS description,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS row_no,
  CASE WHEN l_returnflag <> 'R' THEN CAST(l_linenumber AS VARCHAR) || ' | part ' || CAST(l_partkey AS VARCHAR) END AS cell
FROM lineitem"""

CODEBOOK_CODES = f"""WITH s AS ({CODEBOOK_SHEET}),
st AS (SELECT column_name, min(CASE WHEN cell IS NULL OR trim(cell) = '' THEN row_no END) AS stop
  FROM s GROUP BY column_name)
SELECT s.column_name, s.description, s.row_no, split_part(s.cell, ' | ', 1) AS code,
  CASE WHEN strpos(s.cell, ' | ') > 0 THEN substring(s.cell, strpos(s.cell, ' | ') + 3) END AS label
FROM s JOIN st ON st.column_name = s.column_name WHERE st.stop IS NULL OR s.row_no < st.stop"""

CODEBOOK_MAPS = f"""WITH c AS ({CODEBOOK_CODES}),
d AS (SELECT column_name, description FROM (SELECT column_name, description,
    row_number() OVER (PARTITION BY column_name ORDER BY row_no) AS k FROM c) x WHERE k = 1),
e AS (SELECT column_name, code, min(row_no) AS r, arg_max(label, row_no) AS v FROM c
  WHERE code IS NOT NULL GROUP BY column_name, code),
m AS (SELECT column_name, count(*) AS n_codes,
  to_json(map_from_entries(list(struct_pack(k := code, v := v) ORDER BY r))) AS details_json
  FROM e GROUP BY column_name)
SELECT d.column_name, d.description, m.n_codes, m.details_json FROM d JOIN m USING (column_name)"""

DESCRIPTION_SHEET = """SELECT 'P' || CAST(l_partkey AS VARCHAR) AS variable,
  CASE WHEN l_returnflag <> 'R' THEN 'order ' || CAST(l_orderkey AS VARCHAR) END AS question,
  CAST(l_linenumber AS VARCHAR) AS detail_value, l_orderkey * 8 + l_linenumber AS row_no,
  l_partkey AS tb1, l_suppkey AS tb2
FROM lineitem"""

DESCRIBED = f"""WITH sh AS ({DESCRIPTION_SHEET}),
r1 AS (SELECT *, lag(variable) OVER (ORDER BY row_no, tb1, tb2) AS pv,
  row_number() OVER (ORDER BY row_no, tb1, tb2) AS rn FROM sh),
r2 AS (SELECT *, sum(CASE WHEN rn = 1 OR pv IS DISTINCT FROM variable THEN 1 ELSE 0 END)
  OVER (ORDER BY row_no, tb1, tb2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r1),
fr AS (SELECT variable, min(run) AS run FROM r2 GROUP BY variable),
rw AS (SELECT r2.* FROM r2 JOIN fr ON fr.variable = r2.variable AND fr.run = r2.run),
fq AS (SELECT variable, question AS q FROM (SELECT variable, question,
  row_number() OVER (PARTITION BY variable ORDER BY row_no, tb1, tb2) AS k FROM rw) x WHERE k = 1),
en0 AS (SELECT variable, detail_value AS k, coalesce(question, detail_value) AS v,
  row_number() OVER (PARTITION BY variable, detail_value ORDER BY row_no, tb1, tb2) AS first_k,
  row_number() OVER (PARTITION BY variable, detail_value ORDER BY row_no DESC, tb1 DESC, tb2 DESC) AS last_k,
  row_no, tb1, tb2 FROM rw WHERE detail_value IS NOT NULL),
en AS (SELECT f.variable, f.k, f.row_no AS r, f.tb1 AS r1, f.tb2 AS r2, l.v FROM en0 f
  JOIN en0 l ON l.variable = f.variable AND l.k = f.k AND l.last_k = 1 WHERE f.first_k = 1),
mp AS (SELECT variable, to_json(map_from_entries(list(struct_pack(k := k, v := v) ORDER BY r, r1, r2))) AS dj
  FROM en GROUP BY variable),
per AS (SELECT fq.variable, trim(fq.q) AS d, CASE WHEN fq.q IS NOT NULL THEN coalesce(mp.dj, '{{}}') END AS dj
  FROM fq LEFT JOIN mp ON mp.variable = fq.variable),
cols AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS column_name FROM part)
SELECT cols.column_name, coalesce(per.d, cols.column_name) AS description, per.dj AS details_json
FROM cols LEFT JOIN per ON per.variable = cols.column_name"""

PART_DESCRIPTIONS = """SELECT 'P' || CAST(p_partkey AS VARCHAR) AS column_name, p_name AS description,
  to_json(map(['size'], [CAST(p_size AS VARCHAR)])) AS details_json FROM part"""


TEXT_EVENTS = """SELECT event_id::VARCHAR AS event_id, value::VARCHAR AS value,
  CASE WHEN event_type <> 'signup' THEN user_id::VARCHAR END AS patient,
  CASE WHEN event_type = 'signup' THEN event_type ELSE json_extract_string(props, '$.k') END AS mixed,
  strftime(ts, '%Y-%m-%d') AS day, NULL::VARCHAR AS unused FROM events"""


def _bind(text: str, values: dict) -> str:
    for k, v in values.items():
        lit = f"'{v}'" if isinstance(v, str) else repr(v)
        text = text.replace(f"[{k}]", lit)
    return text


def _extra_oracles() -> dict[str, str]:
    return {
        "codebook_split": CODEBOOK_CODES,
        "codebook_maps": CODEBOOK_MAPS,
        "describe_columns": DESCRIBED,
        "merge_descriptions": f"""WITH u AS (SELECT column_name, description, details_json, 0 AS prio FROM ({DESCRIBED}) a
  UNION ALL SELECT column_name, description, details_json, 1 FROM ({PART_DESCRIPTIONS}) b),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY prio DESC) AS k FROM u)
SELECT column_name, description, details_json FROM r WHERE k = 1""",
        "descriptions_flatten": f"""SELECT 'lineitem' AS table_name, column_name, description, details_json
FROM ({CODEBOOK_MAPS}) m""",
        "codebook_write": f"SELECT column_name, description, n_codes, details_json FROM ({CODEBOOK_MAPS}) m",
        "codebook_scan": f"""WITH c AS ({CODEBOOK_CODES}),
e AS (SELECT column_name, code, arg_max(label, row_no) AS label FROM c WHERE code IS NOT NULL
  GROUP BY column_name, code)
SELECT column_name, code, label FROM e""",
        "codebook_combine": f"""SELECT column_name, description, n_codes AS n_details FROM ({CODEBOOK_MAPS}) m
UNION ALL
SELECT column_name, description, CAST(json_array_length(json_keys(CAST(details_json AS JSON))) AS BIGINT)
FROM ({DESCRIBED}) d""",
        "key_containment": """WITH k AS (
  SELECT DISTINCT 'doc_id' AS column_name, 'documents' AS table_name, CAST(doc_id AS VARCHAR) AS key
    FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'doc_id', 'labels', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id IS NOT NULL),
pk AS (SELECT column_name, key, count(*) AS n FROM k GROUP BY column_name, key)
SELECT k.column_name, k.table_name, count(*) AS n_keys, count(*) FILTER (WHERE pk.n > 1) AS n_shared
FROM k JOIN pk ON pk.column_name = k.column_name AND pk.key = k.key GROUP BY k.column_name, k.table_name""",
        "sql_adhoc": ADHOC_SQL,
        "sql_params": _bind(PARAM_SQL, PARAM_VALUES),
        "csv_roundtrip": "SELECT * FROM documents",
        "table_append": f"SELECT *, CASE WHEN INFNO <= 4 THEN 'low' ELSE 'high' END AS load_batch FROM ({INFUSIONS}) i",
        "csv_types": f"""WITH t AS ({TEXT_EVENTS}),
v AS (SELECT unnest(['event_id', 'value', 'patient', 'mixed', 'day', 'unused']) AS column_name,
  unnest([event_id, value, patient, mixed, day, unused]) AS x FROM t),
p AS (SELECT column_name, count(*) AS n_rows, count(*) - count(x) AS n_missing, count(try_cast(x AS BIGINT)) FILTER (x NOT LIKE '%.%') AS n_bigint,
  count(try_cast(x AS DOUBLE)) AS n_double, count(try_cast(x AS DATE)) FILTER (x LIKE '____-__-__') AS n_date,
  count(try_cast(x AS TIMESTAMP)) FILTER (x LIKE '____-__-__') AS n_timestamp_ntz FROM v GROUP BY column_name)
SELECT *, CASE column_name WHEN 'event_id' THEN 'bigint' WHEN 'value' THEN 'double' WHEN 'patient' THEN 'double' WHEN 'day' THEN 'date'
  ELSE 'string' END AS inferred FROM p""",
        "csv_inferred": f"""SELECT event_id::BIGINT AS event_id, value::DOUBLE AS value, patient::DOUBLE AS patient, mixed, day, unused
FROM ({TEXT_EVENTS}) t""",
        "csv_rejects": f"""SELECT event_id::BIGINT AS event_id, try_cast(mixed AS INTEGER) AS mixed,
  CASE WHEN try_cast(mixed AS INTEGER) IS NULL AND mixed IS NOT NULL THEN event_id || ',' || mixed END AS record FROM ({TEXT_EVENTS}) t""",
    }


def _dx_oracles() -> dict[str, str]:
    return {k: dx_sql(k) for k in DX}


def oracles() -> dict[str, str]:
    chart = "NOPHO_NR, SAMPLE_ID, PL_DATETIME, IUPAC_CODE, PL_Value, INFNO, SEX, MP6_POST_STOP, detection"
    part_cols = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    order_cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                  "o_orderpriority"]
    streak_src = streak_rows(_flagged(), "detection")
    phen = f"""SELECT NOPHO_NR, CAST(max(CAST(detection AS INTEGER)) AS INTEGER) AS PHONOTYPE
FROM ({all_dx_sql()}) u GROUP BY NOPHO_NR"""
    rare = phen.replace(all_dx_sql(), all_dx_sql(strict=True))
    o = {
        "scan_uppercase": "SELECT " + ", ".join(f'{c} AS "{c.upper()}"' for c in order_cols)
                          + " FROM orders",
        "normalize_columns": "SELECT " + ", ".join(f'{c} AS "{c.replace("_", " ")}"' for c in part_cols)
                             + " FROM part",
        "drop_null_rows": f"SELECT * FROM ({DOCS_LABELS}) q WHERE quality IS NOT NULL AND toxic IS NOT NULL",
        "drop_null_columns": DOCS_LABELS,
        "drop_sparse_columns": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "declared_casts": """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS props_k,
  TRY_CAST(event_type AS INTEGER) AS kind FROM events""",
        "clean_strings": f"""SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' ELSE coalesce(trim(role, {SPACES}), '') END AS role,
  coalesce(trim(text, {SPACES}), '') AS text FROM conversations""",
        "combine_date_time": """SELECT o_orderkey,
  CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + (t - CAST(CAST(t AS DATE) AS TIMESTAMP)) AS combined
FROM (SELECT o_orderkey, o_orderdate, o_orderdate + to_seconds(o_orderkey) AS t FROM orders) q""",
        "clean_samples": PLASMA,
        "clean_infusions": INFUSIONS,
        "parse_limit_text": f"""SELECT SAMPLE_ID, REFTEXT,
  TRY_CAST(replace(replace(REFTEXT, '<', ''), ',', '.') AS DOUBLE) AS limit_value FROM ({SAMPLES}) s""",
        "concat_values": f"""SELECT doc_id, concat_ws(',', lang, source, CAST(quality AS VARCHAR),
  CAST(toxic AS VARCHAR)) AS joined FROM ({DOCS_LABELS}) q""",
        "melt_samples": f"""SELECT NOPHO_NR, SAMPLE_ID, PL_DATETIME, 'PL_PC' AS PL_Type, PL_PC AS PL_Value,
  'NPU18016' AS IUPAC_CODE FROM ({PLASMA}) p
UNION ALL
SELECT NOPHO_NR, SAMPLE_ID, PL_DATETIME, 'PL_MTX', PL_MTX, 'NPU02739' FROM ({PLASMA}) p""",
        "time_bin_label": f"""SELECT SAMPLE_ID, h AS TIME_DIFF, {_bin_case('h')} AS TIME_GROUP FROM (
  SELECT SAMPLE_ID, (epoch_us(PL_DATETIME) - epoch_us(MTX_INFDATE)) / 3600000000.0 AS h
  FROM ({ATT_PLASMA}) a) q""",
        "time_bin_pivot": time_bin_pivot_sql(),
        "matrix_join": f"""SELECT * FROM ({INFUSIONS}) i
  LEFT JOIN ({time_bin_pivot_sql()}) m USING (NOPHO_NR, INFNO)""",
        "filter_infusions": f"SELECT * FROM ({ATT}) a WHERE INFNO IN (1, 2, 3)",
        "attribute_samples": f"SELECT * EXCLUDE (PL_DAY) FROM ({ATT}) a",
        "attach_sex": f"""SELECT s.*, x.SEX FROM ({SAMPLES}) s
  LEFT JOIN (SELECT DISTINCT NOPHO_NR, SEX FROM ({INFUSIONS}) i WHERE SEX <> 0) x
  ON x.NOPHO_NR = s.NOPHO_NR""",
        "attach_stop_flag": f"""SELECT a.NOPHO_NR, a.SAMPLE_ID, a.INFNO, x.MP6_POST_STOP FROM ({ATT}) a
  LEFT JOIN (SELECT DISTINCT NOPHO_NR, INFNO, MP6_POST_STOP FROM ({INFUSIONS}) i) x
  ON x.NOPHO_NR = a.NOPHO_NR AND x.INFNO = a.INFNO""",
        "duplicate_treatments": f"""SELECT NOPHO_NR, INFNO, count(*) AS n_rows FROM ({BLOCK_INFUSIONS}) b
  GROUP BY NOPHO_NR, INFNO HAVING count(*) > 1""",
        "drop_duplicate_patients": f"""SELECT * FROM ({BLOCK_INFUSIONS}) b WHERE NOPHO_NR NOT IN (
  SELECT NOPHO_NR FROM ({BLOCK_INFUSIONS}) b2 GROUP BY NOPHO_NR, INFNO HAVING count(*) > 1)""",
        "distinct_treatments": f"SELECT DISTINCT * FROM ({BLOCK_INFUSIONS}) b",
        "streak_id": f"""SELECT NOPHO_NR, SAMPLE_ID, PL_DATETIME, PL_Value, detection, _sid AS streak_id
FROM ({streak_src}) q""",
        "streak_groups": f"""SELECT NOPHO_NR, _sid AS streak_id, min(PL_DATETIME) AS min_date,
  max(PL_DATETIME) AS max_date, bool_or(detection) AS is_streak_positive,
  (epoch_us(max(PL_DATETIME)) - epoch_us(min(PL_DATETIME))) / 3600000000.0 AS streak_duration
FROM ({streak_src}) q GROUP BY NOPHO_NR, _sid""",
        "streak_flag": f"""SELECT NOPHO_NR, SAMPLE_ID, PL_DATETIME, PL_Value,
  (detection AND {_long(48.0)}) AS detection FROM ({streak_src}) q""",
        "value_delta": f"""SELECT NOPHO_NR, SAMPLE_ID, PL_DATETIME, IUPAC_CODE, PL_Value, INFNO,
  lag(PL_Value) OVER (PARTITION BY NOPHO_NR, INFNO, IUPAC_CODE ORDER BY PL_DATETIME, SAMPLE_ID) AS prev_value
FROM ({ATT}) a WHERE INFNO IS NOT NULL""",
        "baseline_value": baseline_sql("click"),
        "pivot_mean": f"""SELECT NOPHO_NR, PL_DAY,
  round(avg(CASE WHEN IUPAC_CODE = 'click' THEN PL_Value END), 6) AS click,
  round(avg(CASE WHEN IUPAC_CODE = 'purchase' THEN PL_Value END), 6) AS purchase,
  round(avg(CASE WHEN IUPAC_CODE = 'view' THEN PL_Value END), 6) AS view,
  round(avg(CASE WHEN IUPAC_CODE = 'error' THEN PL_Value END), 6) AS error
FROM ({SAMPLES_DAY}) s WHERE IUPAC_CODE IN ('click', 'purchase', 'view', 'error')
GROUP BY NOPHO_NR, PL_DAY""",
        "detected_patients": f"""SELECT NOPHO_NR FROM ({dx_sql('dx_renal')}) q
  GROUP BY NOPHO_NR HAVING bool_or(detection)""",
        "run_diagnostics": all_dx_sql(),
        "patient_phenotype": phen,
        "summary_detection": f"""WITH pp AS (SELECT name, NOPHO_NR, bool_or(detection) AS pos
    FROM ({all_dx_sql()}) u GROUP BY name, NOPHO_NR),
  c AS (SELECT name, count(*) AS n_all, count(*) FILTER (WHERE pos) AS n_pos FROM pp GROUP BY name)
SELECT name, 'patients with all negative diagnostic' AS type, n_all - n_pos AS number_of_patients FROM c
UNION ALL
SELECT name, 'patients with one positive diagnostic', n_pos FROM c""",
        "phenotype_counts": f"""SELECT count(*) AS n_patients,
  count(*) FILTER (WHERE PHONOTYPE = 1) AS n_positive,
  count(*) FILTER (WHERE PHONOTYPE = 0) AS n_negative FROM ({rare}) p""",
        "patients_in_scope": f"""SELECT count(DISTINCT NOPHO_NR) AS n_patients,
  count(DISTINCT CASE WHEN IUPAC_CODE = 'purchase' THEN NOPHO_NR END) AS n_patients_with_code
FROM ({ATT}) a WHERE INFNO IN (1, 2, 3, 4)""",
        "cleaning_report": """SELECT count(*) AS rows_before, CAST(6 AS BIGINT) AS cols_before,
  count(*) FILTER (WHERE json_extract_string(props, '$.k') IS DISTINCT FROM '0') AS rows_after,
  CAST(5 AS BIGINT) AS cols_after
FROM events WHERE event_type IN ('click', 'purchase')""",
        "sorted_samples": SAMPLES,
        "sample_rows": f"""SELECT * EXCLUDE (PL_DAY) FROM ({ATT}) a WHERE INFNO IS NOT NULL
ORDER BY md5(CAST(SAMPLE_ID AS VARCHAR) || '42'), SAMPLE_ID LIMIT 100""",
        "chart_samples": f"SELECT {chart} FROM ({dx_sql('dx_renal')}) q",
        "detected_samples": f"""SELECT {chart} FROM ({dx_sql('dx_neutropenia')}) q WHERE NOPHO_NR IN (
  SELECT NOPHO_NR FROM ({dx_sql('dx_neutropenia')}) q2 GROUP BY NOPHO_NR HAVING bool_or(detection))""",
        "patient_samples": f"SELECT {chart} FROM ({dx_sql('dx_neutropenia')}) q WHERE NOPHO_NR = {CHART_PATIENT}",
        "elimination_curve": f"""SELECT NOPHO_NR, CAST(INFNO AS VARCHAR) AS INFNO, HOUR_DIFF_SAMPLE_INF,
  PL_Value, PL_DATETIME, MTX_INFDATE, SAMPLE_ID FROM ({ATT}) a
WHERE IUPAC_CODE = 'purchase' AND NOPHO_NR = {CHART_PATIENT} AND PL_Value IS NOT NULL AND PL_Value > 0
  AND INFNO IS NOT NULL""",
        "chunk_text": """SELECT doc_id, CAST(g.i AS INTEGER) AS chunk_no, substring(text, CAST(g.i * 4096 + 1 AS BIGINT), 4096) AS chunk
FROM documents, generate_series(0, CAST(ceil(length(text) / 4096.0) AS BIGINT) - 1) AS g(i)""",
        "concat_group_text": """WITH l AS (SELECT *, concat_ws(': ', role, text) AS line FROM conversations),
s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT conv_id, CAST(floor(before / 4096) AS BIGINT) AS piece_no,
  string_agg(line, chr(10) ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS joined_text,
  count(*) AS n_lines FROM s GROUP BY conv_id, piece_no""",
        "sample_with_replacement": f"""WITH r AS (SELECT * EXCLUDE (PL_DAY),
    row_number() OVER (ORDER BY md5(coalesce(CAST(SAMPLE_ID AS VARCHAR), '') || '42'), SAMPLE_ID) - 1 AS spot,
    count(*) OVER () AS total FROM ({ATT}) a),
w AS (SELECT i AS draw_no, CAST('0x' || substr(md5(i || '|42'), 1, 12) AS BIGINT) AS h FROM range(1, 101) t(i))
SELECT r.* EXCLUDE (spot, total), w.draw_no FROM w JOIN r ON w.h % r.total = r.spot""",
    }
    o.update(_dx_oracles())
    o.update(_extra_oracles())
    return o
