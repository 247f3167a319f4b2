"""DuckDB SQL fragments shared by the oracle queries (same fixture as sources/fixtures.py)."""

from __future__ import annotations

IMPRESSIONS = """impressions AS (
  SELECT 'EV' || event_id AS "ID", event_id AS rid, (event_type = 'click')::INT AS clicked,
         (k % 18)::INT AS inventory_id, (isodow(ts) - 1)::INT AS day_of_week, hour(ts)::INT AS "hour",
         CASE WHEN len(h) > 0 THEN array_to_string(h, ',') END AS seq,
         CASE WHEN event_id % 17 <> 0 THEN value END AS feat_a_1,
         CASE WHEN event_id % 11 <> 0 THEN (user_id % 7)::VARCHAR END AS l_feat_14,
         user_id, k, value
  FROM (SELECT *, list(k) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING) AS h
        FROM (SELECT *, (props::JSON ->> 'k')::INT AS k FROM events))
)"""

TRAIN = "train AS (SELECT * FROM impressions WHERE rid % 10 <> 9)"
TEST = "test AS (SELECT * EXCLUDE (clicked) FROM impressions WHERE rid % 10 = 9)"

SCORES = """scores AS (
  SELECT "ID", rid, clicked, inventory_id, day_of_week,
         (floor(value) + 1) / 600.0 AS p,
         (2 * clicked - 1) * 1.0 + (value - 50) / 50.0 AS z
  FROM impressions)"""

MODEL_OUTPUTS = """mo AS (
  SELECT "ID", rid, clicked,
         (floor(value) + 1) / 600.0 AS p1, (k + 1) / 102.0 AS p2,
         (rid % 97 + 1) / 99.0 AS p3, (user_id % 13 + 1) / 15.0 AS p4
  FROM impressions)"""

PRED_TABLES = """pa AS (SELECT "ID", p1 AS clicked FROM mo),
pb AS (SELECT "ID", p2 AS clicked FROM mo WHERE rid % 50 <> 0)"""


def md5_u32(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT)"


def md5_u60(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 15))::BIGINT)"


def cat_str(col: str) -> str:
    return f"coalesce(CAST({col} AS VARCHAR), 'NA')"


def group_hash(cols: list[str]) -> str:
    parts = [cat_str(c) for c in cols]
    s = parts[0] if len(parts) == 1 else f"concat_ws(chr(31), {', '.join(parts)})"
    return f"({md5_u32(s)} % 2147483647)"


def bucket(col: str, m: int) -> str:
    return f"({md5_u32(cat_str(col))} % {int(m)})::INT"


def folds_cte(src: str = "train", cols=("inventory_id", "day_of_week"), n: int = 5,
              name: str = "trainf") -> str:
    g = group_hash(list(cols))
    return f"""{name}_g AS (SELECT *, {g} AS g FROM {src}),
{name}_map AS (SELECT g, ((row_number() OVER (ORDER BY g) - 1) % {n})::INT AS fold
               FROM (SELECT DISTINCT g FROM {name}_g)),
{name} AS (SELECT t.*, m.fold FROM {name}_g t LEFT JOIN {name}_map m USING (g))"""


def lenient_tail(seq: str, k: int) -> str:
    parsed = (f"(CASE WHEN {seq} IS NULL THEN []::INT[] ELSE "
              f"list_transform(string_split({seq}, ','), lambda x: TRY_CAST(x AS INTEGER)) END)")
    return (f"(CASE WHEN len({parsed}) > {k} THEN list_slice({parsed}, len({parsed}) - {k - 1}, "
            f"len({parsed})) ELSE {parsed} END)")


def tokens_cte(name: str, src: str, keep: list[str], targets: list[str], tb: str, k: int,
               tau: float, outer: bool) -> str:
    """Exploded history tokens with positions, stacked over targets."""
    keep_s = ", ".join(keep)
    lst = "l" if not outer else "(CASE WHEN len(l) = 0 THEN [NULL]::INT[] ELSE l END)"
    # a position counts the tokens that are not null up to and with its own
    placed = (f"list_transform({lst}, lambda x, i: {{'token': x, "
              f"'pos': len(list_filter(({lst})[1:i], lambda t: t IS NOT NULL)) - 1}})")
    parts = []
    for t in targets:
        parts.append(f"""SELECT {keep_s}, '{t}' AS target, CAST({t} AS VARCHAR) AS target_value,
       {tb} AS time_bin, pos, token, exp(-pos / {float(tau)}) AS w_rec
FROM (SELECT *, pt.token AS token, pt.pos AS pos
      FROM (SELECT *, unnest({placed}) AS pt FROM (SELECT *, {lenient_tail('seq', k)} AS l FROM {src})))""")
    body = "\nUNION ALL\n".join(parts)
    where = "" if outer else " WHERE token IS NOT NULL"
    return f"{name} AS (SELECT * FROM ({body}){where})"


def smooth(clicks: str, impr: str, p0: str, s: float = 50.0, lo: float = 1e-3, hi: float = 0.999) -> str:
    raw = f"(({clicks} + {p0} * {float(s)}) / ({impr} + {float(s)}))"
    inner = f"least(greatest({raw}, 1e-9), 1 - 1e-9)"
    return f"least(greatest({inner}, {lo}), {hi})"


def query(ctes: list[str], body: str, round_cols: list[str] | None = None, recursive: bool = False) -> str:
    with_ = "WITH RECURSIVE " if recursive else "WITH "
    sql = with_ + ",\n".join(ctes) + "\n" + body if ctes else body
    if round_cols:
        rep = ", ".join(f"CASE WHEN abs({c}) < 1e-3 AND abs({c}) > 1e-12 THEN printf('%.5e', {c}::DOUBLE)::DOUBLE "
                        f"ELSE round({c}, 6) END AS {c}" for c in round_cols)
        sql = f"WITH _q AS ({sql})\nSELECT * REPLACE ({rep}) FROM _q" if not ctes else \
              with_ + ",\n".join(ctes) + f",\n_q AS ({body})\nSELECT * REPLACE ({rep}) FROM _q"
    return sql


def hyg(p: str, eps: float) -> str:
    h = (f"(CASE WHEN isnan({p}) THEN 0.5 WHEN {p} = 'inf'::DOUBLE THEN 1.0 "
         f"WHEN {p} = '-inf'::DOUBLE THEN 0.0 ELSE {p} END)")
    return f"least(greatest({h}, {eps}), 1 - {eps})"


def ap_sql(src: str, y: str = "y", p: str = "p", by: str | None = None) -> str:
    """Average precision per group over a table/CTE ``src``."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    q = hyg(p, 1e-12)
    return f"""SELECT {g}CASE WHEN max(npos) = 0 OR max(npos) = max(ntot) THEN 0.0
            ELSE sum(tp * ctp / cn) / max(npos) END AS ap
FROM (SELECT {g}tp, sum(tp) OVER ({part}ORDER BY q DESC) AS ctp, sum(n) OVER ({part}ORDER BY q DESC) AS cn,
             sum(tp) OVER ({part.strip() if by else ''}) AS npos, sum(n) OVER ({part.strip() if by else ''}) AS ntot
      FROM (SELECT {g}{q} AS q, sum(CASE WHEN {y} = 1 THEN 1 ELSE 0 END) AS tp, count(*) AS n
            FROM {src} GROUP BY ALL))
GROUP BY ALL"""


def wll_sql(src: str, y: str = "y", p: str = "p", by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    q = hyg(p, 1e-12)
    return f"""SELECT {g}CASE WHEN lp IS NULL OR ln IS NULL THEN 'nan'::DOUBLE ELSE 0.5 * (lp + ln) END AS wll
FROM (SELECT {g}avg(CASE WHEN {y} = 1 THEN -ln({q}) END) AS lp,
             avg(CASE WHEN NOT ({y} = 1) THEN -ln(1 - {q}) END) AS ln FROM {src} GROUP BY ALL)"""


def logit_sql(p: str, eps: float = 1e-7) -> str:
    q = f"least(greatest({p}, {eps}), 1 - {eps})"
    return f"(ln({q}) - ln(1 - {q}))"


def sigmoid_sql(z: str) -> str:
    return f"(1.0 / (1.0 + exp(-({z}))))"


def clip_sql(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {lo}), {hi})"
