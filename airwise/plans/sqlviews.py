"""DuckDB SQL twins of the engine tables, for the oracle comparison.

Each entry is (definition, dependencies).  ``with_views`` prepends the
needed CTEs to an oracle query body.  These are written independently of
the Spark builders in ``airwise.sources.tables``; agreement between the two
is what the correctness check measures.
"""

from __future__ import annotations


def sround(expr: str, n: int) -> str:
    """DuckDB twin of Spark's round(double, n): HALF_UP on the shortest decimal text of
    the double (Python's round agrees except at exact binary ties)."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38, 18)), {n}) AS DOUBLE)"


def expand_wtrim(sql: str) -> str:
    """Rewrite ``wtrim(x)`` pseudo-calls as a whitespace trim (JavaScript trim / Python strip)."""
    out, i = [], 0
    while True:
        j = sql.find("wtrim(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + 5
        while True:
            c = sql[k]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        out.append(f"regexp_replace({expand_wtrim(sql[j + 6:k])}, '^\\s+|\\s+$', '', 'g')")
        i = k + 1


def expand_sround(sql: str) -> str:
    """Rewrite every ``sround(expr, n)`` pseudo-call in ``sql`` with :func:`sround`."""
    out, i = [], 0
    while True:
        j = sql.find("sround(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k, cut = 0, j + 6, None
        while True:
            c = sql[k]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0:
                    break
            elif c == "," and depth == 1:
                cut = k
            k += 1
        expr, n = sql[j + 7:cut], int(sql[cut + 1:k].strip())
        out.append(sql[i:j])
        out.append(sround(expand_sround(expr), n))
        i = k + 1


def holiday_sql(d: str) -> str:
    """DuckDB expression: US holiday flag of date expression ``d``."""
    fixed = " OR ".join(f"(month({d}) = {m} AND day({d}) = {dd})"
                        for m, dd in [(1, 1), (7, 4), (11, 11), (12, 25)])
    rules = []
    for m, wd, n in [(1, 0, 3), (2, 0, 3), (9, 0, 1), (10, 0, 2), (11, 3, 4)]:
        first = f"make_date(CAST(year({d}) AS BIGINT), {m}, 1)"
        rules.append(f"({d} = {first} + CAST((({wd} - (isodow({first}) - 1) + 7) % 7) + {7 * (n - 1)} AS INTEGER))")
    return f"({fixed} OR {' OR '.join(rules)})"


def season_sql(m: str, fall: str = "fall") -> str:
    return (f"CASE WHEN {m} IN (12, 1, 2) THEN 'winter' WHEN {m} IN (3, 4, 5) THEN 'spring' "
            f"WHEN {m} IN (6, 7, 8) THEN 'summer' ELSE '{fall}' END")


def calendar_sql(d: str = "date") -> str:
    return (f"dayname({d}) AS day_of_week, CAST(month({d}) AS INTEGER) AS month, "
            f"{season_sql(f'month({d})')} AS season, {holiday_sql(d)} AS holiday_flag")


VIEWS: dict[str, tuple[str, list[str]]] = {
    "readings": ("""
        SELECT event_id, CAST(user_id % 10 + 10 * (user_id // 150) AS VARCHAR) AS location_id, user_id, ts,
               CAST(ts AS DATE) AS date, value AS pm, event_type AS kind,
               TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events""", []),
    "env_agg": ("""
        SELECT location_id, date,
               avg(pm) AS PM2_5_mean, max(pm) AS PM2_5_max,
               CAST(max(k) AS DOUBLE) * 2 AS AQI,
               CAST(min(k) AS DOUBLE) / 4 - 5 AS temp_min,
               CAST(max(k) AS DOUBLE) / 4 AS temp_max,
               avg(k) AS humidity,
               CAST(count(*) AS DOUBLE) / 10 AS wind,
               101000 + avg(k) * 10 AS pressure,
               coalesce(sum(CASE WHEN kind = 'error' THEN pm END), 0) / 100 AS rain,
               max(CASE WHEN kind = 'click' THEN pm END) / 40 AS pollen_tree,
               max(CASE WHEN kind = 'view' THEN pm END) / 40 AS pollen_grass,
               max(CASE WHEN kind = 'purchase' THEN pm END) / 40 AS pollen_weed
        FROM readings GROUP BY location_id, date""", ["readings"]),
    "env_daily": (f"""
        SELECT location_id,
               CAST(30 + CAST(location_id AS INTEGER) % 10 AS DOUBLE) + (CAST(location_id AS INTEGER) // 10) * 0.0001::DOUBLE AS latitude,
               CAST(-120 - CAST(location_id AS INTEGER) % 10 AS DOUBLE) - (CAST(location_id AS INTEGER) // 10) * 0.0001::DOUBLE AS longitude,
               CASE WHEN CAST(location_id AS INTEGER) % 3 = 0 THEN NULL ELSE '9410' || location_id END AS zip_code,
               date, PM2_5_mean, PM2_5_max, AQI, temp_min, temp_max, humidity, wind, pressure, rain,
               pollen_tree, pollen_grass, pollen_weed, {calendar_sql()}
        FROM env_agg""", ["env_agg"]),
    "big_agg": ("""
        SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date,
               avg(l_quantity) AS PM2_5_mean, max(l_quantity) AS PM2_5_max,
               max(l_extendedprice) / 700 AS AQI,
               min(l_tax) * 400 - 5 AS temp_min, max(l_tax) * 400 + 5 AS temp_max,
               avg(l_tax) * 1000 AS humidity, avg(l_discount) * 100 AS wind,
               CAST(100000 + max(l_linenumber) * 200 AS DOUBLE) AS pressure,
               sum(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE CAST(0 AS DOUBLE) END) * 10 AS rain,
               max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) / 5 AS pollen_tree,
               max(CASE WHEN l_linestatus = 'O' THEN l_quantity END) / 5 AS pollen_grass,
               max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) / 5 AS pollen_weed
        FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""", []),
    "daily_big": (f"""
        SELECT CAST(l_suppkey AS VARCHAR) AS location_id,
               CAST(24 + l_suppkey % 27 AS DOUBLE) AS latitude,
               CAST(-125 + l_suppkey % 59 AS DOUBLE) AS longitude,
               CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE lpad(CAST(l_suppkey AS VARCHAR), 5, '9') END AS zip_code,
               date, PM2_5_mean, PM2_5_max, AQI, temp_min, temp_max, humidity, wind, pressure, rain,
               pollen_tree, pollen_grass, pollen_weed, {calendar_sql()}
        FROM big_agg""", ["big_agg"]),
    "checkin_agg": ("""
        SELECT user_id, CAST(ts AS DATE) AS date,
               count(*) FILTER (WHERE event_type = 'error') AS n_err,
               count(*) FILTER (WHERE event_type = 'click') AS n_click,
               count(*) FILTER (WHERE event_type = 'view') AS n_view,
               coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END), 0) AS cents,
               count(*) FILTER (WHERE event_type = 'signup') > 0 AS rescueUsed
        FROM events GROUP BY user_id, CAST(ts AS DATE)""", []),
    "checkins": ("""
        SELECT user_id, date,
               CAST(least(3, n_err) AS INTEGER) AS wheeze,
               CAST(least(3, n_click) AS INTEGER) AS cough,
               CAST(least(3, n_view) AS INTEGER) AS chestTightness,
               CAST(least(1440, floor(cents / 100)) AS INTEGER) AS exerciseMinutes,
               rescueUsed,
               CAST(least(3, n_err) + least(3, n_click) + least(3, n_view) AS DOUBLE) AS symptomScore
        FROM checkin_agg""", ["checkin_agg"]),
    "users": ("""
        SELECT c_custkey AS user_id,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(replace(c_name, '#', '')) || '@example.com' END AS email,
               c_name AS name,
               CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey % 10 + 10 * (c_custkey // 1500) AS VARCHAR) END AS location,
               c_name AS profile_name,
               CAST(4 + c_custkey % 3 AS VARCHAR) || '''' || CAST(c_custkey % 12 AS VARCHAR) || '"' AS profile_height,
               CAST(110 + c_custkey % 120 AS VARCHAR) || ' lbs' AS profile_weight,
               CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS profile_gender,
               CASE WHEN c_custkey % 4 = 0 THEN 'smoker' ELSE 'non-smoker' END AS profile_smokerStatus,
               CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'yes' ELSE 'no' END AS profile_petExposure
        FROM customer""", []),
    "trends": ("""
        SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders
        FROM orders GROUP BY CAST(o_orderdate AS DATE)""", []),
    "scored": ("""
        SELECT l.doc_id, l.quality AS y, l.toxic AS y_toxic,
               least(CAST(1 AS DOUBLE), CAST(d.n_chars AS DOUBLE) / 20000) AS p, d.lang, d.source
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""", []),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` and their dependencies."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({VIEWS[n][0].strip()})" for n in order]
    body = expand_wtrim(expand_sround(body.strip()))
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes + [body[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
