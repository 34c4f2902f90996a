"""DuckDB SQL used as the correctness oracle for the Spark queries.

Each statement is self-contained: it starts with the fixture CTEs (the same
rows as ``mooclens.sources.fixtures``) over the pre-registered parquet
views, followed by an independent SQL formulation of the operator.
Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

FIXTURE_CTES = {
    "raw_log": """
  SELECT event_id, user_id * 10 + course AS enrollment_id, user_id AS username,
         'c' || CAST(course AS VARCHAR) AS course_id, CAST(ts AS TIMESTAMP) AS time, CAST(ts AS DATE) AS date,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'browser' ELSE 'server' END AS source,
         CASE event_type WHEN 'view' THEN 'video' WHEN 'click' THEN 'problem' WHEN 'purchase' THEN 'access'
              WHEN 'signup' THEN 'nagivate' ELSE 'discussion' END AS event,
         'o' || CAST(k AS VARCHAR) AS object, k
  FROM (SELECT *, greatest(k % 5, least(9, greatest(0, CAST(floor(datediff('day', DATE '2024-01-11', CAST(ts AS DATE)) / 3.0) AS BIGINT) + 1))) AS course
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) f) e""",
    "enrollment": """
  SELECT DISTINCT enrollment_id, username, course_id FROM raw_log""",
    "object_raw": """
  SELECT 'o' || CAST(k AS VARCHAR) AS module_id, 'c' || CAST(k % 5 AS VARCHAR) AS course_id,
         CASE k % 4 WHEN 0 THEN 'chapter' WHEN 1 THEN 'sequential' WHEN 2 THEN 'video' ELSE 'problem' END AS category,
         CASE k % 4 WHEN 0 THEN 'o' || CAST(k + 1 AS VARCHAR) || ' o' || CAST(k + 2 AS VARCHAR) || ' ' ELSE '' END AS children
  FROM (SELECT DISTINCT k FROM raw_log) t""",
    "objects": """
  SELECT DISTINCT module_id, course_id, category, child AS children FROM (
    SELECT module_id, course_id, category,
           unnest(CASE WHEN children = '' THEN [''] ELSE
                  list_slice(string_split(children, ' '), 1, len(string_split(children, ' ')) - 1) END) AS child
    FROM object_raw) t""",
    "log": """
  SELECT l.enrollment_id, e.username, e.course_id, l.time, CAST(l.time AS DATE) AS date,
         l.source, l.event, l.object, o.category
  FROM (SELECT DISTINCT enrollment_id, time, source, event, object FROM raw_log) l
  LEFT JOIN enrollment e ON l.enrollment_id = e.enrollment_id
  LEFT JOIN objects o ON l.object = o.module_id""",
    "truth": """
  SELECT enrollment_id, CASE WHEN enrollment_id % 3 = 0 THEN 1 ELSE 0 END AS label FROM enrollment""",
    "scores": """
  SELECT vec_id AS enrollment_id, CAST(i - 1 AS INTEGER) AS model, CAST(embedding[i] AS DOUBLE) AS score,
         CASE WHEN vec_id % 5 < 2 THEN 'blend' WHEN vec_id % 5 = 2 THEN 'val' ELSE 'test' END AS split,
         CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label
  FROM (SELECT vec_id, embedding, label, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) t""",
    "lines": """
  SELECT l_orderkey AS qid, CAST(row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INTEGER) AS row_id,
         l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""",
    "ranking": """
  SELECT qid, row_id, CAST(floor(l_quantity / 10) AS INTEGER) AS label, l_extendedprice AS score FROM lines""",
    "sparse": """
  SELECT qid, row_id, idx, value FROM (
    SELECT qid, row_id, 1 AS idx, l_quantity AS value FROM lines
    UNION ALL SELECT qid, row_id, 2, l_discount FROM lines
    UNION ALL SELECT qid, row_id, 3, l_tax FROM lines) t WHERE value <> 0""",
}

# Derived CTEs shared by several oracles (feature tables on the fixture log).
SHARED_CTES = {
    "course_base": """
  SELECT course_id, min(date) AS start_date, max(date) AS end_date,
         count(DISTINCT username) AS n_enroll,
         count(*) FILTER (WHERE source = 'server' AND event = 'nagivate') AS n_server_navigate,
         count(*) FILTER (WHERE source = 'server' AND event = 'access') AS n_server_access,
         count(*) FILTER (WHERE source = 'server' AND event = 'problem') AS n_server_problem,
         count(*) FILTER (WHERE source = 'server' AND event = 'discussion') AS n_server_discussion,
         count(*) FILTER (WHERE source = 'server' AND event = 'wiki') AS n_server_wiki,
         count(*) FILTER (WHERE source = 'browser' AND event = 'access') AS n_browser_access,
         count(*) FILTER (WHERE source = 'browser' AND event = 'problem') AS n_browser_problem,
         count(*) FILTER (WHERE source = 'browser' AND event = 'page_close') AS n_browser_pageclose,
         count(*) FILTER (WHERE source = 'browser' AND event = 'video') AS n_browser_video,
         count(DISTINCT CASE WHEN event = 'video' THEN object END) AS n_video,
         count(DISTINCT CASE WHEN event = 'problem' THEN object END) AS n_problem,
         count(DISTINCT CASE WHEN category = 'chapter' THEN object END) AS n_chapter,
         count(DISTINCT CASE WHEN category = 'sequential' THEN object END) AS n_sequential
  FROM log GROUP BY course_id""",
    "course_release": """
  SELECT course_id, count(DISTINCT first_date) AS v_release_fre
  FROM (SELECT course_id, object, min(date) AS first_date FROM log WHERE event = 'video' GROUP BY 1, 2) t
  GROUP BY course_id""",
    "course": """
  SELECT b.*,
         CASE WHEN n_chapter > 0 THEN CAST(floor(n_sequential / n_chapter) AS BIGINT) END AS s_per_chapter,
         CASE WHEN n_chapter > 0 THEN CAST(floor(n_video / n_chapter) AS BIGINT) END AS v_per_chapter,
         CASE WHEN n_chapter > 0 THEN CAST(floor(n_problem / n_chapter) AS BIGINT) END AS p_per_chapter,
         CAST(coalesce(r.v_release_fre, 0) AS BIGINT) AS v_release_fre
  FROM course_base b LEFT JOIN course_release r ON b.course_id = r.course_id""",
    "gaps": """
  SELECT enrollment_id, t, (t - lag(t) OVER (PARTITION BY enrollment_id ORDER BY t)) / 1000000.0 AS gap
  FROM (SELECT enrollment_id, epoch_us(time) AS t FROM log) e""",
    "gap_groups": """
  SELECT enrollment_id, t, gap,
         CAST(sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY enrollment_id ORDER BY t
             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS grp
  FROM gaps WHERE gap IS NOT NULL""",
    "sessions": """
  SELECT enrollment_id, grp, sum(CASE WHEN gap < 1800 THEN gap ELSE 0 END) AS time
  FROM gap_groups GROUP BY enrollment_id, grp""",
    "session_info": """
  SELECT enrollment_id, count(*) AS s_n_session, max(time) AS s_t_max,
         CAST(sum(CASE WHEN time <> 0 THEN CAST(round(time * 1000000) AS BIGINT) END) AS DOUBLE)
             / (count(*) FILTER (WHERE time <> 0) * 1e6) AS s_t_mean,
         count(*) FILTER (WHERE time < 600) AS s_n_small_session,
         count(*) FILTER (WHERE time > 600 AND time < 1800) AS s_n_mid_session,
         count(*) FILTER (WHERE time > 1800) AS s_n_large_session
  FROM sessions GROUP BY enrollment_id""",
    "user_base": """
  SELECT username, count(*) AS u_n_records, count(DISTINCT enrollment_id) AS u_n_enroll,
         count(DISTINCT date) AS u_online_day, min(date) AS first_date, max(date) AS last_date
  FROM log GROUP BY username""",
    "user_sessions": """
  SELECT e.username, count(*) AS u_n_sessions, max(time) AS u_t_max,
         CAST(sum(CASE WHEN time <> 0 THEN CAST(round(time * 1000000) AS BIGINT) END) AS DOUBLE)
             / (count(*) FILTER (WHERE time <> 0) * 1e6) AS u_t_mean,
         count(*) FILTER (WHERE time < 600) AS u_n_small_session,
         count(*) FILTER (WHERE time > 600 AND time < 1800) AS u_n_mid_session,
         count(*) FILTER (WHERE time > 1800) AS u_n_large_session
  FROM sessions s JOIN enrollment e ON s.enrollment_id = e.enrollment_id GROUP BY e.username""",
    "user_info": """
  SELECT b.username, u_n_records, u_n_enroll, u_online_day,
         date_diff('day', (SELECT min(first_date) FROM user_base), first_date) AS u_first_day,
         date_diff('day', (SELECT min(first_date) FROM user_base), last_date) AS u_last_day,
         date_diff('day', first_date, last_date) AS u_duration,
         coalesce(u_n_sessions, 0) AS u_n_sessions, coalesce(u_t_max, 0) AS u_t_max,
         coalesce(u_t_mean, 0) AS u_t_mean, coalesce(u_n_small_session, 0) AS u_n_small_session,
         coalesce(u_n_mid_session, 0) AS u_n_mid_session, coalesce(u_n_large_session, 0) AS u_n_large_session
  FROM user_base b LEFT JOIN user_sessions s ON b.username = s.username""",
    "leak": """
  SELECT r.enrollment_id, count(l.time) AS after_n_records, count(DISTINCT l.date) AS after_n_days
  FROM (SELECT DISTINCT enrollment_id, username, course_id FROM log) r
  JOIN (SELECT course_id, CAST(end_date + INTERVAL 1 DAY AS TIMESTAMP) AS c_end FROM course) c
    ON r.course_id = c.course_id
  LEFT JOIN log l ON l.username = r.username AND l.time > c.c_end AND l.time < c.c_end + INTERVAL 10 DAY
  GROUP BY r.enrollment_id""",
    "activity": """
  SELECT enrollment_id, count(*) AS n_records, min(time) AS first_t, max(time) AS last_t,
         count(DISTINCT date) AS online_day,
         count(*) FILTER (WHERE source = 'server' AND event = 'nagivate') AS n_server_navigate,
         count(*) FILTER (WHERE source = 'server' AND event = 'access') AS n_server_access,
         count(*) FILTER (WHERE source = 'server' AND event = 'problem') AS n_server_problem,
         count(*) FILTER (WHERE source = 'server' AND event = 'discussion') AS n_server_discussion,
         count(*) FILTER (WHERE source = 'browser' AND event = 'access') AS n_browser_access,
         count(*) FILTER (WHERE source = 'browser' AND event = 'problem') AS n_browser_problem,
         count(*) FILTER (WHERE source = 'browser' AND event = 'page_close') AS n_browser_pageclose,
         count(*) FILTER (WHERE source = 'browser' AND event = 'video') AS n_browser_video,
         count(DISTINCT CASE WHEN event = 'video' THEN object END) AS n_video_object,
         count(DISTINCT CASE WHEN event = 'problem' THEN object END) AS n_problem_object,
         count(DISTINCT CASE WHEN category = 'chapter' THEN object END) AS n_chapter_object,
         count(DISTINCT CASE WHEN category = 'sequential' THEN object END) AS n_sequential_object
  FROM log GROUP BY enrollment_id""",
}

ALL_CTES = {**FIXTURE_CTES, **SHARED_CTES}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with every fixture/shared CTE (plus ``extra``)."""
    ctes = dict(ALL_CTES)
    if extra:
        ctes.update(extra)
    parts = [f"{name} AS ({sql}\n)" for name, sql in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def rounded(select_from: str, keys: list[str], doubles: list[str], others: list[str] | None = None) -> str:
    """Outer SELECT rounding the double columns to 6 decimals."""
    cols = list(keys) + list(others or [])
    cols += [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles]
    return f"SELECT {', '.join(cols)} FROM ({select_from}) q"
