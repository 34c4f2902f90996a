"""Registered feature-engineering queries over the fixture click log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mooclens.operators import activity, course as course_ops, leak, scale, sessions, user
from mooclens.operators.logs import build_log
from mooclens.plans import features as feat
from mooclens.plans.oracle import FIXTURE_CTES, rounded, with_ctes
from mooclens.plans.registry import query
from mooclens.sources import fixtures as fx

# courses c0..c7 of the derived log: its events end on 30 January (fixtures.raw_log)
N_COURSES = 8


def fx_log(spark: SparkSession, sf: str, fanout: bool = True) -> DataFrame:
    return build_log(fx.raw_log(spark, sf), fx.enrollment(spark, sf), fx.objects(spark, sf), fanout=fanout)


# ---------------------------------------------------------------- sources

@query("a1_read_log", with_ctes("""
SELECT enrollment_id, username, course_id, CAST(epoch_us(time) AS BIGINT) AS time_us,
       CAST(date AS VARCHAR) AS date, source, event, object, category FROM log"""))
def a1_read_log(spark, sf):
    """Deduplicated log joined with enrollment and objects (fan-out)."""
    log = fx_log(spark, sf)
    return log.select(
        "enrollment_id", "username", "course_id", F.unix_micros("time").alias("time_us"),
        F.col("date").cast("string").alias("date"), "source", "event", "object", "category",
    )


@query("a1_read_log_nofanout", with_ctes("""
SELECT category, count(*) AS n FROM (
  SELECT l.*, o.category FROM (SELECT DISTINCT enrollment_id, time, source, event, object FROM raw_log) l
  LEFT JOIN (SELECT DISTINCT module_id, category FROM objects) o ON l.object = o.module_id) t
GROUP BY category"""))
def a1_read_log_nofanout(spark, sf):
    """A1 with ``fanout=False``: one object row per module."""
    return fx_log(spark, sf, fanout=False).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("a2_object_children", with_ctes("SELECT module_id, course_id, category, children FROM objects"))
def a2_object_children(spark, sf):
    """A2: children split into one row per child."""
    return fx.objects(spark, sf)


@query("a3_enrollment", with_ctes("SELECT enrollment_id, username, course_id FROM enrollment"))
def a3_enrollment(spark, sf):
    return fx.enrollment(spark, sf)


# ---------------------------------------------------------------- sessions

@query("e1_gap_sessions", with_ctes(rounded("SELECT enrollment_id, grp, time FROM sessions",
                                            ["enrollment_id", "grp"], ["time"])))
def e1_gap_sessions(spark, sf):
    """Gap-based sessions per enrollment (reference semantics)."""
    return sessions.gap_sessions(fx_log(spark, sf))


@query("e1_gap_sessions_12h", with_ctes(rounded("""
SELECT enrollment_id, grp, sum(CASE WHEN gap < 43200 THEN gap ELSE 0 END) AS time FROM (
  SELECT enrollment_id, t, gap, CAST(sum(CASE WHEN gap > 43200 THEN 1 ELSE 0 END) OVER (
         PARTITION BY enrollment_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS grp
  FROM gaps WHERE gap IS NOT NULL) g GROUP BY enrollment_id, grp""", ["enrollment_id", "grp"], ["time"])))
def e1_gap_sessions_12h(spark, sf):
    """E1 with a 12-hour interval (both break and non-break gaps occur)."""
    return sessions.gap_sessions(fx_log(spark, sf), interval_minutes=12 * 60)


@query("e2_event_sessions", with_ctes("""
SELECT enrollment_id, session, CAST(epoch_us(min(time)) AS BIGINT) AS start_us,
       CAST(epoch_us(max(time)) + 1800000000 AS BIGINT) AS end_us, count(*) AS n_events FROM (
  SELECT enrollment_id, time, CAST(sum(s) OVER (PARTITION BY enrollment_id ORDER BY t
         RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM (
    SELECT enrollment_id, time, epoch_us(time) AS t,
           CASE WHEN lag(epoch_us(time)) OVER w IS NULL OR epoch_us(time) - lag(epoch_us(time)) OVER w > 1800000000
                THEN 1 ELSE 0 END AS s
    FROM log WINDOW w AS (PARTITION BY enrollment_id ORDER BY time)) a) b
GROUP BY enrollment_id, session"""))
def e2_event_sessions(spark, sf):
    """Conventional sessions (every event counted), session_window semantics."""
    s = sessions.event_sessions(fx_log(spark, sf))
    return s.select(
        "enrollment_id", "session", F.unix_micros("start").alias("start_us"),
        F.unix_micros("end").alias("end_us"), "n_events",
    )


@query("d8_session_features", with_ctes(rounded(
    "SELECT * FROM session_info", ["enrollment_id", "s_n_session", "s_n_small_session", "s_n_mid_session",
                                   "s_n_large_session"], ["s_t_max", "s_t_mean"])))
def d8_session_features(spark, sf):
    return sessions.session_features(sessions.gap_sessions(fx_log(spark, sf)))


# ---------------------------------------------------------------- course / user / leak

COURSE_COLS = [
    "course_id", "start_date", "end_date", "n_enroll", "n_server_navigate", "n_server_access",
    "n_server_problem", "n_server_discussion", "n_server_wiki", "n_browser_access", "n_browser_problem",
    "n_browser_pageclose", "n_browser_video", "n_video", "n_problem", "n_chapter", "n_sequential",
    "s_per_chapter", "v_per_chapter", "p_per_chapter", "v_release_fre",
]


def _course_sql_cols():
    return ", ".join(
        f"CAST({c} AS VARCHAR) AS {c}" if c in ("start_date", "end_date") else c for c in COURSE_COLS
    )


@query("d5_course_info", with_ctes(f"SELECT {_course_sql_cols()} FROM course"))
def d5_course_info(spark, sf):
    c = course_ops.course_info(fx_log(spark, sf))
    return c.select(*[F.col(x).cast("string").alias(x) if x in ("start_date", "end_date") else x
                      for x in COURSE_COLS])


@query("d6_video_detail", with_ctes("""
SELECT course_id, object, CAST(sum(n_users) AS BIGINT) AS n_view, CAST(min(date) AS VARCHAR) AS appear_date FROM (
  SELECT course_id, object, date, count(*) AS n_users FROM (
    SELECT DISTINCT course_id, username, date, object FROM log WHERE event = 'video') v
  GROUP BY 1, 2, 3) d GROUP BY course_id, object"""))
def d6_video_detail(spark, sf):
    summary, _ = course_ops.object_detail(fx_log(spark, sf), "video")
    return summary.select("course_id", "object", "n_view", F.col("appear_date").cast("string").alias("appear_date"))


@query("d6_problem_daily", with_ctes("""
SELECT course_id, object, CAST(date AS VARCHAR) AS date, count(*) AS n_users FROM (
  SELECT DISTINCT course_id, username, date, object FROM log WHERE event = 'problem') v
GROUP BY course_id, object, date"""))
def d6_problem_daily(spark, sf):
    _, daily = course_ops.object_detail(fx_log(spark, sf), "problem")
    return daily.select("course_id", "object", F.col("date").cast("string").alias("date"), "n_users")


@query("d7_user_info", with_ctes(rounded(
    "SELECT * FROM user_info",
    ["username", "u_n_records", "u_n_enroll", "u_online_day", "u_first_day", "u_last_day", "u_duration",
     "u_n_sessions", "u_n_small_session", "u_n_mid_session", "u_n_large_session"],
    ["u_t_max", "u_t_mean"])))
def d7_user_info(spark, sf):
    log = fx_log(spark, sf)
    enr = fx.enrollment(spark, sf)
    s = sessions.sessions_with_user(sessions.gap_sessions(log), enr)
    out = user.user_info(log, s)
    return out.select(
        "username", "u_n_records", "u_n_enroll", "u_online_day",
        *[F.col(c).cast("bigint").alias(c) for c in ("u_first_day", "u_last_day", "u_duration")],
        "u_n_sessions", "u_n_small_session", "u_n_mid_session", "u_n_large_session",
        F.col("u_t_max").cast("double").alias("u_t_max"), F.col("u_t_mean").cast("double").alias("u_t_mean"),
    )


@query("d9_leak_features", with_ctes("SELECT enrollment_id, after_n_records, after_n_days FROM leak"))
def d9_leak_features(spark, sf):
    """C5 + D9: look-ahead activity of the same user after the course ends."""
    log = fx_log(spark, sf)
    return leak.leak_features(log, course_ops.course_info(log))


@query("d10_total_activity", with_ctes("""
SELECT enrollment_id, n_records, CAST(epoch_us(first_t) AS BIGINT) AS first_us,
       CAST(epoch_us(last_t) AS BIGINT) AS last_us, online_day, n_server_navigate, n_server_access,
       n_server_problem, n_server_discussion, n_browser_access, n_browser_problem, n_browser_pageclose,
       n_browser_video, n_video_object, n_problem_object, n_chapter_object, n_sequential_object
FROM activity"""))
def d10_total_activity(spark, sf):
    a = activity.total_activity(fx_log(spark, sf))
    return a.select(
        "enrollment_id", "n_records", F.unix_micros("first_day").alias("first_us"),
        F.unix_micros("last_day").alias("last_us"), *activity.ACTIVITY_FEATURES[3:],
    )


# ---------------------------------------------------------------- flagship

def _h15_sql(full: bool = False, extra: dict[str, str] | None = None) -> str:
    from mooclens.operators.sessions import SESSION_FEATURES
    from mooclens.operators.user import USER_FEATURES

    alias = {c: "a" for c in activity.ACTIVITY_FEATURES}
    alias.update({c: "u" for c in USER_FEATURES})
    alias.update({c: "s" for c in SESSION_FEATURES})
    alias.update({"after_n_records": "k", "after_n_days": "k"})
    raw = {c: f"coalesce(CAST({alias[c] + '.' if c in alias else ''}{c} AS DOUBLE), 0)" for c in feat.FINAL_FEATURES}
    cend = "epoch_us(CAST(c.end_date + INTERVAL 1 DAY AS TIMESTAMP))"
    raw["first_day"] = f"coalesce(CAST(trunc(({cend} - epoch_us(a.first_t)) / 86400000000.0) AS DOUBLE), 0)"
    raw["last_day"] = f"coalesce(CAST(trunc(({cend} - epoch_us(a.last_t)) / 86400000000.0) AS DOUBLE), 0)"
    raw["course_s_access"] = "coalesce(CAST(c.n_server_access AS DOUBLE), 0)"
    raw["course_enroll"] = "coalesce(CAST(c.n_enroll AS DOUBLE), 0)"
    raw["course_n_problem"] = "coalesce(CAST(c.n_problem AS DOUBLE), 0)"
    raw["course_n_chapter"] = "coalesce(CAST(c.n_chapter AS DOUBLE), 0)"
    raw["course_n_sequential"] = "coalesce(CAST(c.n_sequential AS DOUBLE), 0)"
    raw["course_video_release"] = "coalesce(CAST(c.v_release_fre AS DOUBLE), 0)"
    raw["n_records"] = "coalesce(CAST(a.n_records AS DOUBLE), 0)"
    raw["n_server_access"] = "coalesce(CAST(a.n_server_access AS DOUBLE), 0)"
    derived = ["duration", "online_rate", "release_rate", "click_video_rate", "click_problem_rate",
               "click_sequential_rate"] + [r[0] for r in feat.USER_RATES]
    inner_cols = [f"{v} AS {k}" for k, v in raw.items() if k not in derived]
    inner_cols.append("coalesce(CAST(c.n_video AS DOUBLE), 0) AS course_n_video")
    inner = (
        "SELECT e.enrollment_id, " + ", ".join(inner_cols) + """
  FROM enrollment e
  LEFT JOIN activity a ON e.enrollment_id = a.enrollment_id
  LEFT JOIN course c ON e.course_id = c.course_id
  LEFT JOIN user_info u ON e.username = u.username
  LEFT JOIN session_info s ON e.enrollment_id = s.enrollment_id
  LEFT JOIN leak k ON e.enrollment_id = k.enrollment_id"""
    )

    if full:
        inner = inner.replace("LEFT JOIN activity", "FULL JOIN activity")
        for t in ("s", "k"):
            inner = inner.replace(f"ON e.enrollment_id = {t}.", f"ON coalesce(e.enrollment_id, a.enrollment_id) = {t}.")
        inner = inner.replace("SELECT e.enrollment_id,", "SELECT coalesce(e.enrollment_id, a.enrollment_id) AS enrollment_id,")

    def div(a, b):
        return f"CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END"

    mid_cols = [c for c in feat.FINAL_FEATURES if c not in derived] + ["course_n_video"]
    mid = "SELECT enrollment_id, " + ", ".join(mid_cols) + ", first_day - last_day AS duration FROM (" + inner + ") i"
    outer_expr = {c: c for c in feat.FINAL_FEATURES}
    outer_expr["online_rate"] = div("online_day", "duration")
    outer_expr["release_rate"] = div("course_video_release", "course_n_video")
    outer_expr["click_video_rate"] = div("n_video_object", "course_n_video")
    outer_expr["click_problem_rate"] = div("n_problem_object", "course_n_problem")
    outer_expr["click_sequential_rate"] = div("n_sequential_object", "course_n_sequential")
    for name, a, b in feat.USER_RATES:
        outer_expr[name] = div(a, b)
    outer = "SELECT enrollment_id, " + ", ".join(f"{v} AS {k}" for k, v in outer_expr.items()) + \
        " FROM (" + mid + ") m"
    if full:
        outer = "SELECT CASE WHEN enrollment_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, " + outer.removeprefix("SELECT ")
    return with_ctes(rounded(outer, ["split"] * full + ["enrollment_id"], feat.FINAL_FEATURES), extra)


def _uneven() -> dict[str, str]:
    """An enrollment table without course c9, a log without course c0."""
    raw = FIXTURE_CTES["raw_log"]
    return {
        "raw_log": f"SELECT * FROM ({raw}) r WHERE course_id <> 'c0'",
        "enrollment": f"SELECT DISTINCT enrollment_id, username, course_id FROM ({raw}) r WHERE course_id <> 'c9'",
        "object_raw": FIXTURE_CTES["object_raw"].replace("FROM raw_log", f"FROM ({raw}) r"),
    }


@query("g1_two_split_features", _h15_sql(True, _uneven()))
def g1_two_split_features(spark, sf):
    """Features of two splits, tables over both splits' logs;
    enrollments that only the log or only the enrollment table has."""
    enr = fx.enrollment(spark, sf).where("course_id <> 'c9'")
    log = build_log(fx.raw_log(spark, sf).where("course_id <> 'c0'"), enr, fx.objects(spark, sf))
    parts = {"train": F.col("enrollment_id") % 2 == 0, "test": F.col("enrollment_id") % 2 != 0}
    return feat.split_features({name: (log.where(own), enr.where(own)) for name, own in parts.items()})


@query("h15_enrollment_features", _h15_sql())
def h15_enrollment_features(spark, sf):
    """H15 flagship: 56 features per enrollment."""
    log = fx_log(spark, sf)
    return feat.generate_features(log, fx.enrollment(spark, sf))


# ---------------------------------------------------------------- daily grid

def _daily_long_sql() -> str:
    m = activity
    counts = ",\n".join(
        f"         count(*) FILTER (WHERE source = '{s}' AND event = '{e}') AS {n}" for n, s, e in m.DAILY_COUNTS
    )
    return f"""
  SELECT enrollment_id, CAST(day AS INTEGER) AS day, count(*) AS records,
{counts},
         count(DISTINCT CASE WHEN event = 'video' THEN object END) AS video_object,
         count(DISTINCT CASE WHEN event = 'problem' THEN object END) AS pro_object,
         count(DISTINCT CASE WHEN category = 'sequential' THEN object END) AS seq_object
  FROM (SELECT l.*, date_diff('day', c.start_date, l.date) AS day
        FROM log l JOIN course c ON l.course_id = c.course_id) t
  WHERE day >= 0 AND day < 30
  GROUP BY enrollment_id, day"""


DAILY_CTE = {"daily_long": _daily_long_sql()}


@query("d11_daily_long", with_ctes("SELECT * FROM daily_long", DAILY_CTE))
def d11_daily_long(spark, sf):
    log = fx_log(spark, sf)
    return activity.daily_long(log, course_ops.course_info(log))


def _daily_wide_sql() -> str:
    cols = []
    for d in range(activity.N_DAYS):
        for m in activity.DAILY_MEASURES:
            cols.append(f"CAST(coalesce(sum({m}) FILTER (WHERE day = {d}), 0) AS BIGINT) AS {activity.daily_column(d, m)}")
    return with_ctes(
        "SELECT i.enrollment_id, " + ", ".join(cols)
        + " FROM (SELECT DISTINCT enrollment_id FROM log) i LEFT JOIN daily_long d"
        " ON i.enrollment_id = d.enrollment_id GROUP BY i.enrollment_id",
        DAILY_CTE,
    )


@query("d11_daily_wide", _daily_wide_sql())
def d11_daily_wide(spark, sf):
    """390 daily columns per enrollment."""
    log = fx_log(spark, sf)
    return activity.daily_wide(log, course_ops.course_info(log))


def _smooth_sql() -> str:
    cols = [c for c in activity.ACTIVITY_FEATURES if not c.endswith("_day")]
    mean = "list_avg(list_filter([CAST({} AS DOUBLE), {}, {}], lambda x: x IS NOT NULL)) AS {}"
    means = [mean.format(*cols[i : i + 3], cols[i]) for i in range(len(cols) - 2)]
    return with_ctes(rounded(f"SELECT enrollment_id, {', '.join(means)} FROM activity", ["enrollment_id"], cols[:-2]))


@query("e5_smooth_columns", _smooth_sql())
def e5_smooth_columns(spark, sf):
    """E5 on a wide table: each activity count with the two next to it."""
    cols = [c for c in activity.ACTIVITY_FEATURES if not c.endswith("_day")]
    return activity.smooth_columns(activity.total_activity(fx_log(spark, sf)).select("enrollment_id", *cols), cols)


@query("h9_to_one", with_ctes("SELECT enrollment_id, " + ", ".join(
    f"CAST({c} > 0 AS INTEGER) AS {c}" for c in activity.ACTIVITY_FEATURES if c.startswith("n_")) + " FROM activity"))
def h9_to_one(spark, sf):
    """Every activity count as 1 if above 0."""
    cols = [c for c in activity.ACTIVITY_FEATURES if c.startswith("n_")]
    return scale.binarize_columns(activity.total_activity(fx_log(spark, sf)).select("enrollment_id", *cols), cols)


@query("d12_exact_date_enrollment", with_ctes(
    "SELECT enrollment_id, CAST(date AS VARCHAR) AS date, count(*) AS n FROM log GROUP BY 1, 2"))
def d12_exact_date_enrollment(spark, sf):
    out = activity.exact_date_counts(fx_log(spark, sf), "enrollment_id")
    return out.select("enrollment_id", F.col("date").cast("string").alias("date"), "n")


@query("d12_exact_date_user", with_ctes(
    "SELECT username, CAST(date AS VARCHAR) AS date, count(*) AS n FROM log GROUP BY 1, 2"))
def d12_exact_date_user(spark, sf):
    out = activity.exact_date_counts(fx_log(spark, sf), "username")
    return out.select("username", F.col("date").cast("string").alias("date"), "n")


def _daily_area_sql() -> str:
    cols = ", ".join(
        f"coalesce(sum({m} * (2.0 - CASE WHEN day = 0 THEN 1 ELSE 0 END - CASE WHEN day = 29 THEN 1 ELSE 0 END)) / 60.0, 0.0)"
        f" AS {m}_auc" for m in activity.DAILY_MEASURES
    )
    body = f"SELECT e.enrollment_id, {cols} FROM (SELECT DISTINCT enrollment_id FROM log) e LEFT JOIN daily_long d ON d.enrollment_id = e.enrollment_id GROUP BY e.enrollment_id"
    return with_ctes(rounded(body,
                             ["enrollment_id"], [f"{m}_auc" for m in activity.DAILY_MEASURES]), DAILY_CTE)


@query("d14_daily_area", _daily_area_sql())
def d14_daily_area(spark, sf):
    """Trapezoid area of the 30 daily values of each measure."""
    log = fx_log(spark, sf)
    ids = log.select("enrollment_id").distinct()
    return activity.daily_area(activity.daily_long(log, course_ops.course_info(log)), ids)


def _smooth_sql() -> str:
    cols = ", ".join(f"sum({m}) / 3.0 AS {m}" for m in activity.DAILY_MEASURES)
    body = (f"SELECT d.enrollment_id, CAST(c.c AS INTEGER) AS day, {cols} FROM daily_long d "
            "JOIN (SELECT unnest(range(0, 28)) AS c) c ON d.day BETWEEN c.c AND c.c + 2 "
            "GROUP BY d.enrollment_id, c.c")
    return with_ctes(rounded(body, ["enrollment_id", "day"], activity.DAILY_MEASURES), DAILY_CTE)


@query("e5_smooth_daily", _smooth_sql())
def e5_smooth_daily(spark, sf):
    """E5: 3-day moving mean over the 0-filled daily grid (long form)."""
    log = fx_log(spark, sf)
    sm = activity.smooth_daily(activity.daily_long(log, course_ops.course_info(log)), by=3)
    return sm.select("enrollment_id", F.col("day").cast("int").alias("day"), *activity.DAILY_MEASURES)


# ---------------------------------------------------------------- legacy set (D13, D15-D18), A4

@query("a4_coded_log", with_ctes("""
SELECT e.enrollment_id, e.username, e.course_id, (epoch_us(l.time) // 1000000) AS t,
       CAST(list_position(['server', 'browser'], l.source) - 1 AS INTEGER) AS source_idx,
       CAST(list_position(['problem', 'video', 'access', 'wiki', 'discussion', 'nagivate', 'page_close'], l.event) - 1
            AS INTEGER) AS event_idx, l.object
FROM enrollment e LEFT JOIN (SELECT DISTINCT enrollment_id, time, source, event, object FROM raw_log) l
  ON e.enrollment_id = l.enrollment_id"""))
def a4_coded_log(spark, sf):
    from mooclens.operators.logs import LOG_COLUMNS, coded_log
    return coded_log(fx.raw_log(spark, sf).select(*LOG_COLUMNS).distinct(), fx.enrollment(spark, sf))


def _legacy_counts_sql() -> str:
    from mooclens.operators.logs import EVENTS, SOURCES
    cols = ["count(*) AS n_logs", "(max(epoch_us(time) // 1000000) - min(epoch_us(time) // 1000000)) AS span"]
    cols += [f"count(*) FILTER (WHERE source = '{s}') AS src_{s}" for s in SOURCES]
    cols += [f"count(*) FILTER (WHERE event = '{e}') AS evt_{e}" for e in EVENTS]
    cols += [f"count(*) FILTER (WHERE source = '{s}' AND event = '{e}') AS {s}_{e}" for s in SOURCES for e in EVENTS]
    return "SELECT enrollment_id, " + ", ".join(cols) + " FROM log GROUP BY enrollment_id"


@query("d13_legacy_counts", with_ctes(_legacy_counts_sql()))
def d13_legacy_counts(spark, sf):
    from mooclens.operators.legacy import legacy_counts
    return legacy_counts(fx_log(spark, sf))


@query("d15_last_course_time", with_ctes(
    "SELECT course_id, max(epoch_us(time) // 1000000) AS course_last_time FROM log GROUP BY course_id"))
def d15_last_course_time(spark, sf):
    from mooclens.operators.legacy import last_course_time
    return last_course_time(fx_log(spark, sf))


def _legacy_full_sql() -> str:
    onehot = ", ".join(f"CASE WHEN e.course_id = 'c{i}' THEN 1 ELSE 0 END AS course_c{i}" for i in range(N_COURSES))
    return with_ctes(
        f"SELECT c.*, {onehot}, t.course_last_time FROM ({_legacy_counts_sql()}) c "
        "JOIN enrollment e ON c.enrollment_id = e.enrollment_id "
        "LEFT JOIN (SELECT course_id, max(epoch_us(time) // 1000000) AS course_last_time FROM log "
        "GROUP BY course_id) t ON e.course_id = t.course_id"
    )


@query("d18_legacy_features", _legacy_full_sql())
def d18_legacy_features(spark, sf):
    """D18 (with D16 one-hot over the sorted course list)."""
    from mooclens.operators.legacy import build_legacy_features
    return build_legacy_features(fx_log(spark, sf), fx.enrollment(spark, sf))


def _hist_sql() -> str:
    per = """
  SELECT p.enrollment_id, t.label, CAST(max(epoch_us(time) // 1000000) - min(epoch_us(time) // 1000000) AS DOUBLE) AS span,
         CAST(max(epoch_us(time) // 1000000) AS DOUBLE) AS last_t, CAST(count(*) AS DOUBLE) AS n_logs
  FROM log p JOIN truth t ON p.enrollment_id = t.enrollment_id GROUP BY p.enrollment_id, t.label"""
    body = """
SELECT measure, label, bin, n, n / sum(n) OVER (PARTITION BY measure, label) AS frac FROM (
  SELECT measure, label, bin, count(*) AS n FROM (
    SELECT l.measure, l.label,
           CASE WHEN r.hi = r.lo THEN 0 ELSE least(CAST(floor((l.x - r.lo) * (30.0 / (r.hi - r.lo))) AS INTEGER), 29)
           END AS bin
    FROM long_m l JOIN rng r ON l.measure = r.measure WHERE l.x >= r.lo AND l.x <= r.hi) b
  GROUP BY measure, label, bin) c"""
    extra = {
        "per_enr": per,
        "long_m": """
  SELECT label, 'span' AS measure, span AS x FROM per_enr
  UNION ALL SELECT label, 'last_offset', last_t - (SELECT min(last_t) FROM per_enr) FROM per_enr
  UNION ALL SELECT label, 'n_logs', n_logs FROM per_enr""",
        "rng": "SELECT measure, min(x) AS lo, max(x) AS hi FROM long_m WHERE label = 1 GROUP BY measure",
    }
    return with_ctes(rounded(body, ["measure", "label", "bin", "n"], ["frac"]), extra)


@query("d17_class_histograms", _hist_sql())
def d17_class_histograms(spark, sf):
    from mooclens.operators.legacy import class_histograms
    return class_histograms(fx_log(spark, sf), fx.truth(spark, sf))


# ---------------------------------------------------------------- K5 per-course z-score

K5_COLS = ["n_records", "online_day", "n_server_access", "n_browser_video", "n_video_object", "n_problem_object"]


def _k5_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in K5_COLS)
    cols = ", ".join(
        f"CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 0 ELSE (a.{c} - m_{c}) / s_{c} END AS {c}" for c in K5_COLS
    )
    body = (f"SELECT a.enrollment_id, {cols} FROM activity a JOIN enrollment e ON a.enrollment_id = e.enrollment_id "
            f"JOIN (SELECT e.course_id, {stats} FROM activity a JOIN enrollment e "
            "ON a.enrollment_id = e.enrollment_id GROUP BY e.course_id) g ON e.course_id = g.course_id")
    return with_ctes(rounded(body, ["enrollment_id"], K5_COLS))


@query("k5_normalize_by_course", _k5_sql())
def k5_normalize_by_course(spark, sf):
    """K5: per-course z-score of activity columns."""
    from mooclens.operators.scale import normalize_by_group
    act = activity.total_activity(fx_log(spark, sf)).select("enrollment_id", *K5_COLS)
    return normalize_by_group(act, fx.enrollment(spark, sf), K5_COLS)


@query("d16_course_one_hot", with_ctes(
    "SELECT enrollment_id, " + ", ".join(f"CAST(course_id = 'c{i}' AS INTEGER) AS course_c{i}" for i in range(N_COURSES))
    + " FROM enrollment"))
def d16_course_one_hot(spark, sf):
    """One indicator column per course (sorted course list)."""
    from mooclens.operators.legacy import course_one_hot
    return course_one_hot(fx.enrollment(spark, sf))


@query("d16_course_entries", with_ctes(
    "SELECT e.enrollment_id, d.idx, CAST(1 AS DOUBLE) AS value FROM enrollment e JOIN ("
    "SELECT course_id, row_number() OVER (ORDER BY course_id) - 1 AS idx FROM "
    "(SELECT DISTINCT course_id FROM enrollment WHERE course_id IS NOT NULL) c) d ON e.course_id = d.course_id"))
def d16_course_entries(spark, sf):
    """D16 as sparse cells, for any number of courses."""
    from mooclens.operators.legacy import course_entries
    return course_entries(fx.enrollment(spark, sf))


def _legacy_entries_sql() -> str:
    from mooclens.operators.legacy import LEGACY_COUNT_COLUMNS
    first = len(LEGACY_COUNT_COLUMNS)
    extra = {
        "legacy_rows": f"SELECT c.*, e.course_id FROM ({_legacy_counts_sql()}) c "
                       "JOIN enrollment e ON c.enrollment_id = e.enrollment_id",
        "course_facts": "SELECT d.course_id, d.idx, t.last_time FROM (SELECT course_id, "
                        "row_number() OVER (ORDER BY course_id) - 1 AS idx FROM (SELECT DISTINCT course_id FROM enrollment "
                        "WHERE course_id IS NOT NULL) c) d LEFT JOIN (SELECT course_id, max(epoch_us(time) // 1000000) AS last_time "
                        "FROM log GROUP BY course_id) t ON d.course_id = t.course_id",
    }
    cells = [f"SELECT enrollment_id, {i} AS idx, CAST({c} AS DOUBLE) AS value FROM legacy_rows"
             for i, c in enumerate(LEGACY_COUNT_COLUMNS)]
    cells.append(f"SELECT enrollment_id, {first}, CAST(last_time AS DOUBLE) FROM legacy_rows r "
                 "JOIN course_facts f ON r.course_id = f.course_id")
    cells.append(f"SELECT enrollment_id, idx + {first + 1}, CAST(1 AS DOUBLE) FROM legacy_rows r "
                 "JOIN course_facts f ON r.course_id = f.course_id")
    return with_ctes("SELECT enrollment_id, CAST(idx AS BIGINT) AS idx, value FROM (" + " UNION ALL ".join(cells)
                     + ") u WHERE value <> 0", extra)


@query("d18_legacy_entries", _legacy_entries_sql())
def d18_legacy_entries(spark, sf):
    """D18 as sparse cells, for any number of courses."""
    from mooclens.operators.legacy import legacy_entries
    return legacy_entries(fx_log(spark, sf), fx.enrollment(spark, sf))


def _exact_date_wide_sql(key: str) -> str:
    return with_ctes(f"SELECT * FROM (PIVOT (SELECT {key}, CAST(date AS VARCHAR) AS date FROM log) "
                     f"ON date USING count(*) GROUP BY {key})")


@query("d12_exact_date_wide_enrollment", _exact_date_wide_sql("enrollment_id"))
def d12_exact_date_wide_enrollment(spark, sf):
    """A column for each date of the log, by enrollment."""
    log = fx_log(spark, sf)
    return activity.exact_date_wide(log, "enrollment_id", activity.log_dates(log))


@query("d12_exact_date_wide_user", _exact_date_wide_sql("username"))
def d12_exact_date_wide_user(spark, sf):
    """A column for each date of the log, by user."""
    log = fx_log(spark, sf)
    return activity.exact_date_wide(log, "username", activity.log_dates(log))
