"""Queries on hypnograms made of the event table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.operators import sleep
from neurolake.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tables.STAGES.items()) + " END"
_ALL = f"SELECT user_id AS rec, event_id, {_CASE} AS annotation, epoch_us(ts) AS start_us, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS end_us FROM events"
HY = f"h AS (SELECT *, (end_us - start_us) / 1e6 AS duration FROM ({_ALL}) WHERE end_us IS NOT NULL)"
HG = f"h AS (SELECT *, (end_us - start_us) / 1e6 AS duration FROM ({_ALL}) WHERE end_us IS NOT NULL AND event_id % 7 <> 0)"
ASLEEP = "annotation IN ('N', 'N1', 'N2', 'N3', 'REM', 'SLP')"
STATES = ["AWAKE", "N1", "N2", "N3", "REM"]
# the intervals of the event table are hours long, so limits are in days
DAY = 86_400


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def hy(s, d):
    return tables.hypnogram(tables.read(s, d, "events"))


def hg(s, d):
    return tables.hypnogram(tables.read(s, d, "events"), 7)


@query("hyp_datarate", f"WITH {HG} SELECT rec, round(sum(duration) / ((max(end_us) - min(start_us)) / 1e6), 6) AS data_rate FROM h GROUP BY rec")
def _(s, d):
    return sleep.data_rate(hg(s, d)).withColumn("data_rate", F.round("data_rate", 6))


def _on(h: str) -> str:
    """What lies before and ahead of each row of h, and the onset."""
    return f"""b AS (SELECT *, lag(annotation) OVER (PARTITION BY rec ORDER BY start_us) AS before,
  coalesce(sum(CASE WHEN annotation = 'AWAKE' THEN duration END) OVER v, 0) AS wake, coalesce(sum(CASE WHEN {ASLEEP} THEN duration END) OVER v, 0) AS slept
  FROM {h} WINDOW v AS (PARTITION BY rec ORDER BY start_us RANGE BETWEEN CURRENT ROW AND {2 * DAY * 10**6 - 1} FOLLOWING)),
o AS (SELECT rec, coalesce(min(CASE WHEN {ASLEEP} AND (before IS NULL OR before = 'AWAKE') AND wake < {DAY // 4} THEN start_us END), min(start_us)) AS onset_us FROM b GROUP BY rec)"""


_ON = _on("h")


@query("sleep_onset", f"WITH {HY}, {_ON} SELECT rec, onset_us FROM o")
def _(s, d):
    return sleep.sleep_onset(hy(s, d), 2 * DAY, DAY // 4)


_WAKES = f"((annotation = 'AWAKE' AND before IN ('N', 'N1', 'N2', 'N3', 'REM', 'SLP')) OR (before IS NULL AND {ASLEEP}))"


_OFF = f"SELECT rec, coalesce(min(CASE WHEN {_WAKES} AND wake >= {DAY} AND slept <= {DAY // 2} THEN start_us END), CASE WHEN arg_max(annotation, start_us) = 'AWAKE' THEN max(CASE WHEN {_WAKES} THEN start_us END) ELSE max(end_us) END) AS awakening_us FROM b GROUP BY rec"


@query("final_awakening", f"WITH {HY}, {_ON} {_OFF}")
def _(s, d):
    return sleep.final_awakening(hy(s, d), 2 * DAY, DAY, DAY // 2)


@query("sleep_complete", f"WITH {HY} SELECT rec, arg_min(annotation, start_us) = 'AWAKE' AND arg_max(annotation, start_us) = 'AWAKE' AS complete FROM h GROUP BY rec")
def _(s, d):
    return sleep.is_complete(hy(s, d))


@query(
    "rem_latency",
    f"WITH {HY}, {_ON}, r AS (SELECT rec, onset_us, min(CASE WHEN annotation = 'REM' AND start_us >= onset_us THEN start_us END) AS rem_us FROM h JOIN o USING (rec) GROUP BY rec, onset_us) SELECT rec, round((rem_us - onset_us) / 1e6, 6) AS from_onset_s, round((rem_us - max(CASE WHEN annotation = 'AWAKE' AND end_us <= rem_us THEN end_us END)) / 1e6, 6) AS from_awake_s FROM h JOIN r USING (rec) WHERE rem_us IS NOT NULL GROUP BY rec, onset_us, rem_us",
)
def _(s, d):
    h = hy(s, d)
    return sleep.rem_latency(h, sleep.sleep_onset(h, 2 * DAY, DAY // 4)).select("rec", F.round("from_onset_s", 6).alias("from_onset_s"), F.round("from_awake_s", 6).alias("from_awake_s"))


@query(
    "rem_cycles",
    f"""WITH RECURSIVE {HY}, r AS (SELECT rec, start_us, end_us, row_number() OVER (PARTITION BY rec ORDER BY start_us) AS n FROM h WHERE annotation = 'REM'),
f AS (SELECT rec, n, end_us AS last, CAST(1 AS BIGINT) AS c FROM r WHERE n = 1 UNION ALL
 SELECT r.rec, r.n, CASE WHEN r.start_us - f.last >= {3 * DAY * 10**6} THEN r.end_us ELSE f.last END, CASE WHEN r.start_us - f.last >= {3 * DAY * 10**6} THEN f.c + 1 ELSE f.c END FROM f JOIN r ON r.rec = f.rec AND r.n = f.n + 1)
SELECT a.rec, coalesce(max(f.c), 0) AS n FROM (SELECT DISTINCT rec FROM h) a LEFT JOIN f ON a.rec = f.rec GROUP BY a.rec""",
)
def _(s, d):
    return sleep.count_separated(hy(s, d), ("REM",), 3 * DAY)


@query(
    "awakenings",
    f"""WITH RECURSIVE {HY}, r AS (SELECT rec, annotation, row_number() OVER (PARTITION BY rec ORDER BY start_us) AS n FROM h),
st AS (SELECT rec, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS c, false AS slept, false AS awake FROM r WHERE n = 1 UNION ALL
 SELECT rec, n, c + CASE WHEN sl AND aw THEN 1 ELSE 0 END, sl AND NOT (sl AND aw), aw AND NOT (sl AND aw) FROM (
  SELECT r.rec, r.n, st.c, st.slept OR r.{ASLEEP} AS sl, CASE WHEN r.annotation = 'AWAKE' THEN true WHEN r.annotation <> 'N1' THEN false ELSE st.awake END AS aw FROM st JOIN r ON r.rec = st.rec AND r.n = st.n + 1))
SELECT rec, max(c) AS n FROM st GROUP BY rec""",
)
def _(s, d):
    return sleep.awakenings(hy(s, d))


@query("stage_times", f"WITH {HY} SELECT rec, " + ", ".join(f"round(coalesce(sum(CASE WHEN annotation = '{x}' THEN duration END), 0), 3) AS {x}" for x in STATES) + " FROM h GROUP BY rec")
def _(s, d):
    return sleep.stage_times(hy(s, d), STATES).select("rec", *[F.round(x, 3).alias(x) for x in STATES])


def _numbered(h: str, where: str = "") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start_us) AS n FROM {h} {where}"


_MERGED = "l AS (SELECT *, lag(annotation) OVER w AS pa, lag(end_us) OVER w AS pe FROM h WINDOW w AS (PARTITION BY rec ORDER BY start_us)), g AS (SELECT *, sum(CASE WHEN annotation = pa AND start_us = pe THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY start_us) AS g FROM l), m AS (SELECT rec, annotation, min(start_us) AS start_us, max(end_us) AS end_us, (max(end_us) - min(start_us)) / 1e6 AS duration FROM g GROUP BY rec, annotation, g)"


@query(
    "night_score",
    f"""WITH RECURSIVE {HY}, {_MERGED}, {_on("m")}, off AS ({_OFF}),
nt AS (SELECT m.* FROM m JOIN o USING (rec) JOIN off USING (rec) WHERE start_us >= onset_us AND start_us < awakening_us),
rr AS ({_numbered("nt", "WHERE annotation = 'REM'")}),
rc AS (SELECT rec, n, end_us AS last, CAST(1 AS BIGINT) AS c FROM rr WHERE n = 1 UNION ALL
 SELECT rr.rec, rr.n, CASE WHEN rr.start_us - rc.last >= {3 * DAY * 10**6} THEN rr.end_us ELSE rc.last END, CASE WHEN rr.start_us - rc.last >= {3 * DAY * 10**6} THEN rc.c + 1 ELSE rc.c END FROM rc JOIN rr ON rr.rec = rc.rec AND rr.n = rc.n + 1),
ar AS ({_numbered("nt")}),
aw AS (SELECT rec, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS c, false AS slept, false AS awake FROM ar WHERE n = 1 UNION ALL
 SELECT rec, n, c + CASE WHEN sl AND up THEN 1 ELSE 0 END, sl AND NOT (sl AND up), up AND NOT (sl AND up) FROM (
  SELECT ar.rec, ar.n, aw.c, aw.slept OR ar.{ASLEEP} AS sl, CASE WHEN ar.annotation = 'AWAKE' THEN true WHEN ar.annotation <> 'N1' THEN false ELSE aw.awake END AS up FROM aw JOIN ar ON ar.rec = aw.rec AND ar.n = aw.n + 1)),
fr AS (SELECT rec, min(start_us) AS rem_us FROM nt WHERE annotation = 'REM' GROUP BY rec),
wk AS (SELECT rec, max(CASE WHEN annotation = 'AWAKE' AND end_us <= rem_us THEN end_us END) AS w FROM nt JOIN fr USING (rec) GROUP BY rec),
cy AS (SELECT rec, max(c) AS c FROM rc GROUP BY rec), ac AS (SELECT rec, max(c) AS c FROM aw GROUP BY rec),
sm AS (SELECT rec, {", ".join(f"coalesce(sum(CASE WHEN annotation = '{x}' THEN duration END), 0) AS {x}" for x in STATES)} FROM nt GROUP BY rec)
SELECT o.rec, onset_us, awakening_us, CASE WHEN sm.rec IS NOT NULL THEN coalesce(cy.c, 0) END AS rem_cycles, ac.c AS awakenings, round((rem_us - onset_us) / 1e6, 3) AS from_onset_s, round((rem_us - w) / 1e6, 3) AS from_awake_s,
  {", ".join(f"round({x}, 3) AS {x}" for x in STATES)}
FROM o JOIN off USING (rec) LEFT JOIN sm ON sm.rec = o.rec LEFT JOIN cy ON cy.rec = o.rec LEFT JOIN ac ON ac.rec = o.rec LEFT JOIN fr ON fr.rec = o.rec LEFT JOIN wk ON wk.rec = o.rec""",
)
def _(s, d):
    got = sleep.night_score(hy(s, d), 2 * DAY, DAY // 4, 2 * DAY, DAY, DAY // 2, 3 * DAY)
    return got.withColumns({c: F.round(c, 3) for c in ("from_onset_s", "from_awake_s", *STATES)})


_FULL = "CROSS JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a in STATES for b in STATES) + ") AS q(from_state, to_state)"
_COUNTS = f"""nx AS (SELECT rec, annotation AS from_state, lead(annotation) OVER (PARTITION BY rec ORDER BY start_us) AS to_state FROM h),
tc AS (SELECT r.rec, q.from_state, q.to_state, count(nx.rec) AS n FROM (SELECT DISTINCT rec FROM h) r {_FULL} LEFT JOIN nx ON nx.rec = r.rec AND nx.from_state = q.from_state AND nx.to_state = q.to_state GROUP BY ALL),
tm AS (SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY rec, from_state), 0), 0) AS p FROM tc)"""


def counts(s, d):
    return sleep.transition_counts(hy(s, d), STATES)


@query("transition_counts", f"WITH {HY}, {_COUNTS} SELECT rec, from_state, to_state, n FROM tc")
def _(s, d):
    return counts(s, d)


@query("transition_matrix", f"WITH {HY}, {_COUNTS} SELECT rec, from_state, to_state, n, round(p, 6) AS p FROM tm")
def _(s, d):
    return sleep.transition_matrix(counts(s, d)).withColumn("p", F.round("p", 6))


@query("change_matrix", f"WITH {HY}, {_COUNTS} SELECT rec, from_state, to_state, n, round(p, 6) AS p, round(coalesce(CASE WHEN from_state <> to_state THEN p ELSE 0 END / nullif(sum(CASE WHEN from_state <> to_state THEN p ELSE 0 END) OVER (PARTITION BY rec, from_state), 0), 0), 6) AS c FROM tm")
def _(s, d):
    m = sleep.change_matrix(sleep.transition_matrix(counts(s, d)))
    return m.withColumn("p", F.round("p", 6)).withColumn("c", F.round("c", 6))


@query("transition_dataset", f"WITH {HY}, {_COUNTS}, pp AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY rec, from_state), 0) AS q FROM tc) SELECT from_state, to_state, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std FROM pp GROUP BY from_state, to_state")
def _(s, d):
    m = sleep.transition_dataset(counts(s, d))
    return m.select("from_state", "to_state", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("valid_recordings", f"WITH {HY} SELECT rec FROM h GROUP BY rec HAVING count(DISTINCT CASE WHEN annotation IN ('REM', 'N3') THEN annotation END) = 2 AND sum(duration) >= {28 * DAY}")
def _(s, d):
    return sleep.valid_recordings(hy(s, d), {"REM": 28 * DAY, "N3": 60})


@query("merge_annotations", f"WITH {HY}, l AS (SELECT *, lag(annotation) OVER w AS pa, lag(end_us) OVER w AS pe FROM h WINDOW w AS (PARTITION BY rec ORDER BY start_us)), g AS (SELECT *, sum(CASE WHEN annotation = pa AND start_us = pe THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY start_us) AS g FROM l) SELECT rec, annotation, min(start_us) AS start_us, max(end_us) AS end_us, (max(end_us) - min(start_us)) / 1e6 AS duration FROM g GROUP BY rec, annotation, g")
def _(s, d):
    return sleep.merge(hy(s, d))


@query("mode_filter", f"WITH {HY}, hh AS (SELECT rec, start_us, end_us, annotation, floor(duration / 3600) * 3600 AS duration FROM h) SELECT rec, start_us, CASE WHEN lag(annotation) OVER w = lead(annotation) OVER w AND duration = 3600 THEN lag(annotation) OVER w ELSE annotation END AS annotation FROM hh WINDOW w AS (PARTITION BY rec ORDER BY start_us)")
def _(s, d):
    h = hy(s, d).withColumn("duration", (F.floor(F.col("duration") / 3600) * 3600).cast("double"))
    return sleep.mode_filter(h, 3600).select("rec", "start_us", "annotation")


_V = f"v AS (SELECT *, coalesce(lag(annotation) OVER w, 'AWAKE') AS pa, lag(end_us) OVER w AS pe, coalesce(start_us - lag(end_us) OVER w > 0 AND start_us - lag(end_us) OVER w <= {DAY * 10**6}, false) AS hit FROM h WINDOW w AS (PARTITION BY rec ORDER BY start_us))"


@query("fill_same", f"WITH {HG}, {_V} SELECT rec, annotation, CASE WHEN hit AND pa = annotation THEN pe ELSE start_us END AS start_us, end_us, CASE WHEN hit AND pa = annotation THEN (end_us - pe) / 1e6 ELSE duration END AS duration FROM v")
def _(s, d):
    return sleep.fill_same(hg(s, d), DAY)


def _filled(stage: str, rule: str) -> str:
    return f"WITH {HG}, {_V} SELECT rec, annotation, start_us, end_us, duration FROM v UNION ALL SELECT rec, '{stage}', pe, start_us, duration FROM v WHERE hit AND {rule}"


query("fill_wake_rem", _filled("AWAKE", "pa = 'AWAKE' AND annotation = 'REM'"))(lambda s, d: sleep.fill_wake_rem(hg(s, d), DAY))
query("fill_nrem", _filled("N", "pa IN ('N', 'N2', 'N3') AND annotation IN ('N', 'N2', 'N3')"))(lambda s, d: sleep.fill_nonrem(hg(s, d), DAY))
query("fill_sleep", _filled("SLP", "pa <> 'AWAKE' AND annotation <> 'AWAKE'"))(lambda s, d: sleep.fill_sleep(hg(s, d), DAY))


@query(
    "correct_rem",
    f"""WITH RECURSIVE {HG}, r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start_us) AS n FROM h),
f AS (SELECT rec, CAST(0 AS BIGINT) AS n, 'AWAKE' AS s, CAST({DAY // 4} AS DOUBLE) AS d, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS start_us, CAST(NULL AS DOUBLE) AS duration FROM r WHERE n = 1 UNION ALL
 SELECT rec, n, s2, CASE WHEN s2 = 'AWAKE' THEN CASE WHEN s = 'AWAKE' THEN d ELSE 0 END + duration ELSE 0 END, end_us, start_us, duration FROM (
  SELECT r.rec, r.n, f.s, f.d, r.end_us, r.start_us, r.duration, CASE WHEN r.annotation = 'REM' AND f.s = 'AWAKE' AND f.d >= {DAY // 4} AND coalesce((r.start_us - f.e) / 1e6, 0) <= {DAY // 8} THEN 'AWAKE' ELSE r.annotation END AS s2 FROM f JOIN r ON r.rec = f.rec AND r.n = f.n + 1))
SELECT rec, s AS annotation, start_us, e AS end_us, duration FROM f WHERE n > 0""",
)
def _(s, d):
    return sleep.correct_rem(hg(s, d), DAY // 4, DAY // 8)


def _gaps(h: str) -> str:
    return f"SELECT *, coalesce(lag(annotation) OVER w, 'AWAKE') AS pa, lag(end_us) OVER w AS pe, coalesce(start_us - lag(end_us) OVER w > 0 AND start_us - lag(end_us) OVER w <= {DAY * 10**6}, false) AS hit FROM {h} WINDOW w AS (PARTITION BY rec ORDER BY start_us)"


def _fill(h: str, stage: str, rule: str) -> str:
    return f"SELECT rec, annotation, start_us, end_us, duration FROM ({_gaps(h)}) UNION ALL SELECT rec, '{stage}', pe, start_us, duration FROM ({_gaps(h)}) WHERE hit AND {rule}"


@query(
    "correct_hypnogram",
    f"""WITH RECURSIVE {HG}, h1 AS (SELECT rec, annotation, CASE WHEN hit AND pa = annotation THEN pe ELSE start_us END AS start_us, end_us, CASE WHEN hit AND pa = annotation THEN (end_us - pe) / 1e6 ELSE duration END AS duration FROM ({_gaps("h")})),
h2 AS ({_fill("h1", "AWAKE", "pa = 'AWAKE' AND annotation = 'REM'")}), h3 AS ({_fill("h2", "N", "pa IN ('N', 'N2', 'N3') AND annotation IN ('N', 'N2', 'N3')")}), h4 AS ({_fill("h3", "SLP", "pa <> 'AWAKE' AND annotation <> 'AWAKE'")}),
r AS ({_numbered("h4")}),
f AS (SELECT rec, CAST(0 AS BIGINT) AS n, 'AWAKE' AS s, CAST({DAY} AS DOUBLE) AS d, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS start_us, CAST(NULL AS DOUBLE) AS duration FROM r WHERE n = 1 UNION ALL
 SELECT rec, n, s2, CASE WHEN s2 = 'AWAKE' THEN CASE WHEN s = 'AWAKE' THEN d ELSE 0 END + duration ELSE 0 END, end_us, start_us, duration FROM (
  SELECT r.rec, r.n, f.s, f.d, r.end_us, r.start_us, r.duration, CASE WHEN r.annotation = 'REM' AND f.s = 'AWAKE' AND f.d >= {DAY} AND coalesce((r.start_us - f.e) / 1e6, 0) <= 60 THEN 'AWAKE' ELSE r.annotation END AS s2 FROM f JOIN r ON r.rec = f.rec AND r.n = f.n + 1))
SELECT rec, s AS annotation, start_us, e AS end_us, duration FROM f WHERE n > 0""",
)
def _(s, d):
    return sleep.correct(hg(s, d), DAY)
