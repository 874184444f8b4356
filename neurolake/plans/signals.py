"""Queries on signals: events as one signal per user, embeddings as epochs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.functions import dsp
from neurolake.operators import evoked, quality, spectral, spikes, timefeat, waves
from neurolake.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EV = "ev AS (SELECT user_id AS rec, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"
GAPS = "ev AS (SELECT user_id AS rec, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE WHEN event_id % 10 <> 0 THEN value END AS x FROM events)"
EMB = "ep AS (SELECT vec_id AS rec, label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
BANDS = [(4.0, 10.0), (10.0, 20.0), (8.0, 30.0)]
FS = 64.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def ev(spark: SparkSession, d: str) -> DataFrame:
    return tables.samples(tables.read(spark, d, "events"))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return tables.samples(tables.read(spark, d, "events"), 10)


def ep(spark: SparkSession, d: str) -> DataFrame:
    return tables.epochs(tables.read(spark, d, "embeddings"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _windows(cte: str, n: int, shift: int) -> str:
    return f"""WITH {cte},
s AS (SELECT rec, i, x, lag(x) OVER w AS a, lead(x) OVER w AS b, floor((max(i) OVER (PARTITION BY rec) + 1 - {n}) / {shift}.0) AS k1 FROM ev WINDOW w AS (PARTITION BY rec ORDER BY i)),
p AS (SELECT rec, k, i - k * {shift} AS p, x, abs(x - a) AS inc, x * x - a * b AS psi FROM s, unnest(range(greatest(0, CAST(floor((i - {n}) / {shift}.0) AS BIGINT) + 1), i // {shift} + 1)) AS t(k) WHERE k <= k1)
SELECT rec, CAST(k AS BIGINT) AS k, round(count(x) / {n}.0, 6) AS DATA_RATE, round(sum(CASE WHEN p >= 1 THEN inc END), 6) AS LINE_LENGTH, round(avg(CASE WHEN p BETWEEN 1 AND {n - 2} THEN psi END), 4) AS TKEO_MEAN
FROM p GROUP BY rec, k"""


@query("td_features_tumbling", _windows(EV, 8, 8))
def _(s, d):
    return rounded(rounded(timefeat.windowed(ev(s, d)), "DATA_RATE", "LINE_LENGTH"), "TKEO_MEAN", digits=4)


@query("td_features_sliding", _windows(GAPS, 16, 4))
def _(s, d):
    return rounded(rounded(timefeat.windowed(gaps(s, d), 1.0, 16, 12), "DATA_RATE", "LINE_LENGTH"), "TKEO_MEAN", digits=4)


@query("tkeo_samples", f"WITH {EV} SELECT rec, i, round(x * x - lag(x) OVER w * lead(x) OVER w, 6) AS tkeo FROM ev WINDOW w AS (PARTITION BY rec ORDER BY i)")
def _(s, d):
    return rounded(timefeat.tkeo(ev(s, d)), "tkeo").select("rec", "i", "tkeo")


@query("line_length_samples", f"WITH {GAPS} SELECT rec, i, round(abs(x - lag(x) OVER w), 6) AS line_length FROM ev WINDOW w AS (PARTITION BY rec ORDER BY i)")
def _(s, d):
    return rounded(timefeat.line_length(gaps(s, d)), "line_length").select("rec", "i", "line_length")


@query("datarate_gate", f"WITH {GAPS} SELECT rec, i, CASE WHEN count(x) OVER w * 1.0 / count(*) OVER w > 0.9 THEN x END AS x FROM ev WINDOW w AS (PARTITION BY rec)")
def _(s, d):
    return quality.gate_data_rate(gaps(s, d), 0.9).select("rec", "i", "x")


@query("impute_median", f"WITH {GAPS}, m AS (SELECT rec, median(x) AS m FROM ev GROUP BY rec) SELECT rec, i, round(coalesce(x, m), 6) AS x, x IS NULL AS was_null FROM ev JOIN m USING (rec)")
def _(s, d):
    return rounded(quality.impute_median(gaps(s, d)), "x")


MASK = "mk AS (SELECT rec, i // 8 AS k, max(x) > 150 AS flag FROM ev GROUP BY rec, i // 8)"


def mask(s, d):
    return ev(s, d).groupBy("rec", F.floor(F.col("i") / 8).alias("k")).agg((F.max("x") > 150).alias("flag"))


@query("mask_segments", f"WITH {EV}, {MASK} SELECT rec, i, CASE WHEN NOT (flag AND (k + 1) * 8 <= n) THEN x END AS x FROM (SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM ev) e JOIN mk USING (rec) WHERE mk.k = e.i // 8")
def _(s, d):
    return quality.mask_segments(ev(s, d), mask(s, d), 8)


@query("dilate_mask", f"WITH {EV}, {MASK} SELECT rec, k, CAST(max(flag::INT) OVER (PARTITION BY rec ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS INTEGER) AS flag FROM mk")
def _(s, d):
    return quality.dilate(mask(s, d), 1, 1)


@query("epoch_filter_datarate", f"WITH {GAPS} SELECT rec, i // 8 AS k, round(count(x) / 8.0, 6) AS data_rate FROM ev GROUP BY rec, i // 8 HAVING count(*) = 8 AND count(x) / 8.0 >= 0.85")
def _(s, d):
    return rounded(quality.epoch_rates(gaps(s, d), 8, 0.85), "data_rate")


@query("flat_segments", f"WITH {GAPS}, t AS (SELECT rec, i // 8 AS k, x, abs(x - lag(x) OVER (PARTITION BY rec, i // 8 ORDER BY i)) AS st FROM ev) SELECT rec, k, coalesce(avg(st) < 30 AND count(x) = 8, false) AS flag FROM t GROUP BY rec, k HAVING count(*) = 8")
def _(s, d):
    return quality.flat_segments(gaps(s, d), 8, 30.0)


@query(
    "outlier_segments",
    f"WITH {GAPS}, m AS (SELECT rec, avg(x) AS m, quantile_cont(x, 0.1) AS p1, quantile_cont(x, 0.9) AS p9 FROM ev GROUP BY rec) SELECT rec, i // 8 AS k, coalesce(max(abs(x - m) > abs(p9 - m + 0.5 * (p9 - p1))), false) AS flag FROM ev JOIN m USING (rec) GROUP BY rec, i // 8 HAVING count(*) = 8",
)
def _(s, d):
    return quality.outlier_segments(gaps(s, d), 8, 0.5)


def _psd(x: str = EMB, source: str = "ep") -> str:
    return f"""{x},
w AS (SELECT rec, label, i, (x - avg(x) OVER (PARTITION BY rec)) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS v FROM {source}),
ft AS (SELECT rec, label, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, sum(v * sin(2 * pi() * k * i / 64)) AS im FROM w, unnest(range(0, 33)) AS t(k) GROUP BY rec, label, k),
psd AS (SELECT rec, label, k, k * 1.0 AS f, (re * re + im * im) / (64 * 24.0) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM ft)"""


@query("psd_epochs", f"WITH {_psd()} SELECT rec, CAST(k AS INTEGER) AS k, round(p, 8) AS p FROM psd")
def _(s, d):
    return dsp.with_psd(ep(s, d), FS).select("rec", F.posexplode("psd").alias("k", "p")).select("rec", "k", F.round("p", 8).alias("p"))


def _band(lo: float, hi: float) -> str:
    return f"f BETWEEN {lo} AND {hi}"


def _name(what: str, b: tuple[float, float]) -> str:
    return f"{what}{b[0]:g}_{b[1]:g}Hz"


def _spectral(columns: str) -> str:
    return f"WITH {_psd()} SELECT rec, {columns} FROM psd WHERE k > 0 GROUP BY rec"


def _extract(feature: str, digits: int = 7):
    def run(s, d):
        df = spectral.extract(ep(s, d), FS, 64, BANDS, (feature,))
        return rounded(df, *df.columns[1:], digits=digits)

    return run


def _q(p: str) -> str:
    return f"-sum(CASE WHEN {p} > 0 THEN {p} * ln({p}) ELSE 0 END)"


query("band_power", _spectral(", ".join(f"round(avg(CASE WHEN {_band(*b)} THEN p END), 8) AS {_name('mean_psd_', b)}" for b in BANDS)))(_extract("mean_bands", 8))
query("band_relative", _spectral(", ".join(f"round(sum(CASE WHEN {_band(*b)} THEN p ELSE 0 END) / sum(CASE WHEN {_band(4, 30)} THEN p END), 7) AS {_name('rel_psd_', b)}" for b in BANDS)))(_extract("relative_bands"))
query("freq_mean", _spectral(f"round(sum(CASE WHEN {_band(4, 30)} THEN p * f END) / sum(CASE WHEN {_band(4, 30)} THEN p END), 6) AS mean_frequency"))(_extract("mean_frequency", 6))
query("freq_median", f"WITH {_psd()}, c AS (SELECT rec, f, sum(p) OVER (PARTITION BY rec ORDER BY f) AS c, sum(p) OVER (PARTITION BY rec) AS t FROM psd WHERE {_band(4, 30)}) SELECT rec, min(CASE WHEN c >= 0.5 * t THEN f END)::DOUBLE AS median_frequency FROM c GROUP BY rec")(_extract("median_frequency", 6))
query("entropy_normalised", f"WITH {_psd()}, q AS (SELECT rec, p * p / sum(p * p) OVER (PARTITION BY rec) AS q FROM psd WHERE k > 0) SELECT rec, round({_q('q')}, 6) AS spectral_entropy FROM q GROUP BY rec")(_extract("entropy", 6))
query("entropy_raw", f"WITH {_psd()}, q AS (SELECT rec, p * p AS q FROM psd WHERE k > 0) SELECT rec, round({_q('q')}, 9) AS spectral_entropy_raw FROM q GROUP BY rec")(_extract("entropy_raw", 9))
_BQ = ", ".join(f"sum(CASE WHEN {_band(*b)} THEN p * p ELSE 0 END) OVER (PARTITION BY rec) AS t{i}" for i, b in enumerate(BANDS))
query("entropy_bands", f"WITH {_psd()}, q AS (SELECT rec, f, p * p AS q, {_BQ} FROM psd WHERE k > 0) SELECT rec, " + ", ".join(f"round(-sum(CASE WHEN {_band(*b)} AND q > 0 THEN q / t{i} * ln(q / t{i}) ELSE 0 END), 6) AS {_name('spectral_entropy_', b)}" for i, b in enumerate(BANDS)) + " FROM q GROUP BY rec")(_extract("entropy_bands", 6))
query("entropy_bands_raw", f"WITH {_psd()}, q AS (SELECT rec, f, p * p AS q FROM psd WHERE k > 0) SELECT rec, " + ", ".join(f"round(-sum(CASE WHEN {_band(*b)} AND q > 0 THEN q * ln(q) ELSE 0 END), 9) AS {_name('spectral_entropy_', b)}_raw" for b in BANDS) + " FROM q GROUP BY rec")(_extract("entropy_bands_raw", 9))


@query("hum_segments", f"WITH {_psd()} SELECT rec, max(CASE WHEN f BETWEEN 18 AND 22 THEN p END) / avg(CASE WHEN f BETWEEN 2 AND 40 THEN p END) >= 2 AS flag FROM psd GROUP BY rec")
def _(s, d):
    return quality.powerline_segments(dsp.with_psd(ep(s, d), FS), FS, 64, 20.0, 2.0).select("rec", "flag")


_DIFF = EMB + ", dp AS (SELECT rec, label, i, coalesce(lead(x) OVER w - x, x - lag(x) OVER w) AS x FROM ep WINDOW w AS (PARTITION BY rec ORDER BY i))"


@query("stim_segments", f"WITH {_psd(_DIFF, 'dp')} SELECT rec, round(sum(CASE WHEN f > 10 AND f < 20 THEN p ELSE 0 END), 7) AS power, CAST(sum(CASE WHEN f > 10 AND f < 20 THEN p ELSE 0 END) >= 0.01 AS INTEGER) AS flag FROM psd GROUP BY rec")
def _(s, d):
    return rounded(quality.stim_segments(ep(s, d), FS, 0.01, (10, 20)).select("rec", "power", "flag"), "power", digits=7)


RUNS = """sg AS (SELECT rec, i, x, coalesce(last_value(nullif(sign(x), 0) IGNORE NULLS) OVER (PARTITION BY rec ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(nullif(sign(x), 0) IGNORE NULLS) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)::INT AS sgn FROM ep),
rn AS (SELECT *, CAST(sum(CASE WHEN sgn <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY i) AS BIGINT) AS run FROM (SELECT *, lag(sgn) OVER (PARTITION BY rec ORDER BY i) AS prev FROM sg)),
runs AS (SELECT rec, run, sgn, min(i) AS start, count(*) AS size, arg_min(i, (-sgn * x, i)) AS ext_pos, arg_min(x, (-sgn * x, i)) AS ext_val FROM rn GROUP BY rec, run, sgn)"""
PAIRS = RUNS + f""",
pr AS (SELECT rec, sgn, start AS zero_pos, ext_pos AS min_pos, ext_val AS min_val, lead(ext_pos) OVER w AS max_pos, lead(ext_val) OVER w AS max_val FROM runs WINDOW w AS (PARTITION BY rec ORDER BY run)),
wv AS (SELECT rec, zero_pos, min_pos, min_val, max_pos, max_val, max_val - min_val AS pk2pk, (max_pos - min_pos) / {FS} AS delta_t, (max_val - min_val) / ((max_pos - min_pos) / {FS}) AS upslope, CASE WHEN min_pos > zero_pos THEN -min_val / ((min_pos - zero_pos) / {FS}) END AS downslope FROM pr WHERE sgn < 0 AND max_pos IS NOT NULL AND max_pos - min_pos > 1 AND max_pos - min_pos < 8)"""


def centred(s, d):
    return tables.explode_epochs(ep(s, d))


def pairs(s, d):
    return waves.wave_pairs(centred(s, d), FS, (4.0, 32.0))


@query("wave_runs", f"WITH {EMB}, {RUNS} SELECT rec, run, sgn, start, size, ext_pos, round(ext_val, 6) AS ext_val FROM runs")
def _(s, d):
    return rounded(waves.sign_runs(centred(s, d)), "ext_val")


@query("wave_pairs", f"WITH {EMB}, {PAIRS} SELECT rec, zero_pos, min_pos, max_pos, round(pk2pk, 6) AS pk2pk, round(delta_t, 6) AS delta_t, round(upslope, 5) AS upslope, round(downslope, 5) AS downslope FROM wv")
def _(s, d):
    return rounded(rounded(pairs(s, d), "pk2pk", "delta_t"), "upslope", "downslope", digits=5).select("rec", "zero_pos", "min_pos", "max_pos", "pk2pk", "delta_t", "upslope", "downslope")


@query(
    "wave_window_features",
    f"WITH {EMB}, {PAIRS}, sp AS (SELECT vec_id AS rec, unnest(range(0, 7)) AS k FROM embeddings) SELECT sp.rec, sp.k, round(count(w.min_pos) / 0.25, 6) AS WAVE_RATE, round(avg(pk2pk), 6) AS PK2PK, round(avg(downslope), 5) AS SLOPE, round(avg(delta_t), 6) AS DELTA_T, round(avg(min_val), 6) AS MIN, round(avg(max_val), 6) AS MAX FROM sp LEFT JOIN wv w ON w.rec = sp.rec AND w.min_pos >= sp.k * 8 AND w.min_pos < sp.k * 8 + 16 GROUP BY sp.rec, sp.k",
)
def _(s, d):
    got = waves.window_features(pairs(s, d), ep(s, d).select("rec", F.size("x").alias("n_samples")), 16, 8, FS)
    return rounded(rounded(got, "WAVE_RATE", "PK2PK", "DELTA_T", "MIN", "MAX"), "SLOPE", digits=5)


@query("waves_detected")
def _(s, d):
    return waves.detect_waves(ep(s, d), FS, (4.0, 16.0))


@query("stage_study", None)
def _(s, d):
    return waves.detect_waves(ep(s, d).withColumn("stage", F.col("label") % 5), FS, (4.0, 16.0), keys=("rec", "stage")).groupBy("stage").agg(F.avg("downslope").alias("mean_slope"), F.stddev("downslope").alias("sd_slope"), F.count(F.lit(1)).alias("n"))


@query("spike_block_scale", f"WITH {EV}, c AS (SELECT rec % 10 AS rec, rec AS ch, i, x FROM ev), m AS (SELECT rec, ch, avg(abs(x)) AS m FROM c GROUP BY rec, ch), md AS (SELECT rec, median(m) AS m FROM m GROUP BY rec) SELECT rec, ch, i, round(x * 70 / m, 6) AS x FROM c JOIN md USING (rec)")
def _(s, d):
    return rounded(spikes.block_scale(ev(s, d).select((F.col("rec") % 10).alias("rec"), F.col("rec").alias("ch"), "i", "x")), "x")


CAND = "cd AS (SELECT rec, i, h AS height FROM (SELECT rec, i, abs(x) AS h, lag(abs(x)) OVER t AS a, lead(abs(x)) OVER t AS b, avg(abs(x)) OVER w + 0.5 * stddev_pop(abs(x)) OVER w AS l FROM ev WINDOW w AS (PARTITION BY rec), t AS (PARTITION BY rec ORDER BY i)) WHERE h > a AND h > b AND h >= l)"


@query("spike_candidates", f"WITH {EV}, {CAND} SELECT rec, i, height FROM cd")
def _(s, d):
    return spikes.candidates(ev(s, d), 0.5)


@query("spike_cluster", f"WITH {EV}, {CAND}, g AS (SELECT *, i - lag(i) OVER (PARTITION BY rec ORDER BY i) AS g FROM cd), c AS (SELECT *, sum(CASE WHEN g >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY i) AS c FROM g) SELECT rec, arg_min(i, (-height, i)) AS i, max(height) AS height FROM c GROUP BY rec, c")
def _(s, d):
    return spikes.merge_close(spikes.candidates(ev(s, d), 0.5), 4)


@query(
    "env_window_mle",
    f"WITH {EV}, s AS (SELECT rec, i, x, floor((max(i) OVER (PARTITION BY rec) + 1 - 16) / 4.0) AS k1 FROM ev), p AS (SELECT rec, k, x FROM s, unnest(range(greatest(0, CAST(floor((i - 16) / 4.0) AS BIGINT) + 1), i // 4 + 1)) AS t(k) WHERE k <= k1) SELECT rec, CAST(k AS BIGINT) AS k, round(coalesce(avg(CASE WHEN x > 0 THEN ln(x) END), 0), 6) AS mu, round(coalesce(stddev_pop(CASE WHEN x > 0 THEN ln(x) END), 1), 6) AS sigma FROM p GROUP BY rec, k",
)
def _(s, d):
    return rounded(spikes.window_lognormal(ev(s, d), 16, 4), "mu", "sigma")


@query(
    "closing_union",
    f"WITH {EV}, a AS (SELECT rec, i, x, max(CASE WHEN x > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS d FROM ev), b AS (SELECT *, min(d) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c FROM a), e AS (SELECT *, lag(c) OVER (PARTITION BY rec ORDER BY i) AS pc FROM b), g AS (SELECT *, sum(CASE WHEN c <> pc THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY i) AS g FROM e) SELECT rec, arg_min(i, (-x, i)) AS i, max(x) AS x FROM g WHERE c = 1 GROUP BY rec, g",
)
def _(s, d):
    return spikes.closing_union(ev(s, d).select("rec", "i", "x", F.when(F.col("x") > 150, 1).otherwise(0).alias("flag")), 2)


@query(
    "discharge_groups",
    f"WITH {EV}, v AS (SELECT rec % 10 AS rec, rec AS chan, epoch_us(ts) // 1000000 AS pos, x AS weight FROM ev), f AS (SELECT *, max(pos + 600) OVER (PARTITION BY rec ORDER BY pos, chan ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM v), g AS (SELECT *, sum(CASE WHEN r IS NULL OR pos > r THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY pos, chan ROWS UNBOUNDED PRECEDING) - 1 AS event_id FROM f) SELECT rec, CAST(event_id AS BIGINT) AS event_id, min(pos) AS start, count(DISTINCT chan) AS n_channels, count(*) AS n_events, max(weight) AS weight FROM g GROUP BY rec, event_id",
)
def _(s, d):
    e = ev(s, d).select((F.col("rec") % 10).alias("rec"), F.col("rec").alias("chan"), F.floor(tables.micros("ts") / 1000000).alias("pos"), F.col("x").alias("weight"))
    return spikes.group_discharges(e, 600)


@query("spikes_halfwave")
def _(s, d):
    return spikes.halfwave(ev(s, d).select((F.col("rec") % 10).alias("rec"), F.col("rec").cast("int").alias("ch"), "i", "x"), 512.0, total_amp=50.0, slope=500.0, duration=0.0005, coeff=1.0)


@query("spikes_envelope")
def _(s, d):
    return spikes.envelope(ev(s, d).select("rec", F.lit(0).alias("ch"), "i", "x"), 200.0, core_s=1.0, window=0.1, step=0.05, k1=1.0)


@query("envelope_discharges")
def _(s, d):
    e = spikes.envelope(ev(s, d).select((F.col("rec") % 10).alias("rec"), F.col("rec").cast("int").alias("ch"), "i", "x"), 200.0, core_s=1.0, window=0.1, step=0.05, k1=0.6, k2=0.8)
    return spikes.discharges(e, 0.005)


@query("notch_filtered")
def _(s, d):
    return quality.filter_powerline(gaps(s, d), 256.0)


TR = "tr AS (SELECT label AS session, rec AS trial, i, x AS v FROM ep)"
PJ = "pj AS (SELECT a.session, a.trial AS a, b.trial AS b, sum(a.v * b.v) / CASE WHEN sum(a.v * a.v) = 0 THEN 1 ELSE sqrt(sum(a.v * a.v)) END AS s FROM tr a JOIN tr b ON a.session = b.session AND a.i = b.i AND a.trial <> b.trial GROUP BY ALL)"
SEL = """ids AS (SELECT session, trial, row_number() OVER (PARTITION BY session ORDER BY trial) - 1 AS r, count(*) OVER (PARTITION BY session) AS k FROM (SELECT DISTINCT session, trial FROM tr)),
dd AS (SELECT pj.*, x.r AS ra, y.r AS rb, x.k, (y.r - x.r + x.k) % x.k AS d FROM pj JOIN ids x ON x.session = pj.session AND x.trial = a JOIN ids y ON y.session = pj.session AND y.trial = b),
sl AS (SELECT session, a, b, s FROM dd WHERE 2 * d < k OR (2 * d = k AND ((least(ra, rb) % 2 = 0) = (ra < rb))))"""
ST = "st AS (SELECT session, trial, avg(s) AS stat FROM (SELECT session, a AS trial, s FROM sl UNION ALL SELECT session, b, s FROM sl) GROUP BY session, trial)"


def trials(s, d):
    """The embeddings of a label are a session's trials."""
    return tables.explode_epochs(ep(s, d)).select(F.col("label").alias("session"), F.col("rec").alias("trial"), "i", F.col("x").alias("v"))


def whole_trials(s, d):
    """trials() with a row for each trial."""
    return ep(s, d).select(F.col("label").alias("session"), F.col("rec").alias("trial"), F.col("x").alias("v"))


@query("crp_projections", f"WITH {EMB}, {TR}, {PJ} SELECT session, a, b, round(s, 7) AS s FROM pj")
def _(s, d):
    return rounded(evoked.projections(whole_trials(s, d)), "s", digits=7)


_PROFILE = """pf AS (SELECT session, length, avg(s) AS mean, var_pop(s) AS var FROM (
  SELECT a.session, a.trial AS a, b.trial AS b, n AS length, sum(a.v * b.v) / CASE WHEN sum(a.v * a.v) = 0 THEN 1 ELSE sqrt(sum(a.v * a.v)) END / 8.0 AS s
  FROM tr a JOIN tr b ON a.session = b.session AND a.i = b.i AND a.trial <> b.trial, unnest(range(10, 64, 5)) AS t(n) WHERE a.i < n GROUP BY ALL) GROUP BY session, length)"""


@query("crp_profile", f"WITH {EMB}, {TR}, {_PROFILE} SELECT session, CAST(length AS BIGINT) AS length, round(mean, 7) AS mean, round(var, 8) AS var FROM pf")
def _(s, d):
    return rounded(rounded(evoked.profile(whole_trials(s, d), FS, 64), "mean", digits=7), "var", digits=8)


@query("crp_duration", f"WITH {EMB}, {TR}, {_PROFILE} SELECT session, CAST(arg_min(length, (-round(mean, 9), length)) AS BIGINT) AS length FROM pf GROUP BY session")
def _(s, d):
    return evoked.duration(evoked.profile(whole_trials(s, d), FS, 64))


@query("crp_pair_selection", f"WITH {EMB}, {TR}, {PJ}, {SEL} SELECT session, a, b, round(s, 7) AS s FROM sl")
def _(s, d):
    return rounded(evoked.select_pairs(whole_trials(s, d)), "s", digits=7)


@query("crp_trial_stat", f"WITH {EMB}, {TR}, {PJ}, {SEL}, {ST} SELECT session, trial, round(stat, 7) AS stat FROM st")
def _(s, d):
    return rounded(evoked.trial_statistic(whole_trials(s, d)), "stat", digits=7)


@query("crp_reject", f"WITH {EMB}, {TR}, {PJ}, {SEL}, {ST}, md AS (SELECT session, median(stat) AS m, stddev_pop(stat) AS sd, count(*) AS n FROM st GROUP BY session), mad AS (SELECT session, 1.4826 * median(abs(stat - m)) AS d FROM st JOIN md USING (session) GROUP BY session) SELECT session, trial, round(stat, 7) AS stat, n >= 3 AND abs(stat - m) > 2 * CASE WHEN d > 0 THEN d ELSE sd END AS rejected FROM st JOIN md USING (session) JOIN mad USING (session)")
def _(s, d):
    return rounded(evoked.reject(evoked.trial_statistic(whole_trials(s, d)), 2.0), "stat", digits=7)


@query("crp_full")
def _(s, d):
    return evoked.crp(whole_trials(s, d), FS)


@query("crp_traces", f"WITH {EMB}, {TR} SELECT session, i, round(avg(v), 7) AS average, round(stddev_pop(v), 7) AS deviation FROM tr GROUP BY session, i")
def _(s, d):
    return rounded(evoked.traces(trials(s, d)), "average", "deviation", digits=7)


@query("crp_responses")
def _(s, d):
    return evoked.responses(whole_trials(s, d), FS)


@query("spectral_prefiltered")
def _(s, d):
    return spectral.extract(ep(s, d), FS, 64, [(4.0, 10.0), (10.0, 16.0)], ("mean_bands", "relative_bands", "entropy_raw"), [(11.0, 13.0)], prefilter=True, stimulation=7, datarate=True, pad=True)


@query("half_rate")
def _(s, d):
    return quality.halve_rate(gaps(s, d), 500.0)
