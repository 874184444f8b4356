"""Hypnogram analytics: stages as interval rows (rec, annotation, start_us, end_us, duration in seconds)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLEEP = ("N", "N1", "N2", "N3", "REM", "SLP")
def _t():
    return W.partitionBy("rec").orderBy("start_us")



def _seconds(us: Column) -> Column:
    return us / F.lit(1e6)


def data_rate(h: DataFrame) -> DataFrame:
    """(rec, data_rate): scored seconds over the seconds from the first start to the last end."""
    return h.groupBy("rec").agg(F.try_divide(F.sum("duration"), _seconds(F.max_by("end_us", "start_us") - F.min("start_us"))).alias("data_rate"))


def _shifted(h: DataFrame) -> DataFrame:
    h = h.where("annotation not in ('Arrousal', 'Arousal')")
    return h.withColumn("before", F.lag("annotation").over(_t()))


def sleep_onset(h: DataFrame, check_s: float = 3600, awake_s: float = 600) -> DataFrame:
    """(rec, onset_us): the first fall asleep (first row asleep, or asleep after AWAKE) after which rows that start within check_s hold less than awake_s of AWAKE; else the first start."""
    s = _shifted(h).withColumns(_onset_marks(check_s))
    return s.groupBy("rec").agg(_onset(awake_s, lambda c: c).alias("onset_us"))


def _onset_marks(check_s: float) -> dict[str, Column]:
    """Of rows that know what was before: _wake, the seconds of AWAKE in those that start within check_s."""
    ahead = _t().rangeBetween(0, int(check_s * 1e6) - 1)
    return {"_wake": F.coalesce(F.sum(F.when(F.col("annotation") == "AWAKE", F.col("duration"))).over(ahead), F.lit(0.0))}


def _onset(awake_s: float, of: Callable[[Column], Column]) -> Column:
    """The onset of marked rows; of makes an aggregate one of a group or of a window."""
    falls = F.col("annotation").isin(*SLEEP) & (F.col("before").isNull() | (F.col("before") == "AWAKE"))
    return F.coalesce(of(F.min(F.when(falls & (F.col("_wake") < awake_s), F.col("start_us")))), of(F.min("start_us")))


def final_awakening(h: DataFrame, check_s: float = 5400, awake_s: float = 5400, max_sleep_s: float = 10) -> DataFrame:
    """(rec, awakening_us): the first awakening after which the rows that start within check_s hold at least awake_s of AWAKE and at most max_sleep_s of sleep;
    else the start of the last awakening if the last row is AWAKE, else the last end. A first row asleep also stands as a candidate."""
    s = _shifted(h).withColumns(_awakening_marks(check_s))
    return s.groupBy("rec").agg(_awakening(awake_s, max_sleep_s, lambda c: c).alias("awakening_us"))


def _awakening_marks(check_s: float) -> dict[str, Column]:
    """Of rows that know what was before: the seconds of AWAKE and of sleep in those that start within check_s."""
    ahead = _t().rangeBetween(0, int(check_s * 1e6) - 1)
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("duration"))).over(ahead), F.lit(0.0))
    return {"_awake": part(F.col("annotation") == "AWAKE"), "_slept": part(F.col("annotation").isin(*SLEEP))}


def _awakening(awake_s: float, max_sleep_s: float, of: Callable[[Column], Column]) -> Column:
    """The final awakening of marked rows; of makes an aggregate one of a group or of a window."""
    wakes = ((F.col("annotation") == "AWAKE") & F.col("before").isin(*SLEEP)) | (F.col("before").isNull() & F.col("annotation").isin(*SLEEP))
    good = wakes & (F.col("_awake") >= awake_s) & (F.col("_slept") <= max_sleep_s)
    last = F.when(of(F.max_by("annotation", "start_us")) == "AWAKE", of(F.max(F.when(wakes, F.col("start_us"))))).otherwise(of(F.max_by("end_us", "start_us")))
    return F.coalesce(of(F.min(F.when(good, F.col("start_us")))), last)


def is_complete(h: DataFrame) -> DataFrame:
    return h.groupBy("rec").agg(((F.min_by("annotation", "start_us") == "AWAKE") & (F.max_by("annotation", "start_us") == "AWAKE")).alias("complete"))


def rem_latency(h: DataFrame, onset: DataFrame | None = None) -> DataFrame:
    """(rec, from_onset_s, from_awake_s): first REM after the onset, and after the end of the last AWAKE that ends by it."""
    j = h.join(onset if onset is not None else sleep_onset(h), "rec")
    first = j.where("annotation = 'REM' and start_us >= onset_us").groupBy("rec").agg(F.min("start_us").alias("rem_us"))
    j = j.join(first, "rec")
    wake = F.max(F.when((F.col("annotation") == "AWAKE") & (F.col("end_us") <= F.col("rem_us")), F.col("end_us")))
    got = j.groupBy("rec", "onset_us", "rem_us").agg(wake.alias("w"))
    return got.select("rec", _seconds(F.col("rem_us") - F.col("onset_us")).alias("from_onset_s"), _seconds(F.col("rem_us") - F.col("w")).alias("from_awake_s"))


def count_separated(h: DataFrame, tags: tuple[str, ...] = ("REM",), delay_s: float = 1800) -> DataFrame:
    """(rec, n): occurrences that start at least delay_s after the end of the last counted one."""
    got = h.where(F.col("annotation").isin(*tags)).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("start_us", "end_us"))).alias("r"))
    return h.select("rec").distinct().join(got.select("rec", _separated(F.col("r"), delay_s).alias("n")), "rec", "left").select("rec", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _separated(rows: Column, delay_s: float) -> Column:
    """count_separated() of the sorted (start_us, end_us) of a recording."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last"))
    return F.aggregate(rows, start, lambda a, r: F.when(a["last"].isNull() | (r["start_us"] - a["last"] >= int(delay_s * 1e6)), F.struct((a["n"] + 1).alias("n"), r["end_us"].alias("last"))).otherwise(a), lambda a: a["n"])


def awakenings(h: DataFrame) -> DataFrame:
    """(rec, n): a sleep row sets slept, AWAKE sets awake, a row that is neither AWAKE nor N1 clears it; when both are set one is counted and both are cleared."""
    return h.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("start_us", "annotation"))).alias("r")).select("rec", _awakened(F.col("r")).alias("n"))


def _awakened(rows: Column) -> Column:
    """awakenings() of the sorted (start_us, annotation) of a recording."""
    no, yes = F.lit(False), F.lit(True)
    start = F.struct(F.lit(0).cast("long").alias("n"), no.alias("slept"), no.alias("awake"))

    def step(a: Column, r: Column) -> Column:
        slept = a["slept"] | r["annotation"].isin(*SLEEP)
        awake = F.when(r["annotation"] == "AWAKE", yes).when(r["annotation"] != "N1", no).otherwise(a["awake"])
        both = slept & awake
        return F.struct((a["n"] + both.cast("long")).alias("n"), (slept & ~both).alias("slept"), (awake & ~both).alias("awake"))

    return F.aggregate(rows, start, step, lambda a: a["n"])


def stage_times(h: DataFrame, stages: list[str]) -> DataFrame:
    """(rec, one column of seconds for each stage)."""
    return h.groupBy("rec").agg(*[F.coalesce(F.sum(F.when(F.col("annotation") == s, F.col("duration"))), F.lit(0.0)).alias(s) for s in stages])


def merge(h: DataFrame) -> DataFrame:
    """Neighbours of one stage that touch become one row; durations are recomputed."""
    w = _t()
    fresh = ~((F.col("annotation") == F.lag("annotation").over(w)) & (F.col("start_us") == F.lag("end_us").over(w)))
    g = h.withColumn("_g", F.sum(F.coalesce(fresh.cast("long"), F.lit(0).cast("long"))).over(w))
    got = g.groupBy("rec", "annotation", "_g").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return got.select("rec", "annotation", "start_us", "end_us", _seconds(F.col("end_us") - F.col("start_us")).alias("duration"))


def night_score(h: DataFrame, onset_check_s: float = 3600, onset_awake_s: float = 600, wake_check_s: float = 5400, wake_awake_s: float = 5400, wake_sleep_s: float = 10, rem_delay_s: float = 1800) -> DataFrame:
    """One row of scores for each recording: onset, awakening, cycles, awakenings, latencies and stage seconds between them.

    All is made in one pass over the sorted rows of a recording and one group, so a task has few sorts and maps, each of which takes pages of its own."""
    m = merge(h.where("annotation not in ('Arrousal', 'Arousal')")).withColumn("before", F.lag("annotation").over(_t()))
    rec = lambda c: c.over(W.partitionBy("rec"))
    marked = m.withColumns(_onset_marks(onset_check_s) | _awakening_marks(wake_check_s)).withColumns({"onset_us": _onset(onset_awake_s, rec), "awakening_us": _awakening(wake_awake_s, wake_sleep_s, rec)})
    inside = (F.col("start_us") >= F.col("onset_us")) & (F.col("start_us") < F.col("awakening_us"))
    stages = ["AWAKE", "N1", "N2", "N3", "REM"]
    rows = F.collect_list(F.when(inside, F.struct("start_us", "end_us", "annotation")))
    sums = [F.coalesce(F.sum(F.when(inside & (F.col("annotation") == s), F.col("duration"))), F.lit(0.0)).alias(s) for s in stages]
    g = marked.groupBy("rec").agg(F.min("onset_us").alias("onset_us"), F.min("awakening_us").alias("awakening_us"), F.min(F.when(inside & (F.col("annotation") == "REM"), F.col("start_us"))).alias("rem_us"), rows.alias("r"), *sums)
    night = lambda c: F.when(F.size("r") > 0, c)
    rem = F.sort_array(F.transform(F.filter("r", lambda x: x["annotation"] == "REM"), lambda x: F.struct(x["start_us"].alias("start_us"), x["end_us"].alias("end_us"))))
    turns = F.sort_array(F.transform("r", lambda x: F.struct(x["start_us"].alias("start_us"), x["annotation"].alias("annotation"))))
    woke = F.array_max(F.transform(F.filter("r", lambda x: (x["annotation"] == "AWAKE") & (x["end_us"] <= F.col("rem_us"))), lambda x: x["end_us"]))
    return g.select("rec", "onset_us", "awakening_us", night(_separated(rem, rem_delay_s)).alias("rem_cycles"), night(_awakened(turns)).alias("awakenings"), _seconds(F.col("rem_us") - F.col("onset_us")).alias("from_onset_s"), _seconds(F.col("rem_us") - woke).alias("from_awake_s"), *[night(F.col(s)).alias(s) for s in stages])


def transition_counts(h: DataFrame, states: list[str], keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """(keys, from_state, to_state, n): rows in a row, both of the states; zeros included."""
    pairs = h.withColumn("to_state", F.lead("annotation").over(_t())).where(F.col("annotation").isin(states) & F.col("to_state").isin(states))
    n = pairs.groupBy(*keys, F.col("annotation").alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.array(*[F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state")) for a in states for b in states])).alias("s")
    spine = h.select(*keys).distinct().select(*keys, every).select(*keys, "s.*") if keys else h.sparkSession.range(1).select(every).select("s.*")
    return spine.join(n, [*keys, "from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def transition_matrix(counts: DataFrame, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """counts with p, the share of each target of a state; 0 in empty rows."""
    return counts.withColumn("p", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(*keys, "from_state"))), F.lit(0.0)))


def change_matrix(matrix: DataFrame, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """matrix with c: the chance of each target given that the state changes."""
    off = F.when(F.col("from_state") != F.col("to_state"), F.col("p")).otherwise(0.0)
    return matrix.withColumn("c", F.coalesce(F.try_divide(off, F.sum(off).over(W.partitionBy(*keys, "from_state"))), F.lit(0.0)))


def transition_dataset(counts: DataFrame) -> DataFrame:
    """(from_state, to_state, mean, std): over recordings, skipping those whose row is empty; population deviation."""
    p = counts.withColumn("p", F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy("rec", "from_state"))))
    return p.groupBy("from_state", "to_state").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))


def valid_recordings(h: DataFrame, required: dict[str, float]) -> DataFrame:
    """(rec): those with every required stage whose whole duration reaches every threshold."""
    got = h.groupBy("rec").agg(F.sum("duration").alias("d"), F.collect_set("annotation").alias("s"))
    return got.where(F.forall(F.array(*map(F.lit, required)), lambda k: F.array_contains("s", k)) & (F.col("d") >= max(required.values()))).select("rec")


def mode_filter(h: DataFrame, isolated_s: float = 30) -> DataFrame:
    """h with a stage between two of another stage, of just so many seconds, replaced by that."""
    before, after = F.lag("annotation").over(_t()), F.lead("annotation").over(_t())
    return h.withColumn("annotation", F.when((before == after) & (F.col("duration") == isolated_s), before).otherwise(F.col("annotation")))


def _void(h: DataFrame, threshold_s: float) -> DataFrame:
    gap = _seconds(F.col("start_us") - F.lag("end_us").over(_t()))
    h = h.withColumn("_before", F.coalesce(F.lag("annotation").over(_t()), F.lit("AWAKE"))).withColumn("_end", F.lag("end_us").over(_t()))
    return h.withColumn("_hit", F.coalesce((gap > 0) & (gap <= threshold_s), F.lit(False)))


def fill_same(h: DataFrame, threshold_s: float = 300) -> DataFrame:
    """A short gap between rows of one stage is closed by starting the later earlier."""
    v = _void(h, threshold_s)
    hit = F.col("_hit") & (F.col("_before") == F.col("annotation"))
    start = F.when(hit, F.col("_end")).otherwise(F.col("start_us"))
    return v.withColumn("start_us", start).withColumn("duration", F.when(hit, _seconds(F.col("end_us") - F.col("start_us"))).otherwise(F.col("duration"))).select("rec", "annotation", "start_us", "end_us", "duration")


def _insert(h: DataFrame, threshold_s: float, stage: str, rule: Column, intent: bool) -> DataFrame:
    v = _void(h, threshold_s)
    own = F.struct("annotation", "start_us", "end_us", "duration")
    length = _seconds(F.col("start_us") - F.col("_end")) if intent else F.col("duration")
    new = F.struct(F.lit(stage).alias("annotation"), F.col("_end").alias("start_us"), F.col("start_us").alias("end_us"), length.alias("duration"))
    rows = F.when(F.col("_hit") & rule, F.array(new, own)).otherwise(F.array(own))
    return v.select("rec", F.explode(rows).alias("r")).select("rec", "r.*")


def fill_wake_rem(h: DataFrame, threshold_s: float = 300, intent: bool = False) -> DataFrame:
    """AWAKE in short gaps from AWAKE to REM. Inserted rows carry the later row's duration, or the gap's with intent."""
    return _insert(h, threshold_s, "AWAKE", (F.col("_before") == "AWAKE") & (F.col("annotation") == "REM"), intent)


def fill_nonrem(h: DataFrame, threshold_s: float = 300, intent: bool = False) -> DataFrame:
    """N in short gaps between N, N2 and N3."""
    deep = ("N", "N2", "N3")
    return _insert(h, threshold_s, "N", F.col("_before").isin(*deep) & F.col("annotation").isin(*deep), intent)


def fill_sleep(h: DataFrame, threshold_s: float = 300, intent: bool = False) -> DataFrame:
    """SLP in short gaps between rows that aren't AWAKE."""
    return _insert(h, threshold_s, "SLP", (F.col("_before") != "AWAKE") & (F.col("annotation") != "AWAKE"), intent)


def correct_rem(h: DataFrame, threshold_s: float = 300, gap_s: float = 60) -> DataFrame:
    """REM that follows, by a gap of at most gap_s, on AWAKE of at least threshold_s without a break becomes AWAKE, and counts as such for the next row.

    State starts as AWAKE of the threshold; sorted rows of a recording are folded in order."""
    rows = h.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("start_us", "end_us", "annotation", "duration"))).alias("r"))
    kind = "array<struct<start_us:bigint,end_us:bigint,annotation:string,duration:double>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit("AWAKE").alias("s"), F.lit(float(threshold_s)).alias("d"), F.lit(None).cast("long").alias("e"))

    def step(a: Column, r: Column) -> Column:
        close = F.coalesce(_seconds(r["start_us"] - a["e"]), F.lit(0.0)) <= gap_s
        turn = (r["annotation"] == "REM") & (a["s"] == "AWAKE") & (a["d"] >= threshold_s) & close
        stage = F.when(turn, F.lit("AWAKE")).otherwise(r["annotation"])
        d = F.when(stage == "AWAKE", F.when(a["s"] == "AWAKE", a["d"]).otherwise(0.0) + r["duration"]).otherwise(0.0)
        made = F.struct(r["start_us"].alias("start_us"), r["end_us"].alias("end_us"), stage.alias("annotation"), r["duration"].alias("duration"))
        return F.struct(F.concat(a["out"], F.array(made)).alias("out"), stage.alias("s"), d.alias("d"), r["end_us"].alias("e"))

    return rows.select("rec", F.explode(F.aggregate("r", start, step, lambda a: a["out"])).alias("x")).select("rec", "x.annotation", "x.start_us", "x.end_us", "x.duration")


def correct(h: DataFrame, threshold_s: float = 60) -> DataFrame:
    """All corrections in turn."""
    for f in (fill_same, fill_wake_rem, fill_nonrem, fill_sleep):
        h = f(h, threshold_s)
    return correct_rem(h, threshold_s)
