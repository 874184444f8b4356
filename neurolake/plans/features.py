"""Queries on feature matrices, scores and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurolake.operators import classifiers, features, staging, training
from neurolake.plans import sleeping
from neurolake.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def li(s: SparkSession, d: str) -> DataFrame:
    return tables.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", *COLS)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _z(by: str) -> str:
    over = f"OVER ({by})"
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) {over}) / nullif(stddev_pop({c}) {over}, 0), 6) AS {c}" for c in COLS) + " FROM lineitem"


@query("zscore", _z(""))
def _(s, d):
    return rounded(features.zscore(li(s, d), COLS), *COLS).select("l_orderkey", "l_linenumber", *COLS)


@query("zscore_by_class", _z("PARTITION BY l_returnflag"))
def _(s, d):
    return rounded(features.zscore(li(s, d), COLS, "l_returnflag"), *COLS).select("l_orderkey", "l_linenumber", *COLS)


@query("zscore_running", "WITH a AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS l_quantity FROM lineitem, a WHERE l_linenumber > 3")
def _(s, d):
    z = features.RunningZScore(["l_quantity"])
    z.update(li(s, d).where("l_linenumber <= 3"))
    return rounded(z.update(li(s, d).where("l_linenumber > 3")), "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity")


_TRAINED = "m AS (SELECT l_returnflag AS k, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)"


@query("zscore_trained", f"WITH {_TRAINED} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round((l_quantity - (SELECT m FROM m WHERE k = '{k}')) / (SELECT s FROM m WHERE k = '{k}'), 6) AS l_quantity_{k}" for k in "ANR") + " FROM lineitem WHERE l_linenumber > 3")
def _(s, d):
    z = features.ZScore(["l_quantity"], "l_returnflag").fit(li(s, d).where("l_linenumber <= 3"))
    names = [f"l_quantity_{k}" for k in "ANR"]
    return rounded(z.transform(li(s, d).where("l_linenumber > 3")), *names).select("l_orderkey", "l_linenumber", *names)


@query("relabelled", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'R') THEN 'X' ELSE l_returnflag END AS l_returnflag, l_quantity FROM lineitem WHERE l_discount <= 0.05")
def _(s, d):
    df = features.remove_samples(features.remove_features(li(s, d), ["l_extendedprice"]), F.col("l_discount") > 0.05)
    return features.replace_labels(df, "l_returnflag", ["A", "R"], "X").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@query("log_features", "SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS ln_l_extendedprice, round(log10(nullif(l_discount, 0)), 6) AS log10_l_discount FROM lineitem")
def _(s, d):
    df = features.augment(features.augment(li(s, d), ["l_extendedprice"], "ln"), ["l_discount"], "log10")
    return rounded(df, "ln_l_extendedprice", "log10_l_discount").select("l_orderkey", "l_linenumber", "ln_l_extendedprice", "log10_l_discount")


_PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1 :]]


@query("augment_ratio", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({a} / nullif({b}, 0), 6) AS {a}_over_{b}, round({a} * {b}, 4) AS {a}_times_{b}" for a, b in _PAIRS) + " FROM lineitem")
def _(s, d):
    df = features.pairwise_augment(li(s, d), COLS)
    over, times = [f"{a}_over_{b}" for a, b in _PAIRS], [f"{a}_times_{b}" for a, b in _PAIRS]
    return rounded(rounded(df, *over), *times, digits=4).select("l_orderkey", "l_linenumber", *over, *times)


@query(
    "balance_classes",
    "WITH n AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT max(n) AS m FROM n), r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS r FROM lineitem) SELECT l_orderkey, l_linenumber, l_returnflag, unnest(range(0, CAST((m - n) // n + CASE WHEN r < (m - n) % n THEN 1 ELSE 0 END AS BIGINT) + 1)) AS copy FROM r JOIN n USING (l_returnflag), m",
)
def _(s, d):
    return features.balance(li(s, d), "l_returnflag", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_returnflag", "copy")


@query("class_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    return features.class_counts(li(s, d), "l_returnflag")


def emb4(s: SparkSession, d: str) -> DataFrame:
    return tables.epochs(tables.read(s, d, "embeddings")).select("rec", "label", *[F.col("x")[i].alias(f"x{i}") for i in range(4)])


@query(
    "category_outliers",
    """WITH v AS (SELECT vec_id AS rec, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
z AS (SELECT rec, label, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM v),
n AS (SELECT p.label, p.rec AS a, q.rec AS b, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) AS d FROM z p JOIN z q ON p.label = q.label AND p.rec <> q.rec),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY d, b) AS r FROM n) WHERE r <= 20),
kd AS (SELECT label, a, max(d) AS kd FROM k GROUP BY label, a),
rc AS (SELECT k.label, k.a, k.b, greatest(k.d, kd.kd) AS reach FROM k JOIN kd ON kd.label = k.label AND kd.a = k.b),
lr AS (SELECT label, a, 1 / (avg(reach) + 1e-10) AS lrd FROM rc GROUP BY label, a),
lf AS (SELECT rc.label, rc.a, avg(y.lrd) AS m FROM rc JOIN lr y ON y.label = rc.label AND y.a = rc.b GROUP BY rc.label, rc.a)
SELECT lf.a AS rec, lf.label, round(m / lrd, 6) AS lof, m / lrd > 1.5 AS outlier FROM lf JOIN lr ON lr.label = lf.label AND lr.a = lf.a""",
)
def _(s, d):
    z = features.zscore(emb4(s, d).select("rec", "label", "x0", "x1"), ["x0", "x1"])
    return rounded(features.local_outliers(z.select("rec", "label", F.array("x0", "x1").alias("v")), "rec", "v", "label"), "lof")


_SCORED = """c AS (SELECT t, g, count(*) AS n FROM (SELECT CASE WHEN quality = 1 THEN 'good' WHEN doc_id % 50 = 0 THEN 'UNKNOWN' ELSE 'bad' END AS t, CASE WHEN toxic = 0 THEN 'good' ELSE 'bad' END AS g FROM labels) GROUP BY t, g),
k AS (SELECT * FROM c WHERE t <> 'UNKNOWN'), a AS (SELECT sum(n)::DOUBLE AS a FROM k),
p AS (SELECT x.k, coalesce((SELECT sum(n) FROM k WHERE t = x.k), 0)::DOUBLE AS t, coalesce((SELECT sum(n) FROM k WHERE g = x.k), 0)::DOUBLE AS g, coalesce((SELECT sum(n) FROM k WHERE t = x.k AND g = x.k), 0)::DOUBLE AS h FROM (VALUES ('good'), ('bad')) AS x(k)),
e AS (SELECT p.*, a, (a - t - g + 2 * h) / a AS r, (t * g + (a - t) * (a - g)) / (a * a) AS ch FROM p, a)"""


def labelled(s: SparkSession, d: str) -> DataFrame:
    return tables.read(s, d, "labels").select(F.when(F.col("quality") == 1, "good").when(F.col("doc_id") % 50 == 0, "UNKNOWN").otherwise("bad").alias("t"), F.when(F.col("toxic") == 0, "good").otherwise("bad").alias("g"))


@query(
    "class_scores",
    f"""WITH {_SCORED}
SELECT 'kappa' AS measure, k AS class, round((r - ch) / (1 - ch), 6) AS value FROM e UNION ALL SELECT 'f1', k, round(coalesce(2 * h / nullif(t + g, 0), 0), 6) FROM e UNION ALL SELECT 'accuracy', k, round(r, 6) FROM e
UNION ALL SELECT 'accuracy', 'all', round(sum(h) / max(a), 6) FROM e UNION ALL SELECT 'kappa', 'all', round((sum(h) / max(a) - sum(t * g / (a * a))) / (1 - sum(t * g / (a * a))), 6) FROM e
UNION ALL SELECT 'f1', 'all', round(sum(2 * h / (t + g) * t / a), 6) FROM e UNION ALL SELECT 'unknown', 'all', round(sum(CASE WHEN t = 'UNKNOWN' THEN n ELSE 0 END) / sum(n), 6) FROM c""",
)
def _(s, d):
    return rounded(features.scores(labelled(s, d), "t", "g"), "value")


@query("confusion", "SELECT CAST(quality AS VARCHAR) AS truth, CAST(toxic AS VARCHAR) AS guess, count(*) AS n FROM labels GROUP BY 1, 2")
def _(s, d):
    return features.confusion(tables.read(s, d, "labels"), "quality", "toxic")


_ROC = "b AS (SELECT l_discount AS s, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END)::DOUBLE AS n FROM lineitem GROUP BY 1)"


def binary(s: SparkSession, d: str) -> DataFrame:
    return li(s, d).select(F.col("l_discount").alias("s"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))


@query("roc_threshold", f"WITH {_ROC}, r AS (SELECT s, sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY s DESC) / sum(n) OVER () AS fpr FROM b) SELECT s AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(1 - s, 6) AS stability FROM r ORDER BY round(sqrt((1 - fpr) * (1 - fpr) + tpr * tpr), 12) DESC, s DESC LIMIT 1")
def _(s, d):
    return rounded(features.roc_threshold(binary(s, d), "y", "s"), "tpr", "fpr", "stability")


@query("auroc_ap", f"WITH {_ROC}, r AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM b) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auroc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS ap FROM r")
def _(s, d):
    return rounded(features.auroc_ap(binary(s, d), "y", "s"), "auroc", "ap")


_X = range(4)


@query(
    "compare_datasets",
    f"""WITH v AS (SELECT CAST(vec_id % 2 AS VARCHAR) AS d, CAST(label AS VARCHAR) AS y, {", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in _X)} FROM embeddings),
m AS (SELECT d, {", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in _X)} FROM v GROUP BY d),
k AS (SELECT v.d AS a, y, {", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in _X)} FROM v JOIN m USING (d)), kk AS (SELECT a, y AS class, {", ".join(f"z{i}" for i in _X)} FROM k UNION ALL SELECT a, 'all', {", ".join(f"z{i}" for i in _X)} FROM k),
q AS (SELECT row_number() OVER () AS r, v.d AS b, v.y, {", ".join(f"x{i}" for i in _X)} FROM v), z AS (SELECT r, m.d AS a, b, y, {", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in _X)} FROM q, m),
l AS (SELECT r, z.a, b, class, CASE WHEN y = class THEN 1 ELSE 0 END AS hit, ln(avg(exp(-({" + ".join(f"(z.z{i} - kk.z{i}) * (z.z{i} - kk.z{i})" for i in _X)}) / 2))) - {len(_X)} / 2.0 * ln(2 * pi()) AS ll FROM z JOIN kk ON kk.a = z.a GROUP BY r, z.a, b, class, y),
c AS (SELECT a, b, class, round(ll, 9) AS s, sum(hit)::DOUBLE AS p, sum(1 - hit)::DOUBLE AS n FROM l WHERE class <> 'all' GROUP BY 1, 2, 3, 4),
t AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY a, b, class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (PARTITION BY a, b, class ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY a, b, class ORDER BY s DESC) AS fp FROM c),
e AS (SELECT a, b, class, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auroc, sum(p * tp / (tp + fp)) / sum(p) AS ap FROM t GROUP BY a, b, class)
SELECT x.a, x.b, x.class, round(x.v, 6) AS loglikelihood, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM (SELECT a, b, class, avg(ll) AS v FROM l GROUP BY a, b, class) x LEFT JOIN e ON e.a = x.a AND e.b = x.b AND e.class = x.class""",
)
def _(s, d):
    cols = [f"x{i}" for i in _X]
    e = emb4(s, d).select((F.col("rec") % 2).cast("string").alias("d"), F.col("label").cast("string").alias("y"), *cols)
    return rounded(features.compare_datasets(e, "d", "y", cols), "loglikelihood", "auroc", "ap")


@query(
    "dataset_matrix",
    """WITH v AS (SELECT CAST(vec_id % 2 AS VARCHAR) AS d, CAST(label % 3 AS VARCHAR) AS y, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1 FROM embeddings),
m AS (SELECT d, avg(x0) AS m0, stddev_pop(x0) AS s0, avg(x1) AS m1, stddev_pop(x1) AS s1 FROM v GROUP BY d),
k AS (SELECT v.d AS a, y, (x0 - m0) / s0 AS z0, (x1 - m1) / s1 AS z1 FROM v JOIN m USING (d)), kk AS (SELECT a, y AS class, z0, z1 FROM k UNION ALL SELECT a, 'all', z0, z1 FROM k),
q AS (SELECT row_number() OVER () AS r, v.d AS b, v.y, x0, x1 FROM v), z AS (SELECT r, m.d AS a, b, y, (x0 - m0) / s0 AS z0, (x1 - m1) / s1 AS z1 FROM q, m),
l AS (SELECT r, z.a, b, class, CASE WHEN y = class THEN 1 ELSE 0 END AS hit, ln(avg(exp(-((z.z0 - kk.z0) * (z.z0 - kk.z0) + (z.z1 - kk.z1) * (z.z1 - kk.z1)) / 2))) - ln(2 * pi()) AS ll FROM z JOIN kk ON kk.a = z.a GROUP BY r, z.a, b, class, y),
c AS (SELECT a, b, class, round(ll, 9) AS s, sum(hit)::DOUBLE AS p, sum(1 - hit)::DOUBLE AS n FROM l WHERE class <> 'all' GROUP BY 1, 2, 3, 4),
t AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY a, b, class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (PARTITION BY a, b, class ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY a, b, class ORDER BY s DESC) AS fp FROM c),
e AS (SELECT a, b, class, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auroc, sum(p * tp / (tp + fp)) / sum(p) AS ap FROM t GROUP BY a, b, class)
SELECT x.a, x.b, x.class, round(x.v, 6) AS loglikelihood, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM (SELECT a, b, class, avg(ll) AS v FROM l GROUP BY a, b, class) x LEFT JOIN e ON e.a = x.a AND e.b = x.b AND e.class = x.class""",
)
def _(s, d):
    e = emb4(s, d).select((F.col("rec") % 2).cast("string").alias("d"), (F.col("label") % 3).cast("string").alias("y"), "x0", "x1")
    return rounded(features.compare_datasets(e, "d", "y", ["x0", "x1"]), "loglikelihood", "auroc", "ap")


@query("pca_variance")
def _(s, d):
    cols = [f"x{i}" for i in range(4)]
    return features.PCA(cols, 0.8).fit(emb4(s, d)).transform(emb4(s, d)).drop(*cols)


_NB = """m AS (SELECT l_returnflag AS class, count(*) AS n, avg(l_quantity) AS m1, var_pop(l_quantity) AS v1, avg(l_discount) AS m2, var_pop(l_discount) AS v2 FROM lineitem GROUP BY 1),
w AS (SELECT count(*) AS a, greatest(var_pop(l_quantity), var_pop(l_discount)) * 1e-9 AS f FROM lineitem)"""


@query(
    "gauss_nb",
    f"WITH {_NB}, p AS (SELECT l_orderkey * 10 + l_linenumber AS id, class, ln(n * 1.0 / a) - 0.5 * (ln(2 * pi() * (v1 + f)) + (l_quantity - m1) * (l_quantity - m1) / (v1 + f)) - 0.5 * (ln(2 * pi() * (v2 + f)) + (l_discount - m2) * (l_discount - m2) / (v2 + f)) AS lp FROM lineitem, m, w) SELECT id, arg_min(class, (-round(lp, 9), class)) AS class FROM p GROUP BY id",
)
def _(s, d):
    df = li(s, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return classifiers.predict(classifiers.gaussian_nb(df, df, ["l_quantity", "l_discount"], "l_returnflag", "id"), "id")


@query(
    "hist_kl",
    """WITH t AS (SELECT l_returnflag = 'R' AS r, unnest(['l_quantity', 'l_discount']) AS feature, unnest([l_quantity, l_discount]) AS v FROM lineitem), l AS (SELECT avg(v) - 20 * stddev_pop(v) AS lo, 40 * stddev_pop(v) / 200 AS w FROM t),
b AS (SELECT feature, r, greatest(0, least(199, floor((v - lo) / w))) AS bin FROM t, l), n AS (SELECT feature, bin, sum(CASE WHEN r THEN 1 ELSE 0 END) AS a, sum(CASE WHEN r THEN 0 ELSE 1 END) AS b FROM b GROUP BY 1, 2), s AS (SELECT feature, sum(a) AS ta, sum(b) AS tb FROM n GROUP BY 1)
SELECT feature, round(sum((a / ta + 1e-9) * ln((a / ta + 1e-9) / (b / tb + 1e-9))), 6) AS kl FROM n JOIN s USING (feature) GROUP BY feature""",
)
def _(s, d):
    df = li(s, d)
    return rounded(classifiers.histogram_kl(df.where("l_returnflag = 'R'"), df.where("l_returnflag <> 'R'"), ["l_quantity", "l_discount"]), "kl")


@query("bayes_scores")
def _(s, d):
    e = emb4(s, d).withColumn("night", F.col("rec") % 5).withColumn("label", F.col("label") % 3)
    cols = [f"x{i}" for i in range(4)]
    return classifiers.GaussianBayes(cols, "label").fit(e).scores(e, ["night"], "rec")


@query("bayes_kernel_scores")
def _(s, d):
    e = emb4(s, d).withColumn("night", F.col("rec") % 5).withColumn("label", F.col("label") % 3)
    cols = [f"x{i}" for i in range(4)]
    return classifiers.GaussianBayes(cols, "label", kernel=True).fit(e).scores(e, ["night"], "rec")


def stage_scores(h: DataFrame, states: list[str]) -> DataFrame:
    """(rec, k, a score for each stage, which add up to one): the scored stage weighs most, all vary with the event."""
    k = F.row_number().over(W.partitionBy("rec").orderBy("start_us")).cast("long")
    weight = [F.when(F.col("annotation") == x, 9).otherwise(1) + (F.col("event_id") * (i + 3)) % 7 for i, x in enumerate(states)]
    return h.withColumn("k", k).select("rec", "k", "annotation", *[(w / sum(weight, F.lit(0))).alias(x) for w, x in zip(weight, states)])


def _markov_sql() -> str:
    t, states = classifiers.default_matrix(), classifiers.STATES
    every = range(len(states))
    weight = [f"(CASE WHEN annotation = '{x}' THEN 9 ELSE 1 END + (event_id * {i + 3}) % 7)" for i, x in enumerate(states)]
    of = lambda values: "CASE s " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
    q = [f"q{i}" for i in every]
    row = [of([repr(float(t[j, i])) for j in every]) for i in every]
    stay = of([repr(float(t[j, j])) for j in every])
    made = ", ".join(f"CASE WHEN s = {i} THEN 0 ELSE q{i} * {row[i]} END AS p{i}" for i in every)
    share = ", ".join(f"CASE WHEN ps > 0 THEN p{i} / ps WHEN s = {i} THEN 0 ELSE 1 / {len(states) - 1}.0 END AS r{i}" for i in every)
    best = "CASE " + " ".join(f"WHEN r{i} = greatest({', '.join(f'r{j}' for j in every)}) THEN {i}" for i in every) + " END"
    moved = [f"CASE WHEN {i} = best THEN c WHEN {i} = s THEN 0 ELSE r{i} * (1 - c) END" for i in every]
    out = ", ".join(f"CASE WHEN c > 0.5 THEN CASE WHEN {i} = s THEN 1 - ({' + '.join(moved)}) ELSE {moved[i]} END WHEN {i} = s THEN 1 - c ELSE r{i} * c END AS o{i}" for i in every)
    names = ", ".join(f"o{i}" for i in every)
    return f"""WITH RECURSIVE {sleeping.HY}, w AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY start_us) AS n, {", ".join(f"{x} AS w{i}" for i, x in enumerate(weight))} FROM h),
r AS (SELECT rec, n, {", ".join(f"w{i} * 1.0 / ({' + '.join(f'w{j}' for j in every)}) AS q{i}" for i in every)} FROM w),
f AS (SELECT rec, CAST(0 AS BIGINT) AS n, 0 AS s, {", ".join(f"CAST(0 AS DOUBLE) AS o{i}" for i in every)} FROM r WHERE n = 1 UNION ALL
 SELECT rec, n, CASE WHEN c > 0.5 THEN best ELSE s END, {out} FROM (SELECT *, {best} AS best FROM (SELECT *, {share} FROM (SELECT *, {" + ".join(f"p{i}" for i in every)} AS ps, CASE WHEN away * prior + (1 - away) * (1 - prior) > 0 THEN away * prior / (away * prior + (1 - away) * (1 - prior)) ELSE 0 END AS c
  FROM (SELECT r.rec, r.n, f.s, {", ".join(q)}, {" + ".join(f"CASE WHEN s = {i} THEN 0 ELSE q{i} END" for i in every)} AS away, 1 - {stay} AS prior, {made} FROM f JOIN r ON r.rec = f.rec AND r.n = f.n + 1)))))
SELECT rec, n AS k, CASE s {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(states))} END AS state, {", ".join(f"round(o{i}, 7) AS {x}" for i, x in enumerate(states))} FROM f WHERE n > 0"""


@query("markov_decode", _markov_sql())
def _(s, d):
    states = classifiers.STATES
    got = classifiers.markov_decode(stage_scores(sleeping.hy(s, d), states), ["rec"], "k", states, classifiers.default_matrix())
    return rounded(got, *states, digits=7).select("rec", "k", "state", *states)


def wide(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Vectors of three classes as a feature matrix of eight columns, five nights."""
    e = tables.epochs(tables.read(s, d, "embeddings"))
    cols = [f"x{i}" for i in range(8)]
    return e.select("rec", (F.col("rec") % 5).alias("night"), (F.col("label") % 3).alias("label"), *[F.col("x")[i].alias(c) for i, c in enumerate(cols)]), cols


@query("training_chain")
def _(s, d):
    df, cols = wide(s, d)
    return training.TrainingChain(cols, "label", ["rec"], select=4).fit(df).scores(df, ["night"], "rec")


def signal_of(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(samples, labelled epochs): the vectors of a fifth as 64 samples each, one after the other; a stage for each by its label."""
    e = tables.epochs(tables.read(s, d, "embeddings"))
    stage = F.element_at(F.array(F.lit("AWAKE"), F.lit("N2"), F.lit("REM")), (F.col("label") % 3 + 1).cast("int"))
    e = e.select((F.col("rec") % 5).alias("night"), F.floor(F.col("rec") / 5).alias("k"), stage.alias("annotation"), "x").withColumnRenamed("night", "rec")
    samples = e.select("rec", F.posexplode("x").alias("p", "x"), "k").select("rec", (F.col("k") * 64 + F.col("p")).alias("i"), "x")
    return samples, e


@query("signal_hypnogram")
def _(s, d):
    samples, labelled = signal_of(s, d)
    return staging.SignalModel(64.0, 1.0).fit(labelled).hypnogram(samples)


@query("causal_hypnogram")
def _(s, d):
    samples, labelled = signal_of(s, d)
    return staging.CausalModel(64.0, 1.0).fit(labelled, evaluations=60, popsize=5).hypnogram(samples)


@query("stability_search")
def _(s, d):
    states = classifiers.STATES
    h = sleeping.hy(s, d).withColumn("k", F.row_number().over(W.partitionBy("rec").orderBy("start_us")).cast("long"))
    scored = h.select("rec", "k", "annotation", *[F.when(F.col("annotation") == x, 0.6).otherwise(0.1).alias(x) for x in states])
    best, kappa = training.stability_search(scored, ["rec"], "k", states, "annotation", classifiers.default_matrix())
    return s.createDataFrame([(x, float(b), float(kappa)) for x, b in zip(states, best)], "state string, stability double, kappa double")


@query("map_genetic")
def _(s, d):
    e, cols = wide(s, d)
    scale, shift, cost = training.genetic_map(e.where("rec % 2 = 0"), e.where("rec % 2 = 1"), cols[:3], generations=5)
    return s.createDataFrame([(c, float(k), float(t), cost) for c, k, t in zip(cols, scale, shift)], "feature string, scale double, shift double, cost double")


@query("pair_structure")
def _(s, d):
    # the model holds all differences of its rows, so they are one for each nation, over all its customers
    each = tables.read(s, d, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 1000).alias("x0"), F.log(F.count("*")).alias("x1"))
    df = tables.read(s, d, "nation").join(each, F.col("n_nationkey") == F.col("c_nationkey")).dropna(subset=["x0"]).select(F.col("n_nationkey").alias("rec"), F.col("n_regionkey").alias("label"), F.lit(0).alias("recording"), "x0", "x1")
    return training.PairStructure(["x0", "x1"], "label").fit(df).scores(df, ["recording"], "rec")


@query("stimulation_models")
def _(s, d):
    freq = F.element_at(F.array(*[F.lit(f) for f in training.STIMULATION_MODELS]), (F.col("rec") % 4 + 1).cast("int"))
    stage = F.element_at(F.array(*[F.lit(x) for x in classifiers.STATES]), (F.col("label") % 5 + 1).cast("int"))
    e = tables.epochs(tables.read(s, d, "embeddings")).select("rec", (F.col("rec") % 5).alias("night"), "x", stage.alias("annotation"), freq.alias("freq"), F.lit(1.0).alias("rate"))
    n = len(e.select("x").head()[0])
    m = training.StimulationModels(float(n), n, ("rec", "night")).fit(e)
    return m.scores(e, ["night"], "rec")
