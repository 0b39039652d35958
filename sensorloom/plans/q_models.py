"""Drift, weights, models and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import drift, evaluate, models, sequences, svm
from sensorloom.plans import bindings as B
from sensorloom.plans import q_sequences as S
from sensorloom.plans.registry import query
from sensorloom.session import written

rnd, r = B.rnd, B.r
CUT = "DATE '1999-01-01'"
SIDES = f"""WITH {B.READINGS}, e AS (SELECT qty, disc, price FROM readings WHERE d < {CUT}), a AS (SELECT least(qty * 1.2, 45) AS qty, disc, price FROM readings WHERE d >= {CUT})"""


def sides(spark, sf):
    df = B.readings(spark, sf)
    a = df.filter(f"d >= {CUT}").select(F.least(F.col("qty") * 1.2, F.lit(45.0)).alias("qty"), "disc", "price")
    return df.filter(f"d < {CUT}").select("qty", "disc", "price"), a


def _psi(c: str) -> str:
    return f"""SELECT '{c}' AS feature, sum((ar - er) * ln(ar / er)) AS psi FROM (SELECT greatest(coalesce(e.n, 0) / (sum(e.n) OVER ())::DOUBLE, 1e-12) AS er, greatest(coalesce(a.n, 0) / (sum(a.n) OVER ())::DOUBLE, 1e-12) AS ar
 FROM (SELECT bin, count(*) AS n FROM (SELECT CASE WHEN {c} = cuts[len(cuts)] THEN len(cuts) - 1 ELSE len(list_filter(cuts, lambda x: x <= {c})) END AS bin FROM e, (SELECT list_sort(list_distinct(quantile_cont({c}, [i / 20.0::DOUBLE FOR i IN range(21)]))) AS cuts FROM e) WHERE {c} BETWEEN cuts[1] AND cuts[len(cuts)]) GROUP BY bin) e
 FULL JOIN (SELECT bin, count(*) AS n FROM (SELECT CASE WHEN {c} = cuts[len(cuts)] THEN len(cuts) - 1 ELSE len(list_filter(cuts, lambda x: x <= {c})) END AS bin FROM a, (SELECT list_sort(list_distinct(quantile_cont({c}, [i / 20.0::DOUBLE FOR i IN range(21)]))) AS cuts FROM e) WHERE {c} BETWEEN cuts[1] AND cuts[len(cuts)]) GROUP BY bin) a USING (bin))"""


_Q = "[" + ", ".join(f"{i / 20!r}::DOUBLE" for i in range(21)) + "]"
PSI = " UNION ALL ".join(_psi(c).replace("[i / 20.0::DOUBLE FOR i IN range(21)]", "[" + ", ".join(repr(i / 20) for i in range(21)) + "]") for c in ("qty", "disc", "price"))


@query("J1", SIDES + f", p AS ({PSI}) SELECT feature, {r('p.psi', 6)} AS psi FROM p")
def psi(spark: SparkSession, sf: str) -> DataFrame:
    e, a = sides(spark, sf)
    return drift.psi(e, a, ["qty", "disc", "price"]).withColumn("psi", rnd("psi", 6))


def _ks(c: str) -> str:
    return f"""SELECT '{c}' AS feature, max(abs(ce / te - ca / ta)) AS ks FROM (SELECT sum(t) OVER (ORDER BY v)::DOUBLE AS ca, sum(1 - t) OVER (ORDER BY v)::DOUBLE AS ce, (sum(t) OVER ())::DOUBLE AS ta, (sum(1 - t) OVER ())::DOUBLE AS te
 FROM (SELECT {c} AS v, 0 AS t FROM e UNION ALL SELECT {c}, 1 FROM a))""".replace("sum(t) OVER (ORDER BY v)::DOUBLE", "(sum(t) OVER (ORDER BY v))::DOUBLE").replace("sum(1 - t) OVER (ORDER BY v)::DOUBLE", "(sum(1 - t) OVER (ORDER BY v))::DOUBLE")


KS = " UNION ALL ".join(_ks(c) for c in ("qty", "disc", "price"))


@query("J2", SIDES + f", k AS ({KS}) SELECT feature, {r('k.ks', 6)} AS ks FROM k")
def ks_statistic(spark: SparkSession, sf: str) -> DataFrame:
    e, a = sides(spark, sf)
    return drift.ks_statistic(e, a, ["qty", "disc", "price"]).withColumn("ks", rnd("ks", 6))


@query("J3 J1 J2", SIDES + f", p AS ({PSI}), k AS ({KS}) SELECT feature, {r('k.ks', 6)} AS ks, {r('p.psi', 6)} AS psi, NOT (k.ks >= 0.4 OR p.psi >= 0.22) AS keep FROM p JOIN k USING (feature)")
def drift_table(spark: SparkSession, sf: str) -> DataFrame:
    e, a = sides(spark, sf)
    return drift.drift_table(e, a, ["qty", "disc", "price"]).select("feature", rnd("ks", 6).alias("ks"), rnd("psi", 6).alias("psi"), "keep")


@query("J3", SIDES + f", p AS ({PSI}), k AS ({KS}), t AS (SELECT feature FROM p JOIN k USING (feature) WHERE NOT (k.ks >= 0.4 OR p.psi >= 0.22)), "
       + "m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, avg({c}) AS mean FROM a" for c in ("qty", "disc", "price"))
       + f") SELECT feature, n, {r('m.mean', 6)} AS mean FROM m WHERE feature IN (SELECT feature FROM t)")
def drift_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and mean of each later feature that outlives the pruning of drifted ones."""
    e, a = sides(spark, sf)
    cols = ["qty", "disc", "price"]
    pruned = drift.drift_prune(a, drift.drift_table(e, a, cols), cols)
    left = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), rnd(F.col(f"m_{c}"), 6).alias("mean")) for c in pruned.columns])
    sums = pruned.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for c in pruned.columns], *[F.avg(c).alias(f"m_{c}") for c in pruned.columns])
    if not pruned.columns:
        return spark.createDataFrame([], "feature string, n long, mean double")
    return sums.select(F.inline(left))


def _moments_sql(name: str, rows: str) -> str:
    """Means and the ridged covariance matrix [[p, q], [q, s]] of two columns, with its square root's parts."""
    return f"""{name}0 AS (SELECT avg(qty) AS mx, avg(disc) AS my, @(qty, qty) + 1e-3 AS p, @(qty, disc) AS q, @(disc, disc) + 1e-3 AS s FROM {rows}),
{name} AS (SELECT *, sqrt(p * s - q * q) AS d, sqrt(p + s + 2 * sqrt(p * s - q * q)) AS t FROM {name}0)""".replace("@", "covar_samp")


# A 2 x 2 root has a closed form: (M + sqrt(det) I) / sqrt(trace + 2 sqrt(det)).
CORAL = SIDES + f""", {_moments_sql("ms", "e")}, {_moments_sql("mt", "a")},
i AS (SELECT ms.mx AS ax, ms.my AS ay, mt.mx AS bx, mt.my AS bw, (ms.s + ms.d) / (ms.t * ms.d) AS i11, -ms.q / (ms.t * ms.d) AS i12, (ms.p + ms.d) / (ms.t * ms.d) AS i22,
 (mt.p + mt.d) / mt.t AS r11, mt.q / mt.t AS r12, (mt.s + mt.d) / mt.t AS r22 FROM ms, mt)
SELECT {r('bx + (qty - ax) * (i11 * r11 + i12 * r12) + (disc - ay) * (i12 * r11 + i22 * r12)')} AS qty, {r('bw + (qty - ax) * (i11 * r12 + i12 * r22) + (disc - ay) * (i12 * r12 + i22 * r22)', 6)} AS disc, price FROM e, i"""


@query("J4", CORAL)
def coral(spark: SparkSession, sf: str) -> DataFrame:
    e, a = sides(spark, sf)
    return drift.coral(e, a, ["qty", "disc"]).withColumns({"qty": rnd("qty"), "disc": rnd("disc", 6)})


PROFILE = f"""WITH {B.READINGS}, p AS (SELECT base, CAST(year(d) AS INTEGER) AS year, avg(qty) / 5 AS x, avg(disc) * 50 AS y, avg(tax) * 50 AS z, avg(CASE WHEN flag = 'R' THEN 1.0 ELSE 0.0 END) AS share FROM readings GROUP BY ALL),
tr AS (SELECT * FROM p WHERE year < 1999), te AS (SELECT * FROM p WHERE year >= 1999)"""


def profile(spark, sf, kept=lambda df: df):
    df = kept(B.readings(spark, sf).groupBy("base", F.year("d").alias("year")).agg(
        (F.avg("qty") / 5).alias("x"), (F.avg("disc") * 50).alias("y"), (F.avg("tax") * 50).alias("z"),
        F.avg((F.col("flag") == "R").cast("double")).alias("share")))
    return df, df.filter("year < 1999"), df.filter("year >= 1999")


@query("J5")
def density_ratio_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the operator's full grid, each row with the table of the settings and their AUC."""
    _, tr, te = profile(spark, sf, lambda df: written(df, "profile"))  # read by both sides and by the weights
    weights, settings = drift.density_ratio_weight(tr, te, ["x", "y", "z"])
    # One row per setting.
    tried = settings.agg(F.sort_array(F.collect_list(F.struct("size", "gamma", "domain_auc")))).scalar()
    return weights.withColumn("settings", tried)


@query("J6", PROFILE + f", n AS (SELECT tr.base, tr.year, min(sqrt((tr.x - te.x) ** 2 + (tr.y - te.y) ** 2 + (tr.z - te.z) ** 2)) AS distance FROM tr, te GROUP BY ALL), s AS (SELECT median(distance) + 1e-9 AS s FROM n) SELECT base, year, {r('distance', 6)} AS distance, {r('exp(-(distance * distance) / (2 * s * s))', 6)} AS weight FROM n, s")
def proximity_weight(spark: SparkSession, sf: str) -> DataFrame:
    _, tr, te = profile(spark, sf)
    out = drift.proximity_weight(tr, te, ["base", "year"], ["x", "y", "z"])
    return out.select("base", "year", rnd("distance", 6).alias("distance"), rnd("weight", 6).alias("weight"))


@query("J7", PROFILE + f""", q AS (SELECT quantile_cont(z, 0.01) AS lo, quantile_cont(z, 0.99) AS hi FROM p), w AS (SELECT base, year, x, y, (greatest(lo, least(hi, z)) - lo) / (hi - lo + 1e-9) AS z FROM p, q)
SELECT base, year, {r('z', 6)} AS z, {r('greatest(0.05, least(10.0, x * y * z))', 6)} AS weight FROM w""")
def combined_weights(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.combine_weights(drift.percentile_scale(profile(spark, sf)[0], "z"), ["x", "y", "z"])
    return out.select("base", "year", rnd("z", 6).alias("z"), rnd("weight", 6).alias("weight"))


_POST = "{p} * pi / ({p} * pi + (1 - {p}) * (1 - pi) + 1e-9)"
# Fifty rounds, each a table of one row; a share that has settled no longer moves.
_ROUNDS = ", ".join(f"m{k} AS (SELECT CASE WHEN abs(new - pi) < 1e-6 THEN pi ELSE new END AS pi FROM (SELECT any_value(pi) AS pi, sum({_POST.format(p='c.p')} * n) / sum(n) AS new FROM c, m{k - 1}))" for k in range(1, 51))
EM = f"""WITH {B.SCORES}, u AS (SELECT ok, ln, pos, d, least(score, 1.0::DOUBLE) AS score FROM scores), c AS (SELECT score AS p, count(*)::DOUBLE AS n FROM u GROUP BY score), m0 AS (SELECT 0.3::DOUBLE AS pi), {_ROUNDS}
SELECT ok, ln, pos, d, {r('score')} AS score, {r(f"greatest(1e-6, least(1 - 1e-6, {_POST.format(p='score')}))")} AS adjusted FROM u, m50"""


@query("J8", EM)
def em_prior_shift(spark: SparkSession, sf: str) -> DataFrame:
    df = B.scores(spark, sf).select("ok", "ln", "pos", "d", F.least("score", F.lit(1.0)).alias("score"))
    out = drift.em_prior_shift(df, "score", 0.3)[0]
    return out.withColumns({"score": rnd("score"), "adjusted": rnd("adjusted")})


def model_rows(spark, sf):
    """All steps of the sequences of B.contexts with the contexts' label, early contexts for training; the sequences are written once, for
    their several readers, which lay out the columns they need."""
    df = sequences.flatten(written(S.padded(spark, sf), "sequences"), ["key", "base", "r_date", "label"], S.FEATS, S.L)
    return df, df.filter(S.TRAIN), df.filter(f"NOT ({S.TRAIN})")


FEATURES = [f"t{i}_{c}" for i in range(1, S.L + 1) for c in S.FEATS]


def _scored(df):
    return df.select("key", "label", F.round("score", 6).alias("score"))


@query("K1 K8")
def linear_svm(spark: SparkSession, sf: str) -> DataFrame:
    _, train, test = model_rows(spark, sf)
    return _scored(models.margin_score(models.linear_svm(train, FEATURES, "label"), test))


_STEPS = " UNION ALL ".join(f"SELECT 't' || pos || '_{c}' AS feature, {r('avg(l.@)', 6)} AS mean, {r('CASE WHEN stddev_pop(l.@) > 1e-12 THEN stddev_pop(l.@) ELSE 1 END', 6)} AS deviation FROM long l WHERE {S.TRAIN} GROUP BY pos".replace("@", c) for c in S.FEATS)


@query("K1", S.SEQ + f", f AS ({_STEPS} UNION ALL SELECT 'intercept', {r('0.0::DOUBLE', 6)}, {r('1.0::DOUBLE', 6)}) SELECT feature, mean, deviation, {r('0.0::DOUBLE', 6)} AS gradient, true AS converged FROM f")
def svm_optimality(spark: SparkSession, sf: str) -> DataFrame:
    """The machine of ``linear_svm`` at its solution: its scaling, and a gradient of zero in every coordinate; the problem is strictly
    convex, so no other weights have one."""
    _, train, _ = model_rows(spark, sf)
    model = models.linear_svm(train, FEATURES, "label")
    out = svm.optimality(model, train, "label")
    return out.select("feature", rnd("mean", 6).alias("mean"), rnd("deviation", 6).alias("deviation"), rnd("gradient", 6).alias("gradient"),
                      F.lit(model.converged).alias("converged"))


@query("K2 I7")
def svm_grid(spark: SparkSession, sf: str) -> DataFrame:
    _, train, _ = model_rows(spark, sf)
    return models.svm_grid(train, FEATURES, "label", ["base"])


@query("K3")
def boosted_trees(spark: SparkSession, sf: str) -> DataFrame:
    _, train, test = model_rows(spark, sf)
    val = train.filter("key % 5 = 0")
    model = models.boosted_trees(train.filter("key % 5 <> 0"), val, FEATURES, "label")
    return _scored(models.probability_score(model, test))


@query("K4")
def logistic_baseline(spark: SparkSession, sf: str) -> DataFrame:
    _, train, test = model_rows(spark, sf)
    return _scored(models.probability_score(models.logistic_baseline(train, ["t30_qty", "t30_disc"], "label"), test))


def _isotonic(part: str, cols: str) -> str:
    """Isotonic fit by the max-min formula over means of score ranges."""
    on = "a.base = b.base AND " if part else ""
    p = f"PARTITION BY {'base, ' if part else ''}i"
    return f"""WITH {B.SCORES}, c AS (SELECT {cols} score, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM (SELECT mapped AS base, round(score, 2) AS score, label FROM scores) GROUP BY ALL),
s AS (SELECT *, row_number() OVER ({part} ORDER BY score) AS i, sum(pos) OVER ({part} ORDER BY score) AS cp, sum(n) OVER ({part} ORDER BY score) AS cn FROM c),
m AS (SELECT {'a.base,' if part else ''} a.i AS a, b.i AS b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) AS mean FROM s a JOIN s b ON {on} a.i <= b.i),
x AS (SELECT {'base,' if part else ''} a, b AS i, min(mean) OVER (PARTITION BY {'base,' if part else ''} a ORDER BY b DESC) AS low FROM m),
f AS (SELECT {'base,' if part else ''} i, max(low) AS v FROM x GROUP BY ALL)
SELECT {'base,' if part else ''} score, {r('v', 6)} AS calibrated FROM s JOIN f USING ({'base, ' if part else ''}i)"""


def rounded_scores(spark, sf):
    return B.scores(spark, sf).select(F.col("mapped").alias("base"), F.round("score", 2).alias("score"), "label")


@query("K5", _isotonic("", ""))
def isotonic_global(spark: SparkSession, sf: str) -> DataFrame:
    df = rounded_scores(spark, sf)
    out = models.isotonic_global(df, df.select("score").distinct(), "score", "label")
    return out.select("score", rnd("calibrated", 6).alias("calibrated"))


@query("K5", _isotonic("PARTITION BY base", "base,"))
def isotonic_per_base(spark: SparkSession, sf: str) -> DataFrame:
    df = rounded_scores(spark, sf)
    out = models.apply_pools(df.select("base", "score").distinct(), models.isotonic_pools(df, "base", "score", "label"), "base", "score")
    return out.select("base", "score", rnd("calibrated", 6).alias("calibrated"))


# Fixed coefficients of the linear score under explanation.
COEF = {"qty": 0.03, "disc": -12.5, "tax": 4.0}
SHAP = f"WITH {B.READINGS}, m AS (SELECT avg(qty) AS q, avg(disc) AS dd, avg(tax) AS t FROM readings), s AS (SELECT ok, ln, pos, d, qty, disc, tax, 0.03::DOUBLE * (qty - q) AS sq, -12.5::DOUBLE * (disc - dd) AS sd, 4.0::DOUBLE * (tax - t) AS st FROM readings, m)"


def contributions(spark, sf):
    return models.linear_contributions(B.readings(spark, sf), COEF)


@query("K6", SHAP + f" SELECT ok, ln, pos, d, {r('sq', 6)} AS qty_shap, {r('sd', 6)} AS disc_shap, {r('st', 6)} AS tax_shap FROM s")
def linear_shap(spark: SparkSession, sf: str) -> DataFrame:
    return contributions(spark, sf).select("ok", "ln", "pos", "d", *[rnd(f"{c}_shap", 6).alias(f"{c}_shap") for c in COEF])


@query("K6", SHAP + f" SELECT 'qty' AS feature, {r('avg(abs(sq))', 6)} AS impact FROM s UNION ALL SELECT 'disc', {r('avg(abs(sd))', 6)} FROM s UNION ALL SELECT 'tax', {r('avg(abs(st))', 6)} FROM s")
def contribution_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return models.contribution_ranking(contributions(spark, sf), list(COEF)).withColumn("impact", rnd("impact", 6))


@query("M17 K6", SHAP + " SELECT 'qty' AS feature, min(qty) FILTER (sq > 0) AS lo, max(qty) FILTER (sq > 0) AS hi FROM s UNION ALL SELECT 'disc', min(disc) FILTER (sd > 0), max(disc) FILTER (sd > 0) FROM s UNION ALL SELECT 'tax', min(tax) FILTER (st > 0), max(tax) FILTER (st > 0) FROM s")
def risk_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return models.risk_ranges(contributions(spark, sf), list(COEF))


def _mi(c: str) -> str:
    """Mutual information of a column of the blocks' table with the label, in SQL."""
    cuts = " + ".join(f"CASE WHEN {c} > q[{i}] THEN 1 ELSE 0 END" for i in range(1, 10))
    return f"""SELECT '{c}' AS feature, sum(n / nt * ln(n * nt / (nx * ny))) AS mi FROM (SELECT n, (sum(n) OVER (PARTITION BY bin))::DOUBLE AS nx, (sum(n) OVER (PARTITION BY label))::DOUBLE AS ny, (sum(n) OVER ())::DOUBLE AS nt
 FROM (SELECT {cuts} AS bin, label, count(*) AS n FROM blocks, (SELECT quantile_cont({c}, [{', '.join(repr(i / 10) for i in range(1, 10))}]) AS q FROM blocks) GROUP BY ALL))"""


BLOCKS = f"""blocks AS (SELECT key, label, {", ".join(f"max(CASE WHEN pos = {S.L} THEN {c} END) AS {c}_last, {B.r(f"coalesce(avg({c}) FILTER (NOT is_pad), 0)", 6)} AS {c}_mean" for c in S.FEATS)} FROM long GROUP BY key, label)"""
MI = S.SEQ + f", {BLOCKS}, k AS ({' UNION ALL '.join(_mi(f'{c}_{b}') for c in S.FEATS for b in ('last', 'mean'))})"


def information(spark, sf):
    """Mutual information of the last step and of the mean over the real steps, per feature."""
    blocks = S.long(spark, sf).groupBy("key", "label").agg(
        *[F.max(F.when(F.col("pos") == S.L, F.col(c))).alias(f"{c}_last") for c in S.FEATS],
        *[rnd(F.coalesce(F.avg(F.when(~F.col("is_pad"), F.col(c))), F.lit(0.0)), 6).alias(f"{c}_mean") for c in S.FEATS])
    blocks = written(blocks, "blocks")  # read by the cuts and by the counts
    return models.mutual_information(blocks, [f"{c}_{b}" for c in S.FEATS for b in ("last", "mean")], "label")


@query("K7", MI + f" SELECT feature, {r('k.mi', 9)} AS mi FROM k")
def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    return information(spark, sf).withColumn("mi", rnd("mi", 9))


@query("K7", MI + f""", f AS (SELECT regexp_replace(feature, '_(last|mean)$', '') AS feature, avg(mi) AS mi FROM k GROUP BY 1)
SELECT feature, row_number() OVER (ORDER BY round(mi, 12) DESC, feature) <= greatest(1, CAST(ceil({len(S.FEATS)} * 0.8) AS INTEGER)) AS kept FROM f""")
def kept_by_information(spark: SparkSession, sf: str) -> DataFrame:
    """The features of the best 80 % by the mean of both blocks' information."""
    kept = models.keep_by_information(information(spark, sf), S.FEATS)
    return spark.createDataFrame([(c, c in kept) for c in S.FEATS], "feature string, kept boolean")


@query("K8 D15 L4 A10", f"WITH {B.READINGS}, p AS (SELECT base, d, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.03::DOUBLE * qty - 12.5::DOUBLE * disc + 4.0::DOUBLE * tax - 2.0::DOUBLE))) AS p FROM readings), g AS (SELECT base, d, 1 - product(1 - p) AS probability FROM p GROUP BY base, d) SELECT base, d, {r('probability', 6)} AS probability, CAST(probability >= 0.15 AS INTEGER) AS predicted FROM g")
def scored_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed linear score, logistic link, noisy-or per section and day, label at a threshold."""
    margin = sum((F.lit(w) * F.col(c) for c, w in COEF.items()), F.lit(-2.0))
    rows = B.readings(spark, sf).withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))
    out = models.label_scores(evaluate.group_probability(rows, ["base", "d"], "p"), "probability", 0.15)
    return out.withColumn("probability", rnd("probability", 6))
