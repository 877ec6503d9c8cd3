"""Queries: normalisation, linear and mixed models, information, resampling, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import dist, draws
from cohortloom.operators import (
    classify, information, intervals, linmod, mixed, neighbours, normalize, pca, ranks, replicates, resample, tables,
    visits as vis,
)
from cohortloom.plans import progression
from cohortloom.storage import materialize
from study.registry import query
from study.views import (
    COUNTS_SQL, MEASURE_SQL, SUBJECTS_SQL, VISITS_SQL, counts, measure, real, sql_digest, sql_poisson, sql_real,
    sql_permuted, sql_uniform, subjects, table, visits, wide_measure,
)


#: Resamples of the registered bootstraps and permutations.
REPLICATES = 2000


def rounded(df, keys, columns, digits=6):
    return df.select(*keys, *[real(c, digits).alias(c) for c in columns])


# ---- normalisation -------------------------------------------------------------

_FACTORS = f"""{COUNTS_SQL}, geo as (select feature, avg(ln(value)) as m from counts where value > 0 group by 1
 having count(*) = (select count(distinct sample) from counts)),
factors as (select sample, exp(quantile_cont(ln(value) - m, 0.5)) as size_factor from counts join geo using (feature) where value > 0 group by 1)"""
_VST = "log2((1 + 2.0 + 2 * 0.05 * q + 2 * sqrt(0.05 * q * (1 + 2.0 + 0.05 * q))) / (4 * 0.05))"


@query(f"with {_FACTORS} select sample, {sql_real('size_factor')} as size_factor from factors")
def size_factors(spark, folder):
    return rounded(normalize.size_factors(counts(spark, folder), "sample", "feature", "value"), ["sample"], ["size_factor"])


@query(f"with {_FACTORS} select sample, feature, {sql_real('value / size_factor', 5)} as normalized from counts join factors using (sample)")
def normalized_counts(spark, folder):
    c = counts(spark, folder)
    n = normalize.normalized_counts(c, normalize.size_factors(c, "sample", "feature", "value"), "sample", "value")
    return rounded(n, ["sample", "feature"], ["normalized"], 5)


@query(f"with {_FACTORS}, n as (select sample, feature, value / size_factor as q from counts join factors using (sample)) select sample, feature, {sql_real(_VST)} as value from n")
def stabilized_counts(spark, folder):
    c = counts(spark, folder)
    n = normalize.normalized_counts(c, normalize.size_factors(c, "sample", "feature", "value"), "sample", "value", "q")
    return n.select("sample", "feature", real(normalize.stabilized(F.col("q"), 0.05, 2.0)).alias("value"))


def _sql_likelihood(source):
    """Adjusted profile log likelihood of the log dispersions of a table (feature, x)."""
    return f"""select feature, x, sum(lgamma(k + exp(-x)) - lgamma(exp(-x)) - k * ln(mu + exp(-x)) - exp(-x) * ln(1 + mu * exp(x))) - ln(sum(mu / (1 + mu * exp(x)))) / 2 as ll
 from expected join {source} using (feature) group by feature, x"""


def _sql_refined(source, name, step):
    return f"""{name}_x as (select feature, x + i * {step}::double as x from {source}, (select unnest(range(-25, 26)) as i)), {name} as (select feature, max_by(x, ll) as x, max(ll) as ll from ({_sql_likelihood(name + '_x')}) group by 1)"""


_DISPERSION = f"""{COUNTS_SQL}, n as (select count(distinct sample) as n from counts),
geo as (select feature, avg(ln(value)) as g from counts where value > 0 group by 1 having count(*) = (select n from n)),
sf as (select sample, exp(quantile_cont(ln(value) - g, 0.5)) as s from counts join geo using (feature) where value > 0 group by 1),
grid as (select feature, sample, s, coalesce(value, 0)::double as k from (select distinct feature from counts) cross join sf left join counts using (feature, sample)),
expected as (select feature, k, s * avg(k / s) over (partition by feature) as mu from grid),
start as (select distinct feature, -8.0::double as x from expected), {_sql_refined('start', 'l1', 0.4)}, {_sql_refined('l1', 'l2', 0.02)}, {_sql_refined('l2', 'l3', 0.001)}, {_sql_refined('l3', 'l4', 0.00005)}"""


@query(f"with {_DISPERSION} select feature, {sql_real('ll', 3)} as log_likelihood, true as converged from l4")
def dispersion_optimum(spark, folder):
    """The likelihood at every feature's fitted dispersion, against the best of nested grids."""
    rows = materialize(counts(spark, folder), "counts")
    factors = materialize(normalize.size_factors(rows, "sample", "feature", "value"), "size-factors")
    expected = materialize(normalize.expected_counts(rows, factors, "sample", "feature", "value"), "expected")
    fits = normalize.likelihood_dispersions(expected, "feature", factors.count())
    at = fits.select("feature", F.log("dispersion").alias("log_dispersion"), "converged")
    found = normalize.dispersion_likelihood(expected, at.drop("converged"), "feature")
    return found.join(at, "feature").select("feature", real("log_likelihood", 3).alias("log_likelihood"), "converged")


@query()
def variance_stabilization(spark, folder):
    return normalize.variance_stabilize(counts(spark, folder), "sample", "feature", "value")


_BATCHED = f"{MEASURE_SQL}, shifted as (select *, value + 0.05 * batch as v from measure)"


def _batched(spark, folder):
    return measure(spark, folder).withColumn("v", F.col("value") + F.lit(0.05) * F.col("batch"))


@query(f"""with {_BATCHED}, b as (select feature, batch, avg(v) as m from shifted group by all), c as (select feature, avg(m) as c from b group by 1)
select sample, feature, {sql_real('v - m + c')} as adjusted from shifted join b using (feature, batch) join c using (feature)""")
def batch_removal(spark, folder):
    out = normalize.remove_batch_means(_batched(spark, folder), "feature", "batch", "v")
    return rounded(out, ["sample", "feature"], ["adjusted"])


@query(f"""with {_BATCHED}, b as (select feature, batch, avg(v) as mv, avg(y) as my from shifted group by all),
w as (select feature, sum((v - mv) * (y - my)) / sum((y - my) * (y - my)) as beta from shifted join b using (feature, batch) group by 1),
e as (select feature, batch, mv - beta * my as level from b join w using (feature)), c as (select feature, avg(level) as c from e group by 1)
select sample, feature, {sql_real('v - level + c')} as adjusted from shifted join e using (feature, batch) join c using (feature)""")
def batch_removal_with_design(spark, folder):
    coded = _batched(spark, folder).withColumns(tables.sum_contrasts("batch", [0, 1, 2, 3], "batch_"))
    out = normalize.remove_batch(coded, "feature", "v", ["y"], ["batch_1", "batch_2", "batch_3"])
    return rounded(out, ["sample", "feature"], ["adjusted"])


@query(f"""with {MEASURE_SQL}, s as (select feature, avg(value) as m, stddev_samp(value) as sd from measure where visit = 1 group by 1)
select sample, feature, {sql_real('(value - m) / sd', 5)} as scaled from measure join s using (feature)""")
def scaling_from_baseline(spark, folder):
    m = measure(spark, folder)
    stats = normalize.scale_stats(m.where("visit = 1"), "feature", "value")
    return rounded(normalize.apply_scale(m, stats, "feature", "value"), ["sample", "feature"], ["scaled"], 5)


# ---- linear models ---------------------------------------------------------------

def sql_ols2(source, by, y, x1, x2, extra=""):
    """SQL text of a two-regressor least-squares term table per group."""
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""mo as (select {keys}count(*)::double as n, avg({y}) as my, avg({x1}) as m1, avg({x2}) as m2,
 var_pop({y}) as syy, var_pop({x1}) as s11, var_pop({x2}) as s22, covar_pop({x1}, {x2}) as s12, covar_pop({x1}, {y}) as s1y, covar_pop({x2}, {y}) as s2y from {source} {group}),
de as (select *, s11 * s22 - s12 * s12 as d from mo),
co as (select *, (s22 * s1y - s12 * s2y) / d as b1, (s11 * s2y - s12 * s1y) / d as b2 from de),
rs as (select *, n * (syy - b1 * s1y - b2 * s2y) as rss, my - b1 * m1 - b2 * m2 as b0 from co),
sg as (select *, rss / (n - 3) as sigma2 from rs),
terms as (select {keys}'intercept' as term, b0 as estimate, sqrt(sigma2 / n * (1 + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / d)) as std_error, sigma2, n from sg
 union all select {keys}'{x1}', b1, sqrt(sigma2 * s22 / d / n), sigma2, n from sg
 union all select {keys}'{x2}', b2, sqrt(sigma2 * s11 / d / n), sigma2, n from sg){extra}"""


@query(f"""with {VISITS_SQL}, {SUBJECTS_SQL}, s as (select subject, regr_slope(score, years) as slope from visits group by 1 having var_pop(years) > 0)
select grp, count(*) as n, {sql_real('avg((slope > 0)::int)')} as rising, {sql_real('avg(slope)', 4)} as mean_slope from s join subjects using (subject) group by grp""")
def rising_share_by_group(spark, folder):
    s = vis.slopes(visits(spark, folder), ["subject"], "score", "years").where(F.col("slope").isNotNull())
    joined = s.join(subjects(spark, folder).select("subject", "grp"), "subject")
    return joined.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), real(F.avg((F.col("slope") > 0).cast("double"))).alias("rising"),
                                     real(F.avg("slope"), 4).alias("mean_slope"))


@query(f"""with {VISITS_SQL} select subject, count(*) as n, {sql_real('case when var_pop(years) > 0 then regr_slope(score, years) end', 6)} as slope,
{sql_real('case when var_pop(years) > 0 then regr_intercept(score, years) end', 6)} as intercept from visits group by subject""")
def slope_per_subject(spark, folder):
    return rounded(vis.slopes(visits(spark, folder), ["subject"], "score", "years"), ["subject", "n"], ["slope", "intercept"], 6)


@query(f"with {MEASURE_SQL}, {sql_ols2('measure', 'feature', 'value', 'y', 'visit')} select feature, term, n::bigint as n, {sql_real('estimate')} as estimate, {sql_real('std_error')} as std_error, {sql_real('estimate / std_error', 4)} as statistic from terms")
def feature_models(spark, folder):
    fits = linmod.fit_ols(measure(spark, folder), ["feature"], "value", ["y", "visit"])
    return fits.select("feature", "term", F.col("n").cast("long").alias("n"), real("estimate").alias("estimate"),
                       real("std_error").alias("std_error"), real("statistic", 4).alias("statistic"))


@query()
def feature_models_interaction(spark, folder):
    m = measure(spark, folder).withColumn("y_x_visit", F.col("y") * F.col("visit"))
    fits = linmod.fit_ols(m, ["feature"], "value", ["y", "visit", "y_x_visit"]).where("term = 'y_x_visit'")
    return ranks.adjust_fdr(fits, [], "p_value", ["feature"], "adj_p").select("feature", "estimate", "std_error", "p_value", "adj_p")


@query(f"""with {MEASURE_SQL}, g as (select feature, y, count(*)::double as n, var_pop(value) as vv, var_pop(visit) as xx, covar_pop(value, visit) as vx from measure group by all),
s as (select feature, max(case when y = 1 then vx / xx end) - max(case when y = 0 then vx / xx end) as est, sum(n * (vv - vx * vx / xx)) / (sum(n) - 4) as s2, sum(1 / (n * xx)) as u from g group by 1)
select feature, {sql_real('est')} as estimate, {sql_real('sqrt(s2 * u)')} as std_error, {sql_real('est / sqrt(s2 * u)', 4)} as statistic from s""")
def interaction_terms(spark, folder):
    """The interaction of class and visit, from a design in which a copy of the visit is left out as collinear."""
    m = measure(spark, folder).withColumns({"y_x_visit": F.col("y") * F.col("visit"), "copied": F.col("visit") * 2 + 1})
    fits = linmod.fit_ols(m, ["feature"], "value", ["y", "visit", "copied", "y_x_visit"]).where("term = 'y_x_visit'")
    return fits.select("feature", real("estimate").alias("estimate"), real("std_error").alias("std_error"), real("statistic", 4).alias("statistic"))


@query(f"""with {MEASURE_SQL}, g as (select feature, visit, count_if(y = 1) as a, count_if(y = 0) as b, avg(case when y = 1 then value end) as p, avg(case when y = 0 then value end) as q,
 var_pop(case when y = 1 then value end) as vp, var_pop(case when y = 0 then value end) as vq from measure group by all),
s as (select *, p - q as est, sqrt((a * vp + b * vq) / (a + b - 2) * (1.0::double / a + 1.0::double / b)) as se from g)
select feature, visit::bigint as visit, a::bigint as n_pos, b::bigint as n_neg, {sql_real('est')} as estimate, {sql_real('se')} as std_error, {sql_real('est / se', 4)} as statistic from s""")
def group_difference_by_visit(spark, folder):
    d = linmod.two_group_difference(measure(spark, folder), ["feature", "visit"], "value", "y")
    return d.select("feature", F.col("visit").cast("long").alias("visit"), "n_pos", "n_neg", real("estimate").alias("estimate"),
                    real("std_error").alias("std_error"), real("statistic", 4).alias("statistic"))


@query(f"""with {VISITS_SQL}, {SUBJECTS_SQL}, v as (select score, years, carrier from visits join subjects using (subject)), {sql_ols2('v', '', 'score', 'years', 'carrier')}
select term, n::bigint as n, {sql_real('estimate', 5)} as estimate, {sql_real('std_error', 5)} as std_error, {sql_real('sigma2', 2)} as sigma2 from terms""")
def single_model_summary(spark, folder):
    v = visits(spark, folder).join(subjects(spark, folder).select("subject", "carrier"), "subject")
    f = linmod.fit_ols(v, [], "score", ["years", "carrier"])
    return f.select("term", F.col("n").cast("long").alias("n"), real("estimate", 5).alias("estimate"), real("std_error", 5).alias("std_error"), real("sigma2", 2).alias("sigma2"))


_FEATURE_FIT = f"""{MEASURE_SQL}, g as (select feature, count_if(y = 1) as a, count_if(y = 0) as b, avg(case when y = 1 then value end) as p, avg(case when y = 0 then value end) as q,
 var_pop(case when y = 1 then value end) as vp, var_pop(case when y = 0 then value end) as vq, avg(value) as ave from measure group by 1),
fit as (select feature, p - q as log_fc, 1.0::double / a + 1.0::double / b as unscaled, (a * vp + b * vq) / (a + b - 2) as sigma2, (a + b - 2)::double as df, ave from g)"""


@query(f"with {_FEATURE_FIT} select feature, {sql_real('log_fc')} as log_fc, {sql_real('unscaled', 8)} as unscaled_var, {sql_real('sigma2', 8)} as sigma2, {sql_real('df', 1)} as df, {sql_real('ave')} as ave_expr from fit")
def shared_design_fit(spark, folder):
    f = linmod.fit_features(measure(spark, folder), "feature", "value", ["y"], "y")
    return f.select("feature", real("log_fc").alias("log_fc"), real("unscaled_var", 8).alias("unscaled_var"), real("sigma2", 8).alias("sigma2"),
                    real("df", 1).alias("df"), real("ave_expr").alias("ave_expr"))


@query(f"with {_FEATURE_FIT}, m as (select *, (4.0 * 0.05 + df * sigma2) / (4.0 + df) as post from fit) select feature, {sql_real('post', 8)} as post_var, {sql_real('log_fc / sqrt(post * unscaled)', 5)} as t from m")
def moderated_t(spark, folder):
    f = linmod.fit_features(measure(spark, folder), "feature", "value", ["y"], "y")
    return linmod.moderate(f, 4.0, 0.05).select("feature", real("post_var", 8).alias("post_var"), real("t", 5).alias("t"))


@query()
def moderated_table(spark, folder):
    f = linmod.fit_features(measure(spark, folder), "feature", "value", ["y"], "y")
    return linmod.ranked_table(f, "feature").orderBy("p_value", "feature")


@query(f"""with {SUBJECTS_SQL}, d as (select (balance > 4500)::int as hit, carrier from subjects),
c as (select count_if(hit = 1 and carrier = 1)::double as a, count_if(hit = 0 and carrier = 1)::double as b, count_if(hit = 1 and carrier = 0)::double as c, count_if(hit = 0 and carrier = 0)::double as e from d)
select 'carrier' as term, {sql_real('ln(a * e / (b * c))', 5)} as estimate, {sql_real('sqrt(1 / a + 1 / b + 1 / c + 1 / e)', 5)} as std_error, {sql_real('a * e / (b * c)', 5)} as odds_ratio from c
union all select 'intercept', {sql_real('ln(c / e)', 5)}, {sql_real('sqrt(1 / c + 1 / e)', 5)}, {sql_real('c / e', 5)} from c""")
def logistic_model(spark, folder):
    s = subjects(spark, folder).withColumn("hit", (F.col("balance") > 4500).cast("int"))
    return rounded(linmod.fit_logistic(s, [], "hit", ["carrier"]), ["term"], ["estimate", "std_error", "odds_ratio"], 5)


@query(f"""with c as (select l_returnflag as g, count(*) as n, corr(l_quantity, l_extendedprice) as r from lineitem group by 1)
select g, n, {sql_real('r')} as r, {sql_real('r * sqrt((n - 2) / (1 - r * r))', 4)} as statistic, {sql_real('tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3))')} as ci_low, {sql_real('tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3))')} as ci_high from c""")
def correlation_test(spark, folder):
    c = linmod.correlation_test(table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "g"), ["g"], "l_quantity", "l_extendedprice")
    return c.select("g", "n", real("r").alias("r"), real("statistic", 4).alias("statistic"), real("ci_low").alias("ci_low"), real("ci_high").alias("ci_high"))


_EFFECTS = f"{MEASURE_SQL}, eff as (select feature, visit, avg(case when y = 1 then value end) - avg(case when y = 0 then value end) as est from measure group by all)"
_PAIRS = f"{_EFFECTS}, pairs as (select a.visit as v1, b.visit as v2, count(*) as n, corr(a.est, b.est) as r from eff a join eff b on a.feature = b.feature and a.visit < b.visit group by all)"


def _effects(spark, folder):
    return linmod.two_group_difference(measure(spark, folder), ["feature", "visit"], "value", "y")


def _pairs(spark, folder):
    return linmod.visit_correlations(_effects(spark, folder), "feature", "visit", "estimate", [1, 2, 3, 4, 5])


@query(f"with {_PAIRS} select v1::bigint as visit_1, v2::bigint as visit_2, n as n_features, {sql_real('r')} as correlation from pairs")
def visit_correlations(spark, folder):
    return _pairs(spark, folder).select(F.col("visit_1").cast("long").alias("visit_1"), F.col("visit_2").cast("long").alias("visit_2"),
                                        "n_features", real("correlation").alias("correlation"))


@query(f"""with {_PAIRS} select (v2 - v1)::bigint as lag, count(*) as n_pairs, {sql_real('avg(r)')} as mean_cor, {sql_real('median(r)')} as median_cor from pairs group by 1
union all select 0, count(*), {sql_real('avg(r)')}, {sql_real('median(r)')} from pairs""")
def correlation_by_lag(spark, folder):
    p = _pairs(spark, folder)
    summary = lambda d: d.agg(F.count(F.lit(1)).alias("n_pairs"), real(F.avg("correlation")).alias("mean_cor"),
                              real(F.percentile("correlation", 0.5)).alias("median_cor"))  # one value per pair of visits
    lag = F.col("lag").cast("long").alias("lag")
    return summary(p.groupBy(lag)).unionByName(summary(p.groupBy(F.lit(0).cast("long").alias("lag"))))


@query(f"with {_EFFECTS} select feature, count(*) as n, {sql_real('regr_slope(est, visit)')} as slope, {sql_real('regr_intercept(est, visit)')} as intercept, {sql_real('avg(est)')} as mean_est from eff group by 1 having count(distinct visit) >= 2")
def effect_drift(spark, folder):
    e = tables.keep_repeated(_effects(spark, folder), "feature", 2, "visit")
    s = vis.slopes(e, ["feature"], "estimate", "visit")
    m = e.groupBy("feature").agg(F.avg("estimate").alias("mean_est"))
    return rounded(s.join(m, "feature"), ["feature", "n"], ["slope", "intercept", "mean_est"])


@query(f"""with {VISITS_SQL}, {SUBJECTS_SQL}, v as (select score, years, carrier from visits join subjects using (subject)),
f as (select carrier, count(*) as n, regr_slope(score, years) as s, regr_intercept(score, years) as i, avg(years) as mx, regr_sxx(score, years) as sxx, regr_syy(score, years) as syy, regr_sxy(score, years) as sxy from v group by 1)
select carrier::bigint as carrier, n, {sql_real('s', 5)} as slope, {sql_real('i', 4)} as intercept, {sql_real('mx')} as mean_x, {sql_real('sqrt((syy - sxy * sxy / sxx) / (n - 2))', 3)} as sigma from f""")
def trend_by_group(spark, folder):
    v = visits(spark, folder).join(subjects(spark, folder).select("subject", "carrier"), "subject")
    t = vis.trend_lines(v, ["carrier"], "score", "years")
    return t.select(F.col("carrier").cast("long").alias("carrier"), "n", real("slope", 5).alias("slope"), real("intercept", 4).alias("intercept"),
                    real("mean_x").alias("mean_x"), real("sigma", 3).alias("sigma"))


@query(f"""with o as (select o_orderstatus a, o_orderpriority b, count(*)::double o from orders group by all), r as (select a, sum(o) r from o group by 1), c as (select b, sum(o) c from o group by 1), n as (select sum(o) n from o)
select {sql_real('sum((coalesce(o, 0) - r * c / n) ** 2 / (r * c / n))', 5)} as statistic, ((select count(*) from r) - 1) * ((select count(*) from c) - 1) as df from r cross join c cross join n left join o using (a, b)""")
def chi_square_table(spark, folder):
    c = linmod.chi_square(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")
    return c.select(real("statistic", 5).alias("statistic"), "df")


@query(f"""with v as (select c_mktsegment g, round(c_acctbal / 50) x from customer), k as (select x, count(*) c from v group by 1),
m as (select x, c, sum(c) over (order by x) - c + (c + 1) / 2.0::double as mid from k), s as (select g, sum(mid) r, count(*) k from v join m using (x) group by 1),
t as (select sum(c)::double n, sum(c ** 3 - c)::double ties from k)
select {sql_real('(12 / (n * (n + 1)) * (select sum(r * r / k) from s) - 3 * (n + 1)) / (1 - ties / (n ** 3 - n))', 5)} as statistic, (select count(*) - 1 from s) as df from t""")
def kruskal_test(spark, folder):
    c = table(spark, folder, "customer").select("c_mktsegment", F.round(F.col("c_acctbal") / 50).alias("x"))
    return linmod.kruskal(c, "x", "c_mktsegment").select(real("statistic", 5).alias("statistic"), "df")


@query(f"with s as (select c_custkey, c_acctbal / 1000 as t from customer) select c_custkey, {sql_real('1 - abs(t) / sqrt(2 + t * t)', 8)} as p_t, {sql_real('exp(-abs(t) / 2)', 8)} as p_chi2, {sql_real('1 - abs(t) / sqrt(2 + t * t)', 8)} as p_f from s")
def p_value_columns(spark, folder):
    s = table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("t"))
    two = F.lit(2.0)
    return s.select("c_custkey", real(dist.t_p_value(F.col("t"), two), 8).alias("p_t"), real(dist.chi2_p_value(F.abs("t"), two), 8).alias("p_chi2"),
                    real(dist.f_p_value(F.col("t") * F.col("t"), F.lit(1.0), two), 8).alias("p_f"))


# ---- mixed models ------------------------------------------------------------------

_LMM = f"""{VISITS_SQL}, ctr as (select avg(years) mt, avg(score) ms from visits),
su as (select subject, count(*)::double n, sum(years - mt) t, sum((years - mt) ** 2) tt, sum(score - ms) s, sum((years - mt) * (score - ms)) ts, sum((score - ms) ** 2) ss, any_value(mt) mt, any_value(ms) ms from visits cross join ctr group by 1),
th as (select unnest([0.0, 0.5, 1.0, 2.0]::double[]) as theta),
pa as (select theta, sum(n) nn, sum(ln(1 + theta * theta * n)) ld, sum(n - k * n * n) a00, sum(t - k * n * t) a01, sum(tt - k * t * t) a11, sum(s - k * n * s) b0, sum(ts - k * t * s) b1, sum(ss - k * s * s) c, any_value(mt) mt, any_value(ms) ms
 from (select *, theta * theta / (1 + theta * theta * n) as k from su cross join th) group by theta),
be as (select *, a00 * a11 - a01 * a01 as d, (a11 * b0 - a01 * b1) / (a00 * a11 - a01 * a01) as x0, (a00 * b1 - a01 * b0) / (a00 * a11 - a01 * a01) as x1 from pa),
dv as (select *, c - x0 * b0 - x1 * b1 as rss from be)"""


@query(f"with {_LMM} select theta, {sql_real('ld + ln(d) + (nn - 2) * (1 + ln(2 * pi() * rss / (nn - 2)))', 3)} as deviance from dv")
def restricted_deviance(spark, folder):
    found = mixed.reml_deviance(visits(spark, folder), "subject", "score", ["years"], [0.0, 0.5, 1.0, 2.0])
    return spark.createDataFrame(found, "theta double, deviance double").select("theta", real("deviance", 3).alias("deviance"))


@query(f"with {_LMM} select subject, {sql_real('theta * theta / (1 + theta * theta * su.n) * (su.s - su.n * x0 - su.t * x1)', 4)} as intercept_dev from su cross join dv where theta = 1.0")
def predicted_intercepts(spark, folder):
    sub = mixed.SubjectTable(visits(spark, folder), "subject", "score", ["years"], None)
    return rounded(mixed.predicted_deviations(sub.finish([1.0]), sub), ["subject"], ["intercept_dev"], 4)


def _cohort(spark, folder):
    v = visits(spark, folder).join(subjects(spark, folder).select("subject", "carrier", "balance"), "subject")
    return v.withColumn("years_x_carrier", F.col("years") * F.col("carrier"))


@query()
def random_intercept_model(spark, folder):
    fit, _ = mixed.fit_random_intercept(_cohort(spark, folder), "subject", "score", ["years", "carrier", "years_x_carrier", "balance"])
    return fit.table(spark)


@query()
def random_slope_model(spark, folder):
    fit, sub = mixed.fit_random_slope(_cohort(spark, folder), "subject", "score", ["years", "carrier", "years_x_carrier"], "years")
    return fit.table(spark)


@query()
def subject_deviations(spark, folder):
    fit, sub = mixed.fit_random_slope(visits(spark, folder), "subject", "score", ["years"], "years")
    return mixed.predicted_deviations(fit, sub)


# ---- information -------------------------------------------------------------------

def sql_entropy(p, n):
    return (f"(case when {p} > 0 then -({p}) / (({p}) + ({n}))::double * ln(({p}) / (({p}) + ({n}))::double) else 0 end"
            f" + case when {n} > 0 then -({n}) / (({p}) + ({n}))::double * ln(({n}) / (({p}) + ({n}))::double) else 0 end)")


@query(f"""with {MEASURE_SQL}, c as (select feature, value, sum(y)::bigint p, sum(1 - y)::bigint n from measure group by all),
k as (select *, sum(p) over w lp, sum(n) over w ln, sum(p) over (partition by feature) tp, sum(n) over (partition by feature) tn from c window w as (partition by feature order by value)),
s as (select *, round(((lp + ln) * {sql_entropy('lp', 'ln')} + (tp + tn - lp - ln) * {sql_entropy('(tp - lp)', '(tn - ln)')}) / (tp + tn), 12) as after_cut from k where lp + ln < tp + tn),
b as (select *, {sql_entropy('tp', 'tn')} as whole, {sql_entropy('lp', 'ln')} as el, {sql_entropy('(tp - lp)', '(tn - ln)')} as er from s qualify row_number() over (partition by feature order by after_cut, value) = 1),
d as (select *, ln(7) - (2 * whole - ((lp > 0)::int + (ln > 0)::int) * el - ((tp > lp)::int + (tn > ln)::int) * er) as delta from b)
select feature, {sql_real('value')} as cut, {sql_real('whole - after_cut', 9)} as gain, (whole - after_cut) > (ln((tp + tn - 1)::double) + delta) / (tp + tn) as accepted from d""".replace("ln(7)", "1.9459101090932196"))
def first_information_cut(spark, folder):
    c = information.first_cut(measure(spark, folder), "feature", "value", "y")
    return c.select("feature", real("cut").alias("cut"), real("gain", 9).alias("gain"), "accepted")


@query()
def information_gain(spark, folder):
    return information.information_gain(measure(spark, folder), "feature", "value", "y")


_BINS = """binned as (select *, floor(before * 5 / total)::bigint + 1 as bin from (
 select feature, value, p, n, coalesce(sum(p + n) over (partition by feature order by value rows between unbounded preceding and 1 preceding), 0) as before, sum(p + n) over (partition by feature) as total
 from (select feature, value, sum(y)::bigint p, sum(1 - y)::bigint n from measure group by all)))"""


def sql_mi(source, keys):
    """Mutual information from (keys, bin, p, n) rows."""
    return f"""ct as (select {keys}, bin, sum(p)::double p, sum(n)::double n from {source} group by {keys}, bin),
mg as (select *, sum(p) over (partition by {keys}) ap, sum(n) over (partition by {keys}) an from ct),
mi as (select {keys}, sum(case when p > 0 then p / (ap + an) * ln(p * (ap + an) / ((p + n) * ap)) else 0 end + case when n > 0 then n / (ap + an) * ln(n * (ap + an) / ((p + n) * an)) else 0 end) as mi from mg group by {keys})"""


@query(f"with {MEASURE_SQL}, {_BINS} select feature, bin, sum(p + n)::bigint as n, {sql_real('min(value)')} as low, {sql_real('max(value)')} as high from binned group by all")
def equal_frequency_bins(spark, folder):
    b = information.equal_frequency_bins(measure(spark, folder), ["feature"], "value", 5)
    return b.groupBy("feature", F.col("bin").cast("long").alias("bin")).agg(F.sum("n").alias("n"), real(F.min("value")).alias("low"), real(F.max("value")).alias("high"))


@query(f"with {MEASURE_SQL}, {_BINS}, {sql_mi('binned', 'feature')} select feature, {sql_real('mi', 9)} as mi from mi")
def mutual_information(spark, folder):
    return rounded(information.mutual_information(measure(spark, folder), ["feature"], "value", "y"), ["feature"], ["mi"], 9)


def sql_resampled(n, seed, source="measure", tag=""):
    w = sql_poisson(sql_uniform(seed, "b", "sample"))
    return f"""wt{tag} as (select sample, b, {w} as w from (select distinct sample from {source}) cross join (select unnest(range({n})) as b)),
rs{tag} as (select feature, b, value, sum(w * y)::bigint p, sum(w * (1 - y))::bigint n from {source} join wt{tag} using (sample) where w > 0 group by all),
rb{tag} as (select feature, b, p, n, floor(coalesce(sum(p + n) over (partition by feature, b order by value rows between unbounded preceding and 1 preceding), 0) * 5 / sum(p + n) over (partition by feature, b))::bigint + 1 as bin from rs{tag}),
""" + sql_mi(f"rb{tag}", "feature, b").replace("ct as", f"ct{tag} as").replace("from ct)", f"from ct{tag})").replace("mg as", f"mg{tag} as").replace("from mg group", f"from mg{tag} group").replace("mi as (select", f"mi{tag} as (select", 1) + f""",
st{tag} as (select feature, median(mi) mi_median, avg(mi) mi_mean, stddev_samp(mi) mi_sd, avg(sel) sel_freq from (select *, (row_number() over (partition by b order by mi desc, feature) <= 100)::int sel from mi{tag}) group by 1)"""


@query(f"with {MEASURE_SQL}, {sql_resampled(100, 1)} select feature, {', '.join(sql_real(c) + ' as ' + c for c in ('mi_median', 'mi_mean', 'mi_sd', 'sel_freq'))} from st")
def information_stability(spark, folder):
    s = information.information_stability(measure(spark, folder), "sample", "feature", "value", "y", n=100, top_k=100, seed=1)
    return rounded(s, ["feature"], ["mi_median", "mi_mean", "mi_sd", "sel_freq"])


_GROUPS = ("ctrl", "case", "other")
_GROUP_MI = ", ".join(
    f"m_{g} as (select * from measure where sample % 3 = {i}), {sql_resampled(100, 1, f'm_{g}', f'_{g}')}"
    for i, g in enumerate(_GROUPS)
)
_LIMITS = ", ".join(f"lim_{g} as (select quantile_cont(mi_median, 0.8) as lim from st_{g})" for g in _GROUPS)
_HIGH = {g: f"(st_{g}.mi_median >= lim_{g}.lim and st_{g}.sel_freq >= 0.8)" for g in _GROUPS}
_H1, _H2, _H3 = (_HIGH[g] for g in _GROUPS)


@query(f"""with {MEASURE_SQL}, {_GROUP_MI}, {_LIMITS}
select feature, {', '.join(f"{sql_real(f'st_{g}.mi_median')} as mi_median_{g}, {sql_real(f'st_{g}.sel_freq')} as sel_freq_{g}" for g in _GROUPS)},
{sql_real('st_case.mi_median - st_ctrl.mi_median - st_other.mi_median')} as delta_mi_median,
case when {_H1} and {_H2} and {_H3} then 'shared' when {_H1} and not {_H2} and not {_H3} then 'only_ctrl' when {_H2} and not {_H1} and not {_H3} then 'only_case'
 when {_H3} and not {_H1} and not {_H2} then 'only_other' else 'low_or_nonspecific' end as category
from st_ctrl full join st_case using (feature) full join st_other using (feature) cross join lim_ctrl cross join lim_case cross join lim_other""")
def group_comparison(spark, folder):
    m = measure(spark, folder).withColumn("grp", F.element_at(F.array(*map(F.lit, _GROUPS)), (F.col("sample") % 3 + 1).cast("int")))
    out = progression.feature_stability(m, "sample", "feature", "value", "y", "grp", _GROUPS, ("shared", "only_ctrl", "only_case", "only_other", "low_or_nonspecific"))
    cols = [f"{c}_{g}" for g in _GROUPS for c in ("mi_median", "sel_freq")] + ["delta_mi_median"]
    return out.select("feature", *[real(c).alias(c) for c in cols], "category")


@query(f"""with {MEASURE_SQL}, {_BINS}, {sql_mi('binned', 'feature')} select case when mi < 0.05 then '<0.05' when mi < 0.1 then '0.05-0.1' when mi < 0.2 then '0.1-0.2'
 when mi < 0.3 then '0.2-0.3' when mi < 0.4 then '0.3-0.4' when mi < 0.5 then '0.4-0.5' else '>0.5' end as band, count(*) as n, {sql_real('max(mi)')} as best from mi group by 1""")
def score_bands(spark, folder):
    mi = information.mutual_information(measure(spark, folder), ["feature"], "value", "y")
    return mi.groupBy(classify.score_band(F.col("mi")).alias("band")).agg(F.count(F.lit(1)).alias("n"), real(F.max("mi")).alias("best"))


# ---- resampling ----------------------------------------------------------------------

_SUBJ_SLOPE = f"{VISITS_SQL}, {SUBJECTS_SQL}, sl as (select subject, regr_slope(score, years) as slope from visits group by 1 having var_pop(years) > 0), f as (select subject, slope, balance, carrier from sl join subjects using (subject))"


def _subject_features(spark, folder):
    s = vis.slopes(visits(spark, folder), ["subject"], "score", "years").where(F.col("slope").isNotNull()).select("subject", "slope")
    return s.join(subjects(spark, folder).select("subject", "balance", "carrier"), "subject")


_BOOT = f"""{_SUBJ_SLOPE}, bt as (select b, slope, balance, {sql_poisson(sql_uniform(1, 'b', 'subject'))} as w from f cross join (select unnest(range(2000)) as b)),
co as (select b, sum(w)::double n, sum(w * balance) sx, sum(w * slope) sy, sum(w * balance * balance) sxx, sum(w * balance * slope) sxy from bt group by 1),
be as (select b, n, (sxy - sx * sy / n) / (sxx - sx * sx / n) * 1000 as beta from co)"""


def _bootstrap(spark, folder):
    f = linmod.centered(_subject_features(spark, folder), ["slope", "balance"])
    stats = replicates.bootstrap_moments(f, REPLICATES, 1, ["subject"], ["slope", "balance"])
    return linmod.solve_moments(stats, ["b"], "slope", ["balance"]).where("term = 'balance'")


@query(f"with {_BOOT} select b, n::bigint as n, {sql_real('beta')} as beta from be")
def bootstrap_slopes(spark, folder):
    return _bootstrap(spark, folder).select(F.col("b").cast("long").alias("b"), F.col("n").cast("long").alias("n"), real(F.col("estimate") * 1000).alias("beta"))


@query(f"with {_BOOT} select count(*) as n_replicates, {sql_real('quantile_cont(beta, 0.025)')} as low, {sql_real('median(beta)')} as median, {sql_real('quantile_cont(beta, 0.975)')} as high, {sql_real('avg((beta > 0)::int)')} as share_above from be")
def bootstrap_interval(spark, folder):
    b = _bootstrap(spark, folder).withColumn("beta", F.col("estimate") * 1000)
    return rounded(resample.bootstrap_interval(b, [], "beta"), ["n_replicates"], ["low", "median", "high", "share_above"])


@query(f"""with {_SUBJ_SLOPE}, pos as (select row_number() over (order by subject) - 1 as i, slope, balance from f), {sql_permuted(3, 2000, 'pos')},
be as (select b, regr_slope(o.slope, p.balance) * 1000 as beta from sent join pos p on p.i = sent.i join pos o on o.i = sent.at group by b), ob as (select regr_slope(slope, balance) * 1000 as o from f)
select {sql_real('any_value(o)')} as observed, count(*) as n_permutations, {sql_real('avg((abs(beta) >= abs(o))::int)')} as p_value, {sql_real('sum(beta)', 5)} as total from be cross join ob""")
def permutation_test(spark, folder):
    f = _subject_features(spark, folder)
    stats = replicates.permuted_moments(linmod.centered(f, ["slope", "balance"]), REPLICATES, 3, ["subject"], "slope", ["balance"])
    per_b = vis.slopes_of_moments(stats, ["b"], "slope", "balance").withColumn("beta", F.col("slope") * 1000)
    p = resample.permutation_p(vis.slopes(f, [], "slope", "balance").withColumn("beta", F.col("slope") * 1000), per_b, [], "beta")
    total = per_b.agg(real(F.sum("beta"), 5).alias("total"))
    return p.crossJoin(total).select(real("observed").alias("observed"), "n_permutations", real("p_value").alias("p_value"), "total")


@query(f"""with {SUBJECTS_SQL}, d as (select subject, (balance > 4500)::int as hit, carrier from subjects),
r as (select b, hit, carrier, {sql_poisson(sql_uniform(2, 'b', 'subject'))} as w from d cross join (select unnest(range(2000)) as b)),
c as (select b, sum(case when hit = 1 and carrier = 1 then w else 0 end)::double a, sum(case when hit = 0 and carrier = 1 then w else 0 end)::double e, sum(case when hit = 1 and carrier = 0 then w else 0 end)::double c, sum(case when hit = 0 and carrier = 0 then w else 0 end)::double f from r group by b)
select b, {sql_real('ln(a * f / (e * c))', 5)} as estimate, {sql_real('sqrt(1 / a + 1 / e + 1 / c + 1 / f)', 5)} as std_error from c""")
def logistic_bootstrap(spark, folder):
    s = subjects(spark, folder).select("subject", "carrier", (F.col("balance") > 4500).cast("int").alias("hit"))
    counted = replicates.bootstrap_sums(s, REPLICATES, 2, ["subject"], {}, ["hit", "carrier"])
    f = linmod.fit_logistic(counted, ["b"], "hit", ["carrier"], weight="n").where("term = 'carrier'")
    return rounded(f, [F.col("b").cast("long").alias("b")], ["estimate", "std_error"], 5)


_SPLIT_SRC = "lab as (select vec_id, (label < 3)::int as y from embeddings)"


def _labelled(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", (F.col("label") < 3).cast("int").alias("y"))


@query(f"""with {_SPLIT_SRC} select vec_id, y::bigint as y, (row_number() over (partition by y order by {sql_digest(42, '0', 'vec_id')}, vec_id) <= ceil(0.7 * count(*) over (partition by y)))::int::bigint as is_train from lab""")
def stratified_split(spark, folder):
    s = resample.stratified_split(_labelled(spark, folder), "y", ["vec_id"], 0.7, 42)
    return s.select("vec_id", F.col("y").cast("long").alias("y"), F.col("is_train").cast("long").alias("is_train"))


@query(f"""with {_SPLIT_SRC} select vec_id, r as repeat, ((row_number() over (partition by r, y order by {sql_digest(42, 'r', 'vec_id')}, vec_id) - 1) % 5)::bigint as fold from lab cross join (select unnest(range(5)) as r)""")
def repeated_folds(spark, folder):
    f = resample.stratified_folds(_labelled(spark, folder), "y", ["vec_id"], 5, 5, 42)
    return f.select("vec_id", F.col("repeat").cast("long").alias("repeat"), F.col("fold").cast("long").alias("fold"))


@query(f"""with {_SPLIT_SRC}, n as (select y, count(*) as n, max(count(*)) over () as m from lab group by y),
k as (select vec_id, y, m // n + (row_number() over (partition by y order by {sql_digest(42, '0', 'vec_id')}, vec_id) <= m % n)::int as copies from lab join n using (y))
select vec_id, y::bigint as y, copies::bigint as n_copies from k""")
def minority_upsampling(spark, folder):
    u = resample.upsample(_labelled(spark, folder), [], "y", ["vec_id"], 42)
    return u.groupBy("vec_id", F.col("y").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n_copies"))


_KNN = """mino as (select vec_id, embedding::double[] as v from embeddings where label = 5),
dst as (select a.vec_id, b.vec_id as neighbour, list_distance(a.v, b.v) as distance from mino a join mino b on a.vec_id <> b.vec_id),
knn as (select *, row_number() over (partition by vec_id order by distance, neighbour) as rank from dst qualify rank <= 5)"""


def _minority(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") == 5).cast("int").alias("y"))


@query(f"with {_KNN} select vec_id, neighbour, rank, {sql_real('distance')} as distance from knn")
def nearest_neighbours(spark, folder):
    n = neighbours.exact_neighbours(_minority(spark, folder).where("y = 1"), "vec_id", "v", 5)
    return n.select("vec_id", "neighbour", F.col("rank").cast("long").alias("rank"), real("distance").alias("distance"))


@query(f"with {_KNN.replace(' where label = 5', '')} select vec_id, neighbour, rank, {sql_real('distance')} as distance from knn")
def nearest_neighbours_all(spark, folder):
    n = neighbours.exact_neighbours(_minority(spark, folder), "vec_id", "v", 5)
    return n.select("vec_id", "neighbour", F.col("rank").cast("long").alias("rank"), real("distance").alias("distance"))


_U = [f"(('0x' || substr(d, {1 + 8 * s}, 8))::ubigint / 4294967296.0::double)" for s in (0, 1)]


@query(f"""with {_KNN}, sz as (select floor((count(*) - 2 * count_if(label = 5)) / count_if(label = 5))::bigint as copies from embeddings),
pick as (select vec_id, synthetic, floor({_U[0]} * 5)::bigint + 1 as rank, {_U[1]} as gap from (select vec_id, s as synthetic, {sql_digest(7, 's', 'vec_id')} as d from mino cross join (select unnest(range(1, copies + 1)) as s from sz)))
select p.vec_id, p.synthetic, k.neighbour, {sql_real('gap')} as gap, {sql_real('a.v[1] + gap * (b.v[1] - a.v[1])')} as v1, {sql_real('a.v[64] + gap * (b.v[64] - a.v[64])')} as v64
from pick p join knn k using (vec_id, rank) join mino a on a.vec_id = p.vec_id join mino b on b.vec_id = k.neighbour""")
def minority_synthesis(spark, folder):
    s = resample.smote(_minority(spark, folder), "vec_id", "v", "y", 5, 7)
    return s.select("vec_id", F.col("synthetic").cast("long").alias("synthetic"), "neighbour", real("gap").alias("gap"),
                    real(F.col("v")[0]).alias("v1"), real(F.col("v")[63]).alias("v64"))


@query(f"""with {_SUBJ_SLOPE}, x as (select b, subject, slope, carrier, {sql_poisson(sql_uniform(5, 'b', 'subject'))} as w from f cross join (select unnest(range(1000)) as b)),
m as (select b, subject % 9 as block, sum(w)::double n, sum(w * carrier) sx, sum(w * slope) sy, sum(w * carrier * carrier) sxx, sum(w * carrier * slope) sxy from x group by all),
e as (select b, block, abs((sxy - sx * sy / n) / (sxx - sx * sx / n)) as eff from m), k as (select *, row_number() over (partition by b order by eff desc, block) <= 3 as hit from e)
select block, {sql_real('avg(hit::int)')} as sel_freq from k group by 1""")
def selection_frequency(spark, folder):
    f = linmod.centered(_subject_features(spark, folder).withColumn("block", F.col("subject") % 9), ["slope"])
    fits = linmod.solve_moments(replicates.bootstrap_moments(f, 1000, 5, ["subject"], ["slope", "carrier"], ["block"]), ["block", "b"], "slope", ["carrier"])
    effects = fits.where("term = 'carrier'").withColumn("eff", F.abs("estimate"))
    top = information.top_per_replicate(effects, "b", "block", "eff", 3)
    return rounded(information.selection_frequency(top, "block"), ["block"], ["sel_freq"])


# ---- evaluation and components ---------------------------------------------------------

_SCORED = "sc as (select quality as y, n_chars as s from labels join documents using (doc_id)), md as (select quantile_cont(s, 0.5) as m from sc)"


def _scored(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "n_chars", "source")
    return table(spark, folder, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("s"), "source")


@query(f"""with {_SCORED}, c as (select count_if(y = 1 and s >= m) tp, count_if(y = 1 and s < m) fn, count_if(y = 0 and s < m) tn, count_if(y = 0 and s >= m) fp from sc cross join md)
select tp::bigint as tp, fn::bigint as fn, tn::bigint as tn, fp::bigint as fp, {sql_real('tp / (tp + fn)')} as sensitivity, {sql_real('tn / (tn + fp)')} as specificity, {sql_real('tp / (tp + fp)')} as ppv, {sql_real('tn / (tn + fn)')} as npv from c""")
def confusion_metrics(spark, folder):
    s = _scored(spark, folder)
    m = ranks.exact_quantiles(s, [], "s", {"m": 0.5})
    pred = s.crossJoin(F.broadcast(m)).withColumn("predicted", (F.col("s") >= F.col("m")).cast("int"))
    return rounded(classify.confusion(pred, [], "y", "predicted"), ["tp", "fn", "tn", "fp"], ["sensitivity", "specificity", "ppv", "npv"])


@query(f"""with {_SCORED}, c as (select s, sum(y)::double p, sum(1 - y)::double n from sc group by 1), k as (select p, n, sum(n) over (order by s) - n as before from c)
select sum(p)::bigint as n_pos, sum(n)::bigint as n_neg, {sql_real('sum(p * (before + n / 2)) / (sum(p) * sum(n))', 9)} as auc from k""")
def roc_auc(spark, folder):
    return rounded(ranks.rank_auc(_scored(spark, folder), [], "s", "y"), ["n_pos", "n_neg"], ["auc"], 9)


@query(f"""with sc as (select doc_id % 5 as fold, quality as y, n_chars as s from labels join documents using (doc_id)),
c as (select fold, s, sum(y)::double p, sum(1 - y)::double n from sc group by all), k as (select fold, p, n, sum(n) over (partition by fold order by s) - n as before from c),
a as (select fold, sum(p * (before + n / 2)) / (sum(p) * sum(n)) as auc from k group by 1)
select {sql_real('avg(auc)')} as auc_mean, {sql_real('stddev_samp(auc)')} as auc_sd, count(*) as n_folds from a""")
def fold_auc_summary(spark, folder):
    s = _scored(spark, folder).withColumn("fold", F.col("doc_id") % 5)
    return rounded(classify.auc_summary(ranks.rank_auc(s, ["fold"], "s", "y")), ["n_folds"], ["auc_mean", "auc_sd"])


@query(f"""with {COUNTS_SQL}, t as (select feature, sum(value) as v from counts group by 1), r as (select min(v) lo, max(v) hi from t) select feature, {sql_real('(v - lo) / (hi - lo) * 100')} as importance from t cross join r""")
def importance_scaling(spark, folder):
    t = counts(spark, folder).groupBy("feature").agg(F.sum("value").alias("v"))
    return rounded(classify.scale_0_100(t, "v", "importance"), ["feature"], ["importance"])


_TWO = f"""{MEASURE_SQL}, w as (select sample, any_value(y) y, any_value(visit) visit, max(case when position = 0 then value end) a, max(case when position = 1 then value end) b from measure group by 1)"""


@query(f"""with {_TWO}, s as (select avg(a) ma, avg(b) mb, stddev_samp(a) sa, stddev_samp(b) sb, sign(corr(a, b)) r from w),
p as (select sample, y, ((a - ma) / sa + r * (b - mb) / sb) / sqrt(2) as pc from w cross join s), d as (select case when avg(pc) filter (y = 1) < avg(pc) filter (y = 0) then -1 else 1 end as f from p)
select sample, {sql_real('pc * f')} as pc1 from p cross join d""")
def first_component(spark, folder):
    w = wide_measure(spark, folder, 2)
    scored = pca.project(pca.fit_components(w, "features"), w, "features")
    return rounded(pca.orient_by_group(scored, "pc1", "y"), ["sample"], ["pc1"])


@query(f"""with {_TWO}, s as (select avg(a) ma, avg(b) mb, stddev_samp(a) sa, stddev_samp(b) sb, sign(corr(a, b)) r from w where visit = 1),
p as (select sample, y, visit, ((a - ma) / sa + r * (b - mb) / sb) / sqrt(2) as pc from w cross join s), d as (select case when avg(pc) filter (y = 1) < avg(pc) filter (y = 0) then -1 else 1 end as f from p)
select sample, visit::bigint as visit, {sql_real('pc * f')} as pc1 from p cross join d""")
def baseline_component_projection(spark, folder):
    w = wide_measure(spark, folder, 2)
    scored = pca.project(pca.fit_components(w.where("visit = 1"), "features"), w, "features")
    out = pca.orient_by_group(scored, "pc1", "y")
    return out.select("sample", F.col("visit").cast("long").alias("visit"), real("pc1").alias("pc1"))


@query()
def first_component_all(spark, folder):
    w = wide_measure(spark, folder)
    scored = pca.project(pca.fit_components(w, "features"), w, "features")
    return rounded(pca.orient_by_group(scored, "pc1", "y"), ["sample"], ["pc1"])


@query()
def baseline_component_projection_all(spark, folder):
    w = wide_measure(spark, folder)
    scored = pca.project(pca.fit_components(w.where("visit = 1"), "features"), w, "features")
    out = pca.orient_by_group(scored, "pc1", "y")
    return out.select("sample", F.col("visit").cast("long").alias("visit"), real("pc1").alias("pc1"))


@query(f"""with {SUBJECTS_SQL}, t as (select subject, balance, site, case when covar_pop(balance, site) over () * -1 < 0 then -balance else balance end as v from subjects) select subject, {sql_real('v', 2)} as balance from t""")
def score_orientation(spark, folder):
    return rounded(pca.orient_by_outcome(subjects(spark, folder), "balance", "site"), ["subject"], ["balance"], 2)


# ---- range joins -------------------------------------------------------------------------

@query("""select a.event_id as error_id, b.event_id as view_id from events a join events b on a.user_id = b.user_id and a.event_type = 'error' and b.event_type = 'view'
and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000""")
def events_nearby(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    left = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("at").alias("a"), F.col("at").alias("z"))
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("at").alias("p"))
    return intervals.near_join(left, right, "user_id", "a", "z", "p", 3600e6).select("error_id", "view_id")


@query(f"""with l as (select event_id, user_id, epoch_us(ts) t from events where event_type = 'purchase'), r as (select event_id as other, user_id, epoch_us(ts) t from events where event_type = 'view'),
j as (select l.event_id, r.other, abs(l.t - r.t) as gap from l join r using (user_id))
select l.event_id, other as nearest, {sql_real('gap / 1e6', 3)} as seconds from l left join (select * from j qualify row_number() over (partition by event_id order by gap, other) = 1) b on b.event_id = l.event_id""")
def nearest_event(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("at").alias("a"), F.col("at").alias("z"))
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("nearest"), F.col("at").alias("p"))
    n = intervals.nearest_point(left, right, "user_id", "event_id", "a", "z", "p", "nearest")
    return n.select("event_id", "nearest", real(F.col("distance") / 1e6, 3).alias("seconds"))


@query(f"with {_SPLIT_SRC} select vec_id, {sql_real(sql_uniform(11, 'vec_id % 9', 'vec_id'), 9)} as u, {sql_poisson(sql_uniform(11, 'vec_id % 9', 'vec_id'))}::bigint as w from lab")
def repeatable_draws(spark, folder):
    replicate = F.col("vec_id") % 9
    u = draws.uniform(11, replicate, F.col("vec_id"))
    word = F.element_at(draws.words(draws.digest(11, F.floor(replicate / 4), F.col("vec_id"))), (replicate % 4 + 1).cast("int"))
    return _labelled(spark, folder).select("vec_id", real(u, 9).alias("u"), draws.poisson_weight(word).cast("long").alias("w"))
