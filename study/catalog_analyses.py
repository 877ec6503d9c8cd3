"""Queries: whole analyses on study views of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import scalars
from cohortloom.operators import classify, information, tables, visits as vis
from cohortloom.plans import cohort, markers, progression
from study.catalog_tables import _GENO, genotypes
from study.registry import query
from study.views import MEASURE_SQL, counts, measure, real, sql_real, subjects, table, visits, wide_measure

SMALL_FOREST = dict(grid=("sqrt",), folds=2, repeats=1, n_trees=10, balance=("up",))


# ---- participants ----------------------------------------------------------------

@query(f"""with {_GENO} select c_custkey as participant, 'S' || p_partkey as sample_id, c_mktsegment as grp, {sql_real('c_acctbal', 2)} as age, call as variant,
(coalesce(call, '') in ('24', '34', '44'))::int::bigint as carrier from calls join customer on c_custkey = p_partkey""")
def carrier_table(spark, folder):
    g = genotypes(spark, folder).withColumn("sample_id", F.concat(F.lit("S"), F.col("p_partkey").cast("string")))
    c = table(spark, folder, "customer")
    people = c.select(F.col("c_custkey").alias("participant"), F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("sample_id"), F.col("c_mktsegment").alias("grp"))
    ages = c.select(F.col("c_custkey").alias("participant"), real("c_acctbal", 2).alias("age"))
    out = cohort.carrier_table(g.select("sample_id", F.col("g1").alias("genotype")), g.select("sample_id", F.col("g2").alias("genotype")), people, ages)
    return out.select("participant", "sample_id", "grp", "age", "variant", F.col("carrier").cast("long").alias("carrier"))


@query(f"""with base as (select c_custkey as participant, c_nationkey as k from customer),
env as (select participant, {sql_real("coalesce(nullif(k % 4, 3), 2) * case when k % 5 = 0 then 0 when k % 5 = 1 then null else k end", 2)} as concus, (k % 2)::bigint as smokerb, k from base),
placed as (select participant, concus, smokerb, n_nationkey::bigint as ruca from env join nation on n_nationkey = k where k % 6 <> 5),
vit as (select o_custkey as participant, {sql_real('any_value(o_totalprice)', 2)} as bmi from orders group by 1 having count(*) = 1),
fam as (select user_id as participant, (count_if(event_type = 'click') > 0)::int + (count_if(event_type = 'view') > 0)::int + (count_if(event_type = 'error') > 0)::int > 1 as h from events group by 1)
select participant, (case when k = 2 then 0 else k end)::bigint as code_a, (case when k + 66 = 90 then null else k + 66 end)::bigint as code_b, concus, smokerb, ruca,
((k % 3 = 1)::int + (k % 7 = 1)::int > 0)::int::bigint as general_mut, bmi, h::int::bigint as history_tot
from base left join placed using (participant) left join vit using (participant) left join fam using (participant)""")
def clinical_covariates(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("participant"), F.col("c_nationkey").alias("k"))
    k = F.col("k")
    diagnosis = c.select("participant", k.alias("code_a"), (k + 66).alias("code_b"))
    town = F.when(k % 6 == 5, F.lit("Nowhere")).otherwise(F.concat(F.lit("NATION_"), k.cast("string")))
    answers = c.select(
        "participant", F.lit(1).alias("form"), F.nullif(k % 4, F.lit(3)).alias("concussrb"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "often").otherwise(k.cast("string")).alias("concusstb"),
        F.lit("1").alias("driavgtb"), F.lit("").alias("drinktb"), town.alias("city1"), F.lit("Ohio").alias("state1"), (k % 2).cast("long").alias("smokerb"))
    later = answers.withColumn("form", F.lit(2)).withColumn("concusstb", F.lit("99"))
    nations = table(spark, folder, "nation").select("n_name", F.lit("OH").alias("st"), F.col("n_nationkey").cast("long").alias("ruca"), F.lit(1).alias("place_no"))
    places = cohort.place_scores(nations, "n_name", "st", "ruca", ["place_no"])
    answers = answers.unionByName(later).withColumn("subject", F.col("participant"))
    env = cohort.environment_table(answers, places, "participant", "subject", ["form"], ["smokerb"])
    mutations = c.select("participant", F.when(k % 3 == 1, 1).otherwise(2).alias("ang"), F.when(k % 7 == 1, 1).otherwise(0).alias("vcp"))
    one = tables.keep_repeated(table(spark, folder, "orders").select("o_custkey", "o_totalprice"), "o_custkey", 2).select("o_custkey").distinct()
    single = table(spark, folder, "orders").join(one, "o_custkey", "left_anti")
    vitals = cohort.vital_signs(single.select(F.col("o_custkey").alias("participant"), F.lit(0).alias("day"), F.col("o_totalprice").cast("string").alias("bmi")), "participant", "day", ["bmi"])
    kind = lambda t: F.max((F.col("event_type") == t).cast("int")).alias(t)
    family = cohort.family_history(table(spark, folder, "events").groupBy(F.col("user_id").alias("participant")).agg(kind("click"), kind("view"), kind("error")).withColumn("row", F.lit(1)),
                                   "participant", ["click", "view", "error"], ["row"])
    out = cohort.clinical_covariates(diagnosis, ["code_a", "code_b"], [env, cohort.mutation_flag(mutations, "participant", ["ang", "vcp"]), vitals, family], "participant")
    whole = lambda n: F.col(n).cast("long").alias(n)
    return out.select("participant", whole("code_a"), whole("code_b"), real("concus", 2).alias("concus"), "smokerb", "ruca", whole("general_mut"), real("bmi", 2).alias("bmi"), whole("history_tot"))


# ---- markers and classifiers ---------------------------------------------------------

def _grouped_measure(spark, folder):
    names = F.element_at(F.array(*map(F.lit, ("control", "case", "other"))), (F.col("sample") % 3 + 1).cast("int"))
    return measure(spark, folder).withColumn("grp", names)


@query()
def marker_table(spark, folder):
    m = measure(spark, folder)
    names = m.select("feature").distinct().withColumn("name", F.concat(F.lit("target "), "feature"))
    return markers.marker_table(m, "feature", "value", "y", names)


@query()
def transfer_classifier_metrics(spark, folder):
    out = markers.transfer_classifier(_grouped_measure(spark, folder), "sample", "feature", "value", "y", "grp", "control", ["case", "other"],
                                      **{**SMALL_FOREST, "balance": ("smote", "up")})
    return out["metrics"]


@query()
def forest_importance(spark, folder):
    w = wide_measure(spark, folder)
    model = classify.forest(20).fit(classify.with_vector(w))
    return classify.scale_0_100(classify.importance_table(model, [f"f{i:02d}" for i in range(64)], spark), "raw", "importance")


def _suppliers(spark, folder):
    k = F.col("s_nationkey")
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("sample"), (k % 4 == 0).cast("int").alias("y"), (F.col("s_suppkey") % 3).cast("int").alias("batch"),
        (k % 2).cast("int").alias("sex"), (F.col("s_acctbal") / 1000).alias("age"))


@query()
def differential_counts(spark, folder):
    return markers.omics_differential(counts(spark, folder), "sample", "feature", "value", _suppliers(spark, folder), "y", "batch", ["sex", "age"],
                                      "counts", adjust_values=False)


@query()
def differential_intensities(spark, folder):
    return markers.omics_differential(counts(spark, folder), "sample", "feature", "value", _suppliers(spark, folder), "y", "batch", ["sex", "age"], "intensity")


@query()
def omics_classifier_metrics(spark, folder):
    m = measure(spark, folder).withColumn("raw", F.pow(F.lit(2.0), F.col("value")) * 4)
    samples = m.select("sample", "y", "batch").distinct().withColumn("age", (F.col("sample") % 50).cast("double"))
    prepared, _ = markers.prepare_matrix(m.select("sample", "feature", "raw"), "sample", "feature", "raw", samples, "batch", ["age"], "intensity")
    return markers.omics_classifier(prepared, "sample", "feature", "y", **SMALL_FOREST)["metrics"]


@query()
def marker_score_models(spark, folder):
    w = wide_measure(spark, folder).withColumn("grp", (F.col("sample") % 2).cast("string")).withColumn("age", (F.col("sample") % 50).cast("double"))
    return markers.marker_score_by_group(w, "sample", "features", "y", "grp", ["0", "1"], ["age"])["models"]


@query()
def marker_score_over_time(spark, folder):
    w = wide_measure(spark, folder).withColumn("subject", F.col("sample") % 97).withColumn("years", F.col("visit") / 2.0)
    return markers.score_over_time(w, "subject", "features", "years", "y").table(spark)


# ---- progression -----------------------------------------------------------------------

def order_features(spark, folder):
    """Features of a visit: the price of each line position of the order."""
    v = visits(spark, folder).select("subject", "visit", "years", "score", "record")
    li = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("record"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("feature")).agg(
        F.sum("l_extendedprice").alias("value"))
    return v, li.join(v.select("subject", "visit", "record"), "record").select("subject", "visit", "feature", "value")


def _progression(spark, folder):
    series, measures = order_features(spark, folder)
    people = subjects(spark, folder).select("subject", "carrier", "balance")
    return progression.progression_association(series, measures, people, "subject", "score", "years", "feature", "value", "carrier")


@query(f"""with v as (select o_custkey as subject, o_orderkey as record, date_diff('day', min(o_orderdate) over (partition by o_custkey)::date, o_orderdate::date) / 365.25::double as years, count(*) over (partition by o_custkey) as n from orders),
m as (select l_orderkey as record, 'line' || l_linenumber as feature, log2(sum(l_extendedprice)) as value from lineitem group by all),
j as (select subject, feature, years, value from m join v using (record) where n >= 2)
select subject, feature, {sql_real('arg_min(value, (years, value))', 5)} as baseline, {sql_real('case when var_pop(years) > 0 then regr_slope(value, years) end', 5)} as slope from j group by all""")
def feature_slopes(spark, folder):
    series, measures = order_features(spark, folder)
    timed = measures.join(series.select("subject", "visit", "years"), ["subject", "visit"]).withColumn("value", scalars.safe_log2(F.col("value")))
    s = progression.feature_slopes(timed, "subject", "feature", "value", "years")
    return s.select("subject", "feature", real("baseline", 5).alias("baseline"), real("feature_slope", 5).alias("slope"))


@query()
def progression_associations(spark, folder):
    return _progression(spark, folder)["associations"]


@query()
def progression_interactions(spark, folder):
    return _progression(spark, folder)["interactions"]


@query()
def progression_score_model(spark, folder):
    features = _progression(spark, folder)["features"]
    return progression.progression_score(features, "subject", "feature", ["line1", "line2", "line3"], "slope_dev", ["carrier", "balance"])["model"]


def _subject_table(spark, folder):
    s = vis.slopes(visits(spark, folder), ["subject"], "score", "years").where("slope is not null").select("subject", "slope")
    return s.join(subjects(spark, folder).select("subject", "carrier", (F.col("balance") / 1000).alias("pc1")), "subject")


@query()
def robustness_intervals(spark, folder):
    return progression.robustness_checks(_subject_table(spark, folder), "subject", "slope", "pc1", ["carrier"])["intervals"]


@query()
def robustness_permutations(spark, folder):
    return progression.robustness_checks(_subject_table(spark, folder), "subject", "slope", "pc1", ["carrier"])["permutations"]


@query()
def hit_frequency(spark, folder):
    series, measures = order_features(spark, folder)
    timed = measures.join(series.select("subject", "visit", "years"), ["subject", "visit"]).withColumn("value", scalars.safe_log2(F.col("value")))
    slopes = progression.feature_slopes(timed, "subject", "feature", "value", "years").where("feature_slope is not null")
    joined = slopes.join(_subject_table(spark, folder).select("subject", "slope"), "subject")
    return progression.hit_frequency(joined, "subject", "feature", "feature_slope", "slope")


@query(f"""with {MEASURE_SQL}, e as (select feature, visit, avg(case when y = 1 then value end) - avg(case when y = 0 then value end) as est from measure group by all),
s as (select feature, greatest(avg((est > 0)::int), avg((est < 0)::int)) as share from e where est is not null group by 1)
select count(*) as n_features, count_if(share = 1) as n_all_same, count_if(share >= 0.8) as n_mostly_same from s""")
def effect_stability_summary(spark, folder):
    return progression.effect_stability(measure(spark, folder), "feature", "value", "y", "visit", [1, 2, 3, 4, 5])["consistent"]


@query()
def auc_by_score_band(spark, folder):
    m = measure(spark, folder)
    scores = information.mutual_information(m, ["feature"], "value", "y")
    return markers.auc_by_band(m, scores, "sample", "feature", "value", "y", grid=("sqrt",), folds=2, repeats=1, n_trees=10)
