"""Study concepts on the test tables, once in Spark and once as SQL text.

The test tables carry little signal of their own, so several views add a fixed
formula; both engines compute the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortloom.functions.draws import poisson_thresholds
from cohortloom.operators.visits import visit_series


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def real(column: Column | str, digits: int = 6) -> Column:
    """Rounded double; the sum removes a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def sql_real(expression: str, digits: int = 6) -> str:
    return f"(round(({expression})::double, {digits}) + 0.0)"


# ---- visits and scores -----------------------------------------------------

def visits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: subject, day since first order, order id, visit number, years, score."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("date"),
        F.col("o_orderkey").alias("record"), F.col("o_totalprice").alias("price"))
    numbered = visit_series(orders, "subject", "date", ["record"])
    return numbered.withColumn("score", score("subject", "price", "years"))


def score(subject: str, price: str, years: str) -> Column:
    s = F.col(subject)
    return F.col(price) / 1000 + 40 * (s % 17) + 8 * ((s % 5) - 2) * F.col(years)


VISITS_SQL = """
dated as (
  select o_custkey as subject, o_orderkey as record, o_totalprice as price,
         date_diff('day', min(o_orderdate) over (partition by o_custkey)::date, o_orderdate::date) as day,
         count(*) over (partition by o_custkey) as n_rows
  from orders),
visits as (
  select subject, record, price, day,
         row_number() over (partition by subject order by day, record) as visit,
         day / 365.25::double as years,
         price / 1000 + 40 * (subject % 17) + 8 * ((subject % 5) - 2) * (day / 365.25::double) as score
  from dated where n_rows >= 2)
"""


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("grp"),
        F.col("c_nationkey").alias("site"), (F.col("c_nationkey") % 4 == 0).cast("int").alias("carrier"),
        F.col("c_acctbal").alias("balance"))


SUBJECTS_SQL = """
subjects as (
  select c_custkey as subject, c_mktsegment as grp, c_nationkey as site,
         (c_nationkey % 4 = 0)::int as carrier, c_acctbal as balance from customer)
"""


# ---- feature tables ----------------------------------------------------------

def measure(spark: SparkSession, folder: str) -> DataFrame:
    """Long feature table: sample, position, feature, value, y, batch, visit."""
    e = table(spark, folder, "embeddings")
    rows = e.select(F.col("vec_id").alias("sample"), "label", F.posexplode("embedding").alias("position", "raw"))
    y = (F.col("label") < 3).cast("int")
    shift = F.when(F.col("position") < 8, F.lit(0.12) * y).otherwise(F.lit(0.0))
    return rows.select(
        "sample", "position", F.concat(F.lit("f"), F.lpad(F.col("position").cast("string"), 2, "0")).alias("feature"),
        (F.col("raw").cast("double") + shift).alias("value"), y.alias("y"), "label",
        (F.col("sample") % 4).cast("int").alias("batch"), (F.col("sample") % 5 + 1).cast("int").alias("visit"))


MEASURE_SQL = """
measure as (
  select vec_id as sample, position - 1 as position, 'f' || lpad((position - 1)::varchar, 2, '0') as feature,
         raw::double + case when position <= 8 then 0.12::double * (label < 3)::int else 0 end as value,
         (label < 3)::int as y, label, (vec_id % 4)::int as batch, (vec_id % 5 + 1)::int as visit
  from (select vec_id, label, unnest(embedding) as raw, generate_subscripts(embedding, 1) as position from embeddings))
"""


def wide_measure(spark: SparkSession, folder: str, n_features: int | None = None) -> DataFrame:
    """One row per sample with the measured values as an array; no shuffle."""
    e = table(spark, folder, "embeddings")
    y = (F.col("label") < 3).cast("int")
    values = F.transform("embedding", lambda v, i: v.cast("double") + F.when(i < 8, F.lit(0.12) * y).otherwise(F.lit(0.0)))
    if n_features:
        values = F.slice(values, 1, n_features)
    return e.select(F.col("vec_id").alias("sample"), "label", y.alias("y"),
                    (F.col("vec_id") % 5 + 1).cast("int").alias("visit"), values.alias("features"))


def counts(spark: SparkSession, folder: str, by: str = "p_brand") -> DataFrame:
    """Count matrix in long form: sample = supplier, feature = brand (or part), value."""
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    if by == "p_partkey":
        named = items.withColumn("feature", F.col("l_partkey").cast("string"))
    else:
        parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(by).alias("feature"))
        # sums per (supplier, part) first: the join then carries one row each
        items = items.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("l_quantity"))
        named = items.join(parts, "l_partkey")
    return named.groupBy(F.col("l_suppkey").alias("sample"), "feature").agg(F.sum("l_quantity").alias("value"))


COUNTS_SQL = """
counts as (
  select l_suppkey as sample, p_brand as feature, sum(l_quantity) as value
  from lineitem join part on p_partkey = l_partkey group by all)
"""
COUNTS_SPARSE_SQL = """
counts as (
  select l_suppkey as sample, l_partkey::varchar as feature, sum(l_quantity) as value
  from lineitem group by all)
"""


# ---- draws -----------------------------------------------------------------

def sql_uniform(seed: int, replicate: str, key: str) -> str:
    """SQL text of the library's uniform draw."""
    digest = f"md5('{seed}|' || (({replicate}) // 4)::varchar || '|' || ({key})::varchar)"
    return f"(('0x' || substr({digest}, (1 + 8 * (({replicate}) % 4))::int, 8))::ubigint / 4294967296.0::double)"


def sql_digest(seed: int, block: str, key: str) -> str:
    return f"md5('{seed}|' || ({block})::varchar || '|' || ({key})::varchar)"


def sql_poisson(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {t!r})::int" for t in poisson_thresholds()) + ")"


def sql_permuted(seed: int, replicates: int, source: str) -> str:
    """CTEs that end in ``sent`` (b, i, at): the library's keyed bijection of the places 0 .. n - 1 of ``source``."""
    from cohortloom.functions.draws import ROUNDS

    word = lambda r: f"('0x' || substr(md5('{seed}|' || (b * 2 + {r // 4})::varchar), {1 + 8 * (r % 4)}, 8))::ubigint::bigint"
    scrambled = lambda v, r: f"((((({v} + k{r}) % 2147483647) * 48271) % 2147483647))"
    steps, last = [], "l0, r0"
    turn = ""
    for r in range(ROUNDS):
        moved, other = ("l", "r") if r % 2 == 0 else ("r", "l")
        first = scrambled(f"{other}{r}", r)
        side = "a" if r % 2 == 0 else "c"
        new = f"({moved}{r} + (xor({first}, {first} >> 15) * 69621) % 2147483647) % {side}"
        turn += f", ({new}) as {moved}{r + 1}, {other}{r} as {other}{r + 1}"
    return f"""size as (select count(*)::bigint as n from {source}),
box as (select n, a, (n + a - 1) // a as c from size, (select unnest(range(1, 200001))::bigint as a) where a between greatest(1, floor(sqrt(n))::bigint) and 2 * floor(sqrt(n))::bigint + 1
 qualify row_number() over (order by a * ((n + a - 1) // a) - n, a) = 1),
keys as (select b, {', '.join(f'{word(r)} as k{r}' for r in range(ROUNDS))} from (select unnest(range({replicates})) as b)),
sent as (with recursive walk as (
 select b, i, i as x, 0 as step from {source}, keys
 union all
 select b, i, l{ROUNDS} * c + r{ROUNDS} as x, step + 1 from (
  select *{turn} from (select w.b, w.i, w.step, n, a, c, {', '.join(f'k{r}' for r in range(ROUNDS))}, w.x // c as l0, w.x % c as r0
   from walk w join keys on keys.b = w.b, box where w.step = 0 or w.x >= n)))
 select b, i, x as at from walk, size where step > 0 and x < n)"""
