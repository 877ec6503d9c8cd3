"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host and shrunk level by level: all
pages give the prior of a suffix (``org``), a suffix that of a registered domain
(``example.org``), a domain that of a host.  A host is blocked when the lower
posterior bound of its rate of bad pages exceeds ``max_bad``.

Rules are (verdict, host, path) triples.  A rule fits its host and all its
subdomains if the url's path starts with the rule's path; the longest fits first.

Defined cases: a NULL url, or one without ``://``, has host and path ``''``, fits
no rule and is judged by the reputation of the empty host; repeated rows are
judged alike; pages without label count as no evidence; no labels at all means
that every prior rate is 0 and nothing is blocked by reputation; an empty table
gives an empty result.  Of repeated labels of one page the worst counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.llm.beta_prior import lower_bound, shrink
from cohortloom.llm.common import ascii_lower, join_small
from cohortloom.storage import materialize

#: Fixed rules of the contract.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Suffixes of two labels; a parameter, not a public list.
LONG_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    full = F.coalesce(url, F.lit(""))
    at = F.instr(full, "://")
    rest = F.when(at > 0, F.substring(full, at + 3, F.char_length(full))).otherwise(F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)),
            F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; NULL if none does."""
    text = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        text = F.when(fits, F.lit(name + start)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def domain_columns(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; an address in numbers is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two, three = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -3)
    number = bare.rlike(r"^[0-9.]+$") | F.startswith(bare, F.lit("["))
    long = two.isin(*long_suffixes) if long_suffixes else F.lit(False)
    suffix = F.when(number, F.lit("#")).when(long, two).otherwise(F.substring_index(bare, ".", -1))
    return F.when(number, bare).when(long, three).otherwise(two), suffix


def suffix_domains(hosts: DataFrame, suffixes: DataFrame, suffix: str = "suffix") -> DataFrame:
    """``hosts`` (one row for each ``host``) with ``_domain`` and ``_suffix`` by the longest suffix of a table.

    The tails of a host, at most as many as the table's longest suffix has
    labels, are joined to the table; the registered domain has one label more
    than the longest that is found, or is the suffix itself.  Hosts without a
    suffix of the table, addresses in numbers and an empty table fall back to
    the last label.  NULL and repeated suffixes change nothing.
    """
    domain, last = domain_columns(F.col("host"), ())
    known = suffixes.select(ascii_lower(F.col(suffix)).alias("_tail")).where("_tail <> ''").distinct()
    known = materialize(known, "url-suffixes")
    most = known.agg(F.max(F.size(F.split("_tail", r"\."))).alias("m")).first()["m"]
    plain = hosts.withColumns({"_domain": domain, "_suffix": last})
    if most is None:
        return plain
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    named = plain.where("_suffix <> '#'").select("host", bare.alias("_bare"))
    tails = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.struct(k.alias("k"), F.call_function("substring_index", F.col("_bare"), F.lit("."), -k).alias("t")))
    looked = named.select("host", "_bare", F.explode(tails).alias("_x")).select("host", "_bare", F.col("_x.k").alias("_k"), F.col("_x.t").alias("_tail"))
    best = join_small(looked, known, ["_tail"], "inner").groupBy("host").agg(F.max(F.struct("_k", "_tail", "_bare")).alias("_b"))
    found = materialize(best.select(
        "host", F.col("_b._tail").alias("_own"), F.call_function("substring_index", F.col("_b._bare"), F.lit("."), -(F.col("_b._k") + 1)).alias("_wide")), "url-domains")
    return join_small(plain, found, ["host"], "left").withColumns(
        {"_domain": F.coalesce("_wide", "_domain"), "_suffix": F.coalesce("_own", "_suffix")}).drop("_own", "_wide")


def host_reputation(counts: DataFrame, max_bad: float = 0.5, z: float = 1.645,
                    long_suffixes: Sequence[str] = LONG_SUFFIXES, suffixes: DataFrame | None = None) -> DataFrame:
    """``host``, n labelled pages, f bad ones -> posterior rate, its lower bound, ``_blocked``.

    ``suffixes`` is a table of public suffixes, which takes the place of ``long_suffixes``.
    """
    domain, suffix = domain_columns(F.col("host"), long_suffixes)
    placed = counts.withColumns({"_domain": domain, "_suffix": suffix}) if suffixes is None else suffix_domains(counts, suffixes)
    hosts = materialize(placed, "url-hosts")
    whole = hosts.agg(F.coalesce(F.try_divide(F.sum("f"), F.sum("n")), F.lit(0.0)).alias("_prior"))
    suffixes = shrink(
        hosts.groupBy("_suffix").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).crossJoin(F.broadcast(whole)),
        "_prior", mean="_suffix_rate",
    ).select("_suffix", "_suffix_rate")
    domains = shrink(
        hosts.groupBy("_domain", "_suffix").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).join(suffixes, "_suffix"),
        "_suffix_rate", mean="_domain_rate",
    ).select("_domain", "_suffix", "_domain_rate")
    known = materialize(domains, "url-domains")
    rated = shrink(join_small(hosts, known, ["_domain", "_suffix"], "inner"), "_domain_rate", mean="bad_rate")
    return rated.withColumn("bad_bound", lower_bound("bad_rate", "weight", z)).select(
        "host", "n", "f", "bad_rate", "bad_bound", (F.col("bad_bound") > max_bad).alias("_blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, page: str = "page_id", url: str = "url",
          rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = 0.5, z: float = 1.645,
          long_suffixes: Sequence[str] = LONG_SUFFIXES, suffixes: DataFrame | None = None) -> DataFrame:
    """Verdict of every page.  ``outcomes`` has ``page_id`` and ``bad`` (0 or 1), ``suffixes`` a column ``suffix``."""
    host, path = split_url(F.col(url))
    parts = pages.select(F.col(page).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    known = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    counts = (
        parts.select("page_id", "host").join(known, "page_id", "left").groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("f"))
    )
    rated = materialize(host_reputation(counts, max_bad, z, long_suffixes, suffixes), "url-reputation")
    own = F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return join_small(parts, rated, ["host"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate")
