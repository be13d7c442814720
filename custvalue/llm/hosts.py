"""URL filters by rules and by empirical-Bayes host reputation.

Labelled pages give each host a count of bad outcomes. A host's rate is a beta-binomial draw
around the rate of its registered domain, that around its suffix's, that around the rate of all;
how tightly, at each level, is estimated from the data by moments (Kleinman's weighted estimator),
so hosts with few labels lean on their parents and hosts with many speak for themselves. A page is
blocked where the lower posterior bound of its host's bad rate reaches a limit. Explicit rules,
the longest that fits, go before.

The limit comes from outcomes that the bounds have not seen: bounds fitted on pages with an even id
are held against the labelled pages with an odd one that no rule decides. It is the limit where
``worth`` times the bad pages blocked, less the good pages blocked, is largest. Where blocking by
host gains nothing, because hosts do not differ in what was labelled, the method blocks nothing.

All of it is DataFrame functions. Per-host counts are summed before the shuffle, and joins are
written so that adaptive execution can split a hot host or suffix.

Defined results: a null url and one without ``://`` have empty host and path and fall under the
overall rate, like any host without labels (through its parents). Pages are judged row by row, so
ties and repeated rows agree; each labelled row counts. Without any label nothing but rules
blocks. An empty table gives an empty table. Input columns other than id, url and the outcome are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.llm.shared import named, saved
from custvalue.operators.joins import left_join

# A bad page kept out is worth this many good pages lost.
WORTH = 5
_STEPS = 1000  # limits that are compared
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = ("host", "domain", "suffix")


@dataclass(frozen=True)
class Rule:
    """``where`` is host and path prefix, as in ``example.net/en/``."""

    where: str
    verdict: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return self.where[len(self.host) :]


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z in lower case; empty without."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ? or # or the end; empty without a host."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _below(host: Column, labels: int, suffixes: Sequence[str]) -> Column:
    """The suffix of a host with so many labels before it."""
    found = F.substring_index(host, ".", -1 - labels)
    for suffix in sorted(suffixes, key=lambda s: (s.count("."), s)):
        fits = (host == suffix) | host.endswith("." + suffix)
        found = F.when(
            fits, F.substring_index(host, ".", -1 - labels - suffix.count("."))
        ).otherwise(found)
    return found


def domain_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The suffix and the label before it."""
    return _below(host, 1, suffixes)


def suffix_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The last label, or the longest of ``suffixes`` (such as ``co.uk``) that the host ends with."""
    return _below(host, 0, suffixes)


def lower_quantile(a: Column, b: Column, z: float) -> Column:
    """Of a beta distribution, the quantile that a standard normal has at ``-z``, above 0.

    Abramowitz and Stegun, 26.5.22, which holds from one observation of each kind on: a smaller
    ``b`` counts as 1, and below ``a`` = 1 the quantile of 1 shrinks in proportion.
    """
    many_a, many_b = F.greatest(a, F.lit(1.0)), F.greatest(b, F.lit(1.0))
    one_a, one_b = 1 / (2 * many_a - 1), 1 / (2 * many_b - 1)
    h = 2 / (one_a + one_b)
    lean = (z * z - 3) / 6
    w = z * F.sqrt(h + lean) / h - (one_b - one_a) * (lean + 5 / 6 - 2 / (3 * h))
    return F.least(a, F.lit(1.0)) * many_a / (many_a + many_b * F.exp(2 * w))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule], value: str) -> Column:
    """``where`` or ``verdict`` of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.where), r.where)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, value))).otherwise(found)
    return found


def _pooled_concentration(counts: DataFrame, parent: str) -> float:
    """How tightly children's rates lie around their parent's: the beta prior's total weight."""
    # Per parent: children k, labels N, sum of n squared, and weighted squares of the rates.
    totals = counts.groupBy(F.col(parent).alias("__parent")).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("N"),
        F.sum("bad").alias("B"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b2"),
    )
    p = F.col("B") / F.col("N")
    spread = p * (1 - p)
    between = F.col("b2") - p * F.col("B")
    free = F.col("k") - 1
    row = totals.where("k > 1").agg(
        F.sum(between - spread * free).alias("over"),
        F.sum(spread * (F.col("N") - F.col("n2") / F.col("N") - free)).alias("room"),
    ).first()
    if not row["room"] or row["over"] is None:
        return 10.0
    share = min(max(row["over"] / row["room"], 0.001), 0.5)
    return (1 - share) / share


def reputations(
    outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, float]:
    """Posterior bounds from rows with ``host`` and ``bad`` (1, 0, or null for no label).

    Returns hosts (host, bad_bound), parents of hosts not seen (parent, bad_bound), and the bound
    where nothing is known.
    """
    labelled = outcomes.where("bad IS NOT NULL")
    hosts = labelled.groupBy("host").agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad")
    )
    hosts = saved(
        hosts.withColumns({
            "domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)
        })
    )
    domains = hosts.groupBy("domain").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("suffix").alias("suffix")
    )
    by_suffix = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = by_suffix.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, bad = total["n"] or 0.0, total["bad"] or 0.0
    overall = bad / n if n else 0.0
    weight = {
        "host": _pooled_concentration(hosts, "domain"),
        "domain": _pooled_concentration(domains, "suffix"),
        "suffix": _pooled_concentration(by_suffix.withColumn("all", F.lit(0)), "all"),
    }

    def mean(prior: Column, level: str) -> Column:
        return (F.col("bad") + weight[level] * prior) / (F.col("n") + weight[level])

    def bound(prior: Column, n: Column, bad: Column, level: str) -> Column:
        a, b = bad + weight[level] * prior, n - bad + weight[level] * (1 - prior)
        return lower_quantile(a, b, z)

    none = F.lit(0.0)
    by_suffix = by_suffix.select("suffix", mean(F.lit(overall), "suffix").alias("suffix_mean"))
    domains = left_join(domains, by_suffix, "suffix", hot_keys=True)
    domains = domains.select("domain", mean(F.col("suffix_mean"), "domain").alias("domain_mean"))
    known = left_join(hosts, domains, "domain", hot_keys=True).select(
        "host",
        bound(F.col("domain_mean"), F.col("n"), F.col("bad"), "host").alias("bad_bound"),
    )
    parents = domains.select(
        F.col("domain").alias("parent"),
        bound(F.col("domain_mean"), none, none, "host").alias("bad_bound"),
    ).union(
        # A suffix that is itself a domain's name cannot occur: a domain with labels has a host.
        by_suffix.select(
            F.concat(F.lit("."), "suffix"),
            bound(F.col("suffix_mean"), none, none, "domain"),
        )
    )
    return known, parents, overall


def _bounds(
    hosts: DataFrame, found: tuple[DataFrame, DataFrame, float], suffixes: Sequence[str]
) -> DataFrame:
    """``hosts`` (one row per host) with ``bad_bound``: its own, its domain's or its suffix's."""
    known, parents, overall = found
    hosts = left_join(hosts, known.withColumnRenamed("host", "__host"), "host", "__host")
    hosts, parents = hosts.drop("__host"), saved(parents)
    for name, key in (("by_domain", domain_of(F.col("host"), suffixes)),
                      ("by_suffix", F.concat(F.lit("."), suffix_of(F.col("host"), suffixes)))):
        side = parents.select(
            F.col("parent").alias("__parent"), F.col("bad_bound").alias(name)
        )
        hosts = left_join(
            hosts.withColumn("__key", key), side, "__key", "__parent", hot_keys=True
        ).drop("__key", "__parent")
    bound = F.coalesce("bad_bound", "by_domain", "by_suffix", F.lit(overall))
    return hosts.withColumn("bad_bound", bound).drop("by_domain", "by_suffix")


def _step(bound: Column) -> Column:
    return F.floor(bound * _STEPS).cast("int")


def learned_limit(
    rows: DataFrame, z: float = 1.645, worth: int = WORTH, suffixes: Sequence[str] = ()
) -> float:
    """The limit that gains most on outcomes the bounds have not seen; 2, which no bound reaches,
    if none gains. ``rows`` holds page_id, host, rule and bad. The driver sees one row per step."""
    even = F.coalesce(F.col("page_id") % 2, F.lit(0)) == 0
    found = reputations(rows.where("host <> ''").where(even), z, suffixes)
    seen = rows.where(~even & F.col("bad").isNotNull() & F.col("rule").isNull())
    hosts = seen.groupBy("host").agg(
        F.sum(F.col("bad").cast("double")).alias("bad"), F.count("*").alias("n")
    )
    steps = (
        _bounds(hosts, found, suffixes)
        .groupBy(_step(F.col("bad_bound")).alias("step"))
        .agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        .orderBy(F.desc("step"))
        .collect()
    )
    limit, gain, most = 2.0, 0.0, 0.0
    for row in steps:
        gain += worth * row["bad"] - (row["n"] - row["bad"])
        if gain > most:
            limit, most = row["step"] / _STEPS, gain
    return limit


def judged(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    outcome_column: str = "bad",
    limit: float | None = None,
    z: float = 1.645,
    worth: int = WORTH,
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """Per page: page_id, host, path, rule, bad_bound and verdict (allow or block).

    ``outcome_column`` holds 1 for a page known to be bad, 0 for a good one, else null. Without a
    ``limit`` one is learned, in steps of a thousandth. ``suffixes`` lists those of several labels.
    """
    url = named(url_column)
    rows = pages.select(
        named(id_column).alias("page_id"),
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        named(outcome_column).alias("bad"),
    )
    host, path = F.col("host"), F.col("path")
    rows = rows.withColumn("rule", fitting_rule(host, path, rules, "where"))
    if limit is None:
        limit = learned_limit(rows, z, worth, suffixes)
    found = reputations(rows.where("host <> ''"), z, suffixes)
    hosts = _bounds(rows.select("host").distinct(), found, suffixes)
    hosts = hosts.withColumnRenamed("host", "__host")
    joined = left_join(rows.drop("bad"), hosts, "host", "__host", hot_keys=True).drop("__host")
    own = F.when(_step(F.col("bad_bound")) >= round(limit * _STEPS), "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", "bad_bound",
        F.coalesce(fitting_rule(host, path, rules, "verdict"), own).alias("verdict"),
    )
