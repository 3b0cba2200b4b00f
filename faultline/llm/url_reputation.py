"""Host reputation from labelled pages, shrunk through beta-binomial priors from host to registered domain to suffix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``site`` is host and path as in ``example.net/en/``; it fits the host, its subdomains, and paths that begin so."""

    site: str
    verdict: str

    @property
    def host(self) -> str:
        return self.site.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.site.partition("/")[2]


RULES = (
    Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def suffix_of(host: Column, long_suffixes: Sequence[str] = ()) -> Column:
    """The last label, or a listed suffix of several labels."""
    listed = [F.when((host == s) | host.endswith("." + s), F.lit(s)) for s in sorted(long_suffixes, key=len, reverse=True)]
    return F.coalesce(*listed, F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; a host that is a suffix is its own domain."""
    rest = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(host) <= F.length(suffix) + 1, host).otherwise(
        F.concat(F.substring_index(rest, ".", -1), F.lit("."), suffix)
    )


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength (pseudo-observations) by the method of moments: how much more the groups differ from ``mean`` than
    binomial draws would. Counts are whole numbers; the rounding makes the sum independent of its order."""
    n, bad = F.col("n"), F.col("bad")
    spread = (bad - n * mean) * (bad - n * mean) - n * mean * (1 - mean)
    row = groups.agg(
        F.sum(F.round(spread, 6).cast("decimal(30,6)")).alias("s"),
        F.sum(F.round(n * (n - 1) * mean * (1 - mean), 6).cast("decimal(30,6)")).alias("d"),
    ).first()
    share = float(row["s"]) / float(row["d"]) if row["d"] else 0.0
    share = min(max(share, 0.001), 0.9)  # of the variance that lies between groups
    return round(1 / share - 1, 6)


def host_reputation(outcomes: DataFrame, z: float = 1.645, long_suffixes: Sequence[str] = ()) -> DataFrame:
    """Posterior of every host's rate of bad pages.

    ``outcomes``: ``host`` and ``bad`` (1, 0, or null for a page without a label). Result: ``host``, ``n`` and ``n_bad``
    (labelled pages), ``mean``, and ``low`` (posterior mean less ``z`` deviations). A host without labels has the
    posterior of its domain, a domain without labels that of its suffix, and so on.
    """
    suffix = suffix_of(F.col("host"), long_suffixes)
    hosts = stored(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
        .withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))),
        "hosts",
    )
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    total = hosts.agg(*sums).first()
    base = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)

    def shrunk(strength: float, prior: Column) -> Column:
        return (F.col("bad") + strength * prior) / (F.col("n") + strength)

    by_suffix = hosts.groupBy("suffix").agg(*sums)
    k = _strength(by_suffix, F.lit(base))
    by_suffix = by_suffix.select("suffix", shrunk(k, F.lit(base)).alias("suffix_mean"))
    by_domain = hosts.groupBy("domain", "suffix").agg(*sums).join(by_suffix, "suffix")
    k = _strength(by_domain, F.col("suffix_mean"))
    by_domain = by_domain.select("domain", shrunk(k, F.col("suffix_mean")).alias("domain_mean"))
    judged = hosts.join(by_domain, "domain")
    k = _strength(judged, F.col("domain_mean"))
    good = F.col("n") - F.col("bad") + k * (1 - F.col("domain_mean"))
    a, size = F.col("bad") + k * F.col("domain_mean"), F.col("n") + k
    sd = F.sqrt(a * good / (size * size * (size + 1)))
    return judged.select(
        "host", "n", F.col("bad").alias("n_bad"), (a / size).alias("mean"), F.greatest(a / size - z * sd, F.lit(0.0)).alias("low")
    )


def _rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    order = sorted(rules, key=lambda r: (-len(r.site), r.site))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in order]
    name = F.coalesce(*[F.when(f, F.lit(r.site)) for f, r in zip(fits, order)], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(f, F.lit(r.verdict)) for f, r in zip(fits, order)], F.lit(None).cast("string"))
    return name, verdict


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, limit: float = 0.2, z: float = 1.645,
    id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", salts: int = 16,
    long_suffixes: Sequence[str] = (),
) -> DataFrame:
    """One row per page: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``bad_low``.

    A rule decides where one fits (the longest). Elsewhere a page is blocked if the lower posterior bound of its host's
    rate of bad pages is above ``limit``. A labelled page is bad if a label row of its id says quality 0 or toxic 1;
    several label rows of an id are one outcome.

    Defined cases: a null url or one without ``://`` has an empty host and path; all of those share one reputation.
    Pages with a null id get a verdict and carry no label. Repeated rows are judged each, and each is an outcome. Without
    labels every host has the same rate. Empty tables and extra columns do no harm.

    The reputation of a host is copied to ``salts`` rows, so that the pages of a frequent host meet it in as many tasks.
    """
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.max(bad.cast("int")).alias("bad"))
    parsed = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    reputation = host_reputation(parsed.join(known, "id", "left").select("host", "bad"), z, long_suffixes)
    copies = reputation.select(
        F.col("host").alias("r_host"), F.col("low").alias("bad_low"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("r_salt")
    )
    salted = parsed.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(salts)).cast("int"))
    name, verdict = _rule(rules, F.col("host"), F.col("path"))
    judged = F.when(F.col("bad_low") > limit, F.lit("block")).otherwise(F.lit("allow"))
    on = (F.col("host") == F.col("r_host")) & (F.col("salt") == F.col("r_salt"))
    return salted.join(copies, on, "left").select(
        F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "bad_low"
    )
