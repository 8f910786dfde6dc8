"""URL filters: host rules, then an empirical-Bayes reputation for hosts without a rule.

Method: labelled page outcomes are counted for each host, registered domain and suffix. Beta-binomial priors
shrink a host to its domain, the domain to its suffix and the suffix to the whole; their strengths come from the
spread of the rates at each level (method of moments). A host passes if the lower posterior bound of its rate of
good pages reaches the threshold. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tallyproof.llm.common import checkpointed

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class UrlRules:
    """rules: (verdict, rule), a rule being host/path-prefix. threshold: least lower bound of a host that passes;
    z: standard deviations between posterior mean and bound. suffixes: public suffixes of more than one label, below which
    names are registered; any other suffix is a host's last label."""

    rules: tuple[tuple[str, str], ...] = field(
        default=(("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    )
    threshold: float = 0.6
    z: float = 1.2816
    suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.in", "co.kr", "com.cn", "co.nz", "co.za", "com.mx", "com.tr")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/ ? #``, ASCII letters lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, cfg: UrlRules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    chain = None
    for verdict, rule in sorted(cfg.rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain


def bare_host(host: Column) -> Column:
    """The host name or address without user data, port and a dot at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")


def suffix_of(host: Column, cfg: UrlRules = UrlRules()) -> Column:
    """The public suffix of a bare host; an address is its own."""
    two = F.substring_index(host, ".", -2)
    address = host.rlike(r"^[0-9.]+$|^\[")
    return F.when(address, host).when(two.isin(*cfg.suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, cfg: UrlRules = UrlRules()) -> Column:
    """The registered domain of a bare host: one label more than its suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"^[0-9.]+$|^\["), host).when(two.isin(*cfg.suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, good (0/1) for each labelled page. A page is good if all its labels say quality and none toxic; labels
    with a null are left out, repeated ones count once."""
    labelled = (
        labels.filter("doc_id is not null and quality is not null and toxic is not null")
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long")).alias("good"))
    )
    return pages.select("page_id", host_of(F.col("url")).alias("host")).filter("host <> ''").distinct().join(labelled, "page_id").select("host", "good")


def _strength(children: DataFrame, name: str) -> DataFrame:
    """One row: the prior's strength (pseudo-pages) from the spread of ``k / n`` around ``p`` among the children."""
    pq = "sum(n * p * (1 - p)) / sum(n)"
    dof = "(count(*) - 1)"
    return children.filter("n > 0").selectExpr(
        f"coalesce(1 / least(0.99D, greatest(0.001D, try_divide(try_divide(sum(n * pow(k / n - p, 2)), {pq}) - {dof}, sum(n) - sum(n * n) / sum(n) - {dof}))) - 1, 999D) as {name}"
    )


def host_reputation(outcomes: DataFrame, hosts: DataFrame, cfg: UrlRules = UrlRules()) -> DataFrame:
    """host, n, rate, bound for every row of ``hosts`` (distinct hosts), labelled or not.

    With no outcome at all the rate is one half at strength 2. All levels but the hosts are aggregates of the
    hosts' counts, so a host with a third of the pages is one row after the map-side sum.
    """
    seen = outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("k"))
    bare = bare_host(F.col("host"))
    # Written once: every level below reads these counts, one row a host.
    counts = checkpointed(hosts.join(seen, "host", "left").na.fill(0.0, ["n", "k"]).withColumns({"domain": domain_of(bare, cfg), "suffix": suffix_of(bare, cfg)}))
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = checkpointed(suffixes)
    whole = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("p"))

    suffixes = suffixes.crossJoin(F.broadcast(whole))  # one row
    suffixes = suffixes.crossJoin(F.broadcast(_strength(suffixes, "s")))
    suffixes = suffixes.selectExpr("suffix", "(k + s * p) / (n + s) as p")
    domains = checkpointed(domains.join(suffixes, "suffix"))
    domains = domains.crossJoin(F.broadcast(_strength(domains, "s")))
    domains = domains.selectExpr("domain", "(k + s * p) / (n + s) as p")
    rated = checkpointed(counts.join(domains, "domain"))
    rated = rated.crossJoin(F.broadcast(_strength(rated, "s")))
    rated = rated.selectExpr("host", "n", "s", "(k + s * p) / (n + s) as rate")
    return rated.selectExpr("host", "n", "rate", f"rate - {cfg.z}D * sqrt(rate * (1 - rate) / (n + s + 1)) as bound")


def judge_urls(pages: DataFrame, labels: DataFrame, cfg: UrlRules = UrlRules()) -> DataFrame:
    """Every row of ``pages`` with host, path, rule (null if none fits) and verdict (allow or block).

    Null urls and urls without ``://`` have empty host and path, no rule, and are blocked: nothing vouches for
    them. Repeated rows are judged each. Columns of ``pages`` named like results are replaced; all others stay,
    whatever their names.
    """
    results = ("host", "path", "rule", "verdict")
    names = [n for n in pages.columns if n not in results]
    own = pages.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    id_, url = (F.col(f"c{names.index(n)}") for n in ("page_id", "url"))
    judged = own.withColumns({"host": host_of(url), "path": path_of(url)})
    hosts = judged.select("host").filter("host <> ''").distinct()
    allowed = host_reputation(page_outcomes(judged.select(id_.alias("page_id"), url.alias("url")), labels), hosts, cfg).selectExpr("host", f"bound >= {cfg.threshold}D as passes")
    found = longest_rule(F.col("host"), F.col("path"), cfg)
    found = found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")
    out = judged.join(allowed, "host", "left")
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "host", "path", found["rule"].alias("rule"), F.coalesce(found["verdict"], F.when(F.col("passes"), "allow").otherwise("block")).alias("verdict"))
