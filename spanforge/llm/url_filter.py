"""URL filtering by rules and by host reputation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, small, written

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Labels under a country's two letters that are no one's own.
GENERAL = "ac|co|com|edu|gov|net|org"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or # or the end, A-Z lower-cased; empty without :// or url."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits host (or a domain above it) and path; null if none does."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return none if out is None else out


def name_of(host: Column) -> Column:
    """The host without user information and port: what has a reputation."""
    return F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$", "")


def is_address(name: Column) -> Column:
    """Whether the name is a numeric address, which has no domain above it."""
    return name.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$")


def registered_domain(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The suffix and one label more; a numeric address is its own.

    The suffix is the longest of ``suffixes`` that the host ends with, or else its last label, or its last two if these
    are a general label (GENERAL) under a country's two letters.
    """
    n = F.when(host.rlike(rf"\.(?:{GENERAL})\.[a-z][a-z]$"), F.lit(3)).otherwise(F.lit(2))
    for s in sorted(suffixes, key=lambda s: s.count(".")):
        n = F.when(host.endswith("." + s), F.lit(s.count(".") + 2)).otherwise(n)
    labels = F.split(host, r"\.")
    return F.when(is_address(host), host).otherwise(F.array_join(F.reverse(F.slice(F.reverse(labels), F.lit(1), F.least(n, F.size(labels)))), "."))


#: Nodes on each side of the mode at which a posterior is summed.
NODES = 128


def beta_quantiles(a: Column, b: Column, levels: list[float]) -> Column:
    """Quantiles of the beta distribution, array in the order of levels, to about 0.001.

    The density of the logit is summed by trapezoids at nodes that lie close around its mode and ever wider outward
    (sinh of even steps), out to where less than e^-30 is left; so skewed posteriors of few pages are right, too.
    """
    log_share = lambda x: F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))
    step = lambda width, scale: F.asinh(width / scale) / NODES
    gauge = F.struct(
        a.alias("a"),
        b.alias("b"),
        F.log(a / b).alias("mode"),
        F.sqrt((a + b) / (a * b)).alias("scale"),
    )

    def nodes(g: Column) -> Column:
        left = step(F.lit(30.0) / g["a"] + g["scale"] * 8, g["scale"])
        right = step(F.lit(30.0) / g["b"] + g["scale"] * 8, g["scale"])
        h = F.greatest(left, right)
        top = g["a"] * log_share(g["mode"]) + g["b"] * log_share(-g["mode"])

        def node(k: Column) -> Column:
            x = g["mode"] + g["scale"] * F.sinh(k * h)
            return let(x, lambda x: F.struct(x.alias("x"), (F.exp(g["a"] * log_share(x) + g["b"] * log_share(-x) - top) * F.cosh(k * h)).alias("f")))

        return F.transform(F.sequence(F.lit(-NODES), F.lit(NODES)), lambda k: node(k.cast("double")))

    def quantile(xs: Column, level: float) -> Column:
        want = F.aggregate(xs, F.lit(0.0), lambda t, x: t + x["f"]) * level
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("f"), F.get(xs, F.lit(0))["x"].alias("x"), F.lit(None).cast("double").alias("found"))

        def add(want: Column) -> Callable[[Column, Column], Column]:
            def one(s: Column, x: Column) -> Column:
                more = (s["f"] + x["f"]) / 2
                here = F.when(s["sum"] + more >= want, s["x"] + (x["x"] - s["x"]) * F.when(more > 0, (want - s["sum"]) / more).otherwise(F.lit(0.0)))
                return F.struct((s["sum"] + more).alias("sum"), x["f"].alias("f"), x["x"].alias("x"), F.coalesce(s["found"], here).alias("found"))

            return one

        return let(want, lambda w: F.aggregate(xs, start, add(w), lambda s: F.exp(log_share(F.coalesce(s["found"], s["x"])))))

    return let(gauge, lambda g: let(nodes(g), lambda xs: F.array(*[quantile(xs, q) for q in levels])))


def _concentration(groups: DataFrame, n: str, good: str, mean: Column) -> float:
    """Prior weight in pages of a group's mean, by moments: over-dispersion of the groups' good pages around their priors' means; from 1 to 10,000."""
    v = F.greatest(mean * (F.lit(1.0) - mean), F.lit(1e-6))
    square = F.pow(F.col(good) - F.col(n) * mean, F.lit(2)) / F.col(n)
    r = groups.where(F.col(n) > 0).agg(F.sum(square - v).alias("excess"), F.sum(v * (F.col(n) - 1)).alias("room")).first()
    if not r["room"] or r["excess"] <= 0:
        return 10_000.0
    rho = r["excess"] / r["room"]
    return min(max(1 / rho - 1, 1.0), 10_000.0)


def host_reputation(pages: DataFrame, level: float = 0.95, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Posterior of the share of good pages for every host of pages (host, outcome: 1 good, 0 bad, null not labelled): host, n, mean, low and high.

    Beta-binomial priors: a suffix is shrunk toward all pages, a registered domain toward its suffix and a host toward its
    domain; how strongly, comes from how much groups of a level differ. The share lies above low, and below high, with a
    posterior probability of ``level`` each. Counts are combined before the shuffle; domains and suffixes are counted from hosts.
    """
    hosts = pages.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum(F.col("outcome").cast("bigint")), F.lit(0)).alias("good"))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"), suffixes))
    above = F.when(is_address(F.col("domain")), F.lit("ip")).when(F.col("domain").contains("."), F.regexp_extract("domain", r"(?s)^[^.]*\.(.*)$", 1)).otherwise(F.col("domain"))
    hosts = hosts.withColumn("suffix", above)
    hosts = written(hosts, "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("good").alias("dgood")), "domains")
    tops = written(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dgood").alias("sgood")), "suffixes")
    total = tops.agg(F.sum("sn").alias("n"), F.sum("sgood").alias("good")).first()
    overall = F.lit(((total["good"] or 0) + 1) / ((total["n"] or 0) + 2))

    def shrunk(groups: DataFrame, n: str, good: str, mean: Column) -> tuple[Column, float]:
        m = _concentration(groups, n, good, mean)
        return (F.col(good) + mean * m) / (F.col(n) + m), m

    tops = written(tops.withColumn("smean", shrunk(tops, "sn", "sgood", overall)[0]).select("suffix", "smean"), "suffix-means")
    domains = domains.join(small(tops), "suffix")
    domains = written(domains.withColumn("dmean", shrunk(domains, "dn", "dgood", F.col("smean"))[0]).select("domain", "dmean"), "domain-means")
    hosts = hosts.join(small(domains), "domain")
    mean, m = shrunk(hosts, "n", "good", F.col("dmean"))
    out = hosts.select("host", "n", mean.alias("mean"), (F.col("n") + m).alias("weight"))
    bounds = beta_quantiles(F.col("mean") * F.col("weight"), (F.lit(1.0) - F.col("mean")) * F.col("weight"), [1 - level, level])
    return out.withColumn("_b", bounds).select("host", "n", "mean", F.get("_b", F.lit(0)).alias("low"), F.get("_b", F.lit(1)).alias("high"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, least_good: float = 0.5, level: float = 0.95, suffixes: tuple[str, ...] = (), page_id: str = "page_id", url: str = "url", label_id: str = "doc_id") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row's url.

    labels: (label_id, quality, toxic) of pages; a page is good with quality 1 and not toxic, unlabelled if quality is null
    or missing; a page with several labels counts once for each. A rule fits its host and the domains below it where the
    path starts with the rule's; the longest wins. Without a rule, a page is blocked if the posterior bound of its
    host's share of good pages (``host_reputation``) is below ``least_good``: the upper bound, so that a host needs evidence
    to be blocked. User information and port do not count for the reputation. A url that is null or has no :// has an empty host and path, which no one rates: allowed. Rows count for
    themselves where ids repeat or are null; further columns are ignored. An empty table gives no rows.
    """
    base = pages.select(F.col(page_id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("name", name_of(F.col("host")))
    outcome = F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    rated = labels.select(F.col(label_id).alias("id"), outcome.alias("outcome")).where(F.col("outcome").isNotNull())
    reputation = host_reputation(base.join(rated, "id", "left").where("name <> ''").select(F.col("name").alias("host"), "outcome"), level, suffixes)
    bad = small(written(reputation.where(F.col("high") < least_good).select(F.col("host").alias("name"), F.lit("block").alias("method")), "bad-hosts"))
    judged = base.join(bad, "name", "left").withColumn("r", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))
    return judged.select(F.col("id").alias(page_id), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "method", F.lit("allow")).alias("verdict"))


def op6_query(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judge_urls(pages, labels)


def _sql_concentration(source: str, n: str, good: str, mean: str) -> str:
    v = f"greatest({mean} * (1 - {mean}), 1e-6)"
    ratio = f"(SELECT sum(pow({good} - {n} * {mean}, 2) / {n} - {v}) AS excess, sum({v} * ({n} - 1)) AS room FROM {source} WHERE {n} > 0)"
    return f"(SELECT CASE WHEN room IS NULL OR room = 0 OR excess <= 0 THEN 10000.0 ELSE least(greatest(room / excess - 1, 1.0), 10000.0) END FROM {ratio})"


_SQL_HOST = "translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', {g}, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6_SQL = f"""
WITH base AS (SELECT page_id, {_SQL_HOST.format(g=1)} AS host, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
bare AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'gs') AS name FROM base),
rated AS (SELECT name AS host, CASE WHEN quality IS NOT NULL THEN CAST(quality = 1 AND coalesce(toxic, 0) = 0 AS INTEGER) END AS y FROM bare LEFT JOIN labels ON doc_id = page_id WHERE name <> ''),
hosts AS (SELECT host, count(y) AS n, coalesce(sum(y), 0) AS good, regexp_matches(host, '^([0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}|\\[.*\\])$') AS ip FROM rated GROUP BY host),
deep AS (SELECT *, CASE WHEN ip THEN host ELSE array_to_string(list_slice(string_split(host, '.'), CASE WHEN regexp_matches(host, '[.]({GENERAL})[.][a-z][a-z]$') THEN -3 ELSE -2 END, -1), '.') END AS domain FROM hosts),
named AS (SELECT *, CASE WHEN ip THEN 'ip' WHEN contains(domain, '.') THEN substr(domain, instr(domain, '.') + 1) ELSE domain END AS suffix FROM deep),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM named GROUP BY ALL),
tops AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM domains) AS up FROM domains GROUP BY suffix),
smeans AS (SELECT suffix, (good + up * m) / (n + m) AS smean FROM tops, (SELECT {_sql_concentration('tops', 'n', 'good', 'up')} AS m)),
d2 AS (SELECT domain, n, good, smean FROM domains JOIN smeans USING (suffix)),
dmeans AS (SELECT domain, (good + smean * m) / (n + m) AS dmean FROM d2, (SELECT {_sql_concentration('d2', 'n', 'good', 'smean')} AS m)),
h2 AS (SELECT host, n, good, dmean FROM named JOIN dmeans USING (domain)),
post AS (SELECT host, n + m AS w, (good + dmean * m) / (n + m) AS mean FROM h2, (SELECT {_sql_concentration('h2', 'n', 'good', 'dmean')} AS m)),
shape AS (SELECT host, mean * w AS a, (1 - mean) * w AS b, ln(mean / (1 - mean)) AS x0, 1 / sqrt(w * mean * (1 - mean)) AS c FROM post),
grid AS (SELECT *, ln(r + sqrt(r * r + 1)) / 1500 AS h FROM (SELECT *, 30 / least(a, b) / c + 8 AS r FROM shape)),
dense AS (SELECT host, x, exp(a * (least(x, 0) - ln(1 + exp(-abs(x))) - least(x0, 0) + ln(1 + exp(-abs(x0)))) + b * (least(-x, 0) - ln(1 + exp(-abs(x))) - least(-x0, 0) + ln(1 + exp(-abs(x0))))) * (exp(k * h) + exp(-k * h)) AS f
  FROM (SELECT *, x0 + c * (exp(k * h) - exp(-k * h)) / 2 AS x FROM grid, range(-1500, 1501) t(k))),
bad AS (SELECT host FROM dense GROUP BY host HAVING sum(f) FILTER (WHERE x < 0) > 0.95 * sum(f)),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM bare)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN name IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
