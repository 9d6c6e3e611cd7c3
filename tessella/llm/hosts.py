"""URL filters: listed rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted for each host and shrunk through
beta-binomial priors: the whole table's rate is the prior of a suffix, the
suffix's posterior the prior of a registered domain, the domain's that of a host.
Each level's prior strength is estimated from the spread of its members' rates
by the method of moments. A host is blocked if even the lower bound of its
posterior, a quantile of the beta distribution, is above a limit, by default the
whole table's rate of bad outcomes. Hosts without labels take the posterior of
their domain, else of their suffix. Suffixes are public ones: the last label, or
the last two where SECOND_LEVEL has them. An IPv4 host is its own domain under
the suffix "ip"; user names and ports don't count for grouping.

DataFrame expressions only. Labels and hosts are aggregated before any join; the
join of all pages to host verdicts is an ordinary one, which Spark broadcasts
only below its size limit and splits where a host is hot.

A null url, or one without "://", has empty host and path; no rule fits it and it
is judged like a host without labels. Repeated rows are judged alike and count
once; each outcome of a page counts, once for each host that the page's rows have. An empty table gives none; without labels the
method allows all.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (rule, verdict); a rule is host and path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, prefix = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


# Public suffixes of two labels.
SECOND_LEVEL = (
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk asn.au com.au edu.au gov.au id.au net.au org.au ac.nz co.nz govt.nz net.nz org.nz school.nz "
    "ac.jp ad.jp co.jp ed.jp go.jp gr.jp lg.jp ne.jp or.jp ac.kr co.kr go.kr ne.kr or.kr pe.kr re.kr ac.in co.in edu.in firm.in gen.in gov.in ind.in net.in org.in res.in "
    "ac.za co.za gov.za net.za org.za web.za ac.il co.il gov.il net.il org.il com.br edu.br gov.br net.br org.br com.ar edu.ar gob.ar net.ar org.ar com.mx edu.mx gob.mx net.mx org.mx "
    "com.co edu.co gov.co com.pe edu.pe gob.pe com.ve com.cn edu.cn gov.cn net.cn org.cn com.hk edu.hk gov.hk com.tw edu.tw gov.tw com.sg edu.sg gov.sg com.my edu.my gov.my "
    "co.id ac.id go.id or.id co.th ac.th go.th or.th com.vn edu.vn gov.vn com.ph edu.ph gov.ph com.tr edu.tr gov.tr org.tr com.ua gov.ua com.pl edu.pl gov.pl net.pl org.pl "
    "com.ru co.at or.at ac.at gv.at com.gr edu.gr gov.gr com.pt edu.pt gov.pt com.es nom.es org.es com.eg edu.eg gov.eg com.ng edu.ng gov.ng co.ke ac.ke go.ke com.sa edu.sa gov.sa com.pk edu.pk gov.pk"
).split()


def bare(host: Column) -> Column:
    """host without user name, port and a closing dot."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*\z", ""), r"\.\z", "")


def _address(name: Column) -> Column:
    return name.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z")


def suffix_of(host: Column) -> Column:
    name = bare(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_address(name), "ip").when(two.isin(SECOND_LEVEL), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    name = bare(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_address(name), name).when(two.isin(SECOND_LEVEL), F.substring_index(name, ".", -3)).otherwise(two)


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0, by Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return series - sum((F.log(x + i) for i in range(1, 8)), F.log(x))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def beta_probability(x: Column, a: Column, b: Column) -> Column:
    """P(X <= x) of the beta distribution, 0 < x < 1, by its continued fraction (Lentz's method), whose terms needed grow with the root of a + b."""
    swap = x > (a + 1) / (a + b + 2)
    held = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def value(v: Column) -> Column:
        p, q, z = v["p"], v["q"], v["z"]
        front = F.exp(v["beta"] + p * F.log(z) + q * F.log(1 - z)) / p

        def step(s: Column, k: Column) -> Column:
            m = F.floor(k / 2).cast("double")
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            bound = _let(F.when(k % 2 == 0, even).otherwise(odd), lambda d: F.struct(held(1 + d / s["c"]).alias("c"), (1 / held(1 + d * s["e"])).alias("e"), s["f"].alias("f")))
            return _let(bound, lambda t: F.struct(t["c"].alias("c"), t["e"].alias("e"), (t["f"] * t["c"] * t["e"]).alias("f")))

        # the term of k = 1 opens the fraction
        first = _let(1 / held(1 - (p + q) * z / (p + 1)), lambda e: F.struct(F.lit(1.0).alias("c"), e.alias("e"), e.alias("f")))
        return front * F.aggregate(F.sequence(F.lit(2), (24 + 2 * F.sqrt(p + q)).cast("int")), first, step, lambda s: s["f"])

    sides = F.struct(F.when(swap, b).otherwise(a).alias("p"), F.when(swap, a).otherwise(b).alias("q"), F.when(swap, 1 - x).otherwise(x).alias("z"), (_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)).alias("beta"))
    found = _let(sides, value)
    return F.when(swap, 1 - found).otherwise(found)


def beta_quantile(a: Column, b: Column, level: float, steps: int = 20) -> Column:
    """The value that the beta distribution stays below with probability level, by bisection; above a + b = 10,000 by the normal distribution, which is near it there."""
    ends = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        def half(mid: Column) -> Column:
            return _let(beta_probability(mid, a, b) < level, lambda below: F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))

        return _let((s["lo"] + s["hi"]) / 2, half)

    exact = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    n = a + b
    return F.when(n <= 10_000, exact).otherwise(a / n + NormalDist().inv_cdf(level) * F.sqrt(a * b / (n * n * (n + 1))))


def shrunk(counts: DataFrame, level: str, above: list[str], prior: Column) -> DataFrame:
    """counts (level, above.., bad, n, and the prior's mean) with the level's posterior a, b.

    The prior strength k is the method of moments over the members of each
    parent: var(rate) = m(1-m)(1/n' + (1-1/n')/(k+1)), held within 1 to 200.
    """
    joint = counts.withColumn("_prior", prior)
    spread = joint.groupBy(*above).agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("_prior"), 2)).alias("_sq"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_members"), F.first("_prior").alias("_m")
    )
    noise = F.col("_m") * (1 - F.col("_m"))
    share = (F.col("_sq") - F.col("_members") * noise) / F.greatest((F.col("_n") - F.col("_members")) * noise, F.lit(1e-9))
    k = F.least(F.greatest(1 / F.greatest(share, F.lit(1e-3)) - 1, F.lit(1.0)), F.lit(200.0)).alias("_k")
    return joint.join(spread.select(*above, k), above).withColumn("a", F.col("bad") + F.col("_k") * F.col("_prior")).withColumn("b", F.col("n") - F.col("bad") + F.col("_k") * (1 - F.col("_prior"))).drop("_k", "_prior")


def reputation(outcomes: DataFrame, level: float = 0.05) -> DataFrame:
    """Per labelled host, domain and suffix: level, name, a, b, the lower bound of the posterior share of bad pages, and the base rate.

    outcomes: (host, bad) with bad true, false or null (not labelled). Each
    posterior is a beta distribution of a and b; it lies below the bound with
    probability `level`. base is the rate of all outcomes.
    """
    hosts = outcomes.where("bad IS NOT NULL").groupBy("host").agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"))
    hosts = materialise(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    whole = suffixes.agg(F.sum("bad").alias("_bad"), F.sum("n").alias("_all")).withColumn("top", F.lit(1))
    # half a pseudo-outcome of each kind keeps the top rate inside (0, 1)
    rate = (F.col("_bad") + 0.5) / (F.col("_all") + 1)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    s = shrunk(suffixes.withColumn("top", F.lit(1)).join(whole, "top"), "suffix", ["top"], rate)
    s = materialise(s.select("suffix", "a", "b"))
    d = shrunk(domains.join(s.select("suffix", mean.alias("_up")), "suffix"), "domain", ["suffix"], F.col("_up"))
    d = materialise(d.select("suffix", "domain", "a", "b"))
    h = shrunk(hosts.join(d.select("domain", mean.alias("_up")), "domain"), "host", ["domain"], F.col("_up"))
    named = lambda df, kind: df.select(F.lit(kind).alias("level"), F.col(kind).alias("name"), "a", "b")
    all_levels = named(h, "host").unionByName(named(d, "domain")).unionByName(named(s, "suffix"))
    all_levels = all_levels.withColumn("top", F.lit(1)).join(whole.select("top", rate.alias("base")), "top").drop("top")
    return materialise(all_levels.withColumn("bound", beta_quantile(F.col("a"), F.col("b"), level)))


def judge(pages: DataFrame, outcomes: DataFrame, limit: float | None = None, level: float = 0.05, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and the posterior bound that the method judged by.

    outcomes: (page_id, bad) of some pages. limit: the bound above which a host
    is blocked; None takes the rate of all outcomes, so hosts are blocked that
    are worse than the whole with probability 1 - level.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).drop("url")
    shown = rows.select("page_id", "host").distinct()
    bounds = reputation(outcomes.select("page_id", "bad").join(shown, "page_id").select("host", "bad"), level)
    hosts = rows.select("host").distinct()
    most = F.col("base") if limit is None else F.lit(limit)
    of = lambda kind, to: bounds.where(F.col("level") == kind).select(F.col("name").alias(kind), F.struct("bound", (F.col("bound") > most).alias("bad")).alias(to))
    best = (
        hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
        .join(of("host", "_h"), "host", "left").join(of("domain", "_d"), "domain", "left").join(of("suffix", "_s"), "suffix", "left")
        .select("host", F.coalesce("_h", "_d", "_s").alias("_judged"))
    )
    verdicts = materialise(best.select("host", "_judged.bound", "_judged.bad"))
    rule = listed(F.col("host"), F.col("path"), rules)
    said = F.create_map(*[F.lit(x) for r in rules for x in r])
    method = F.when(F.col("bad"), "block").otherwise("allow")
    out = rows.join(verdicts, "host", "left").withColumn("rule", rule)
    return out.select("page_id", "host", "path", "rule", F.coalesce(F.try_element_at(said, F.col("rule")), method).alias("verdict"), "bound")
