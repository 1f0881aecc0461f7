"""URL filters: empirical-Bayes reputation of hosts, in DataFrame functions only.

Outcomes of labelled pages are counted by host, rolled up to registered domain and to
suffix. Each level's bad rate is shrunk towards its parent's by a beta-binomial prior
whose strength is fitted by moments from the level's own spread: host to domain, domain
to suffix, suffix to all. A parent's rate leaves out the member's own outcomes, which would
count twice. A host's posterior is a beta distribution; the host is blocked
if its lower posterior bound, the quantile at 1 - CONFIDENCE, exceeds the limit: that is, if
the rate lies above the limit with a probability of CONFIDENCE or more. Hosts without
labels take their domain's posterior, at its strength.

Registered domains come from suffix rules in the format of the public suffix list: a
suffix on a line, `*.` before it for any one label, `!` for an exception, `//` for remarks.

Explicit rules come first: a rule `domain/path` fits the domain and all its subdomains
where the url's path starts with its path; the longest rule wins.

Defined results: a null url or one without `://` has empty host and path, no rule, and is
allowed; a page with no label counts for nothing; repeated labels count each; an empty
table gives an empty result; hosts are aggregated before any join, so a host with a
third of all pages is one row in them, and the page side of the join carries no other
columns than id and url. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Common suffixes of two labels, for want of a copy of the public list; `suffixes`
#: takes the lines of a whole one. Hosts that no rule fits have a suffix of one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "com.mx", "co.in", "co.nz", "co.za", "com.tr", "com.ar")
#: Bad rate that the lower posterior bound must exceed, and the bound's confidence.
LIMIT, CONFIDENCE = 0.5, 0.95
#: Steps of an integral's half, and its reach: v in -REACH..REACH for log-odds of mode + deviation * sinh(v).
STEPS, REACH = 96, 8.0
#: Prior strength (pseudo-pages) where a level has too little spread or too few members to fit one.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit(""), F.substr(url, F.instr(url, "://") + 3)), "#", 1))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both empty for null urls and urls without `://`."""
    rest = F.coalesce(after_scheme(F.col(url)), F.lit(""))
    before_query = F.substring_index(rest, "?", 1)
    host = F.substring_index(before_query, "/", 1)
    path = F.substr(before_query, F.length(host) + 1)
    return pages.withColumns({"host": common.ascii_lower(host), "path": path})


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    domain, slash, start = rule.partition("/")
    return ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)


def matched_rule(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest of the rules that fit, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r), r))
    return F.coalesce(*(F.when(rule_fits(r, host, path), F.lit(r)) for r in ordered)) if ordered else F.lit(None).cast("string")


class Suffixes:
    """Rules that say where a host's registered domain starts."""

    def __init__(self, lines: Iterable[str] = TWO_LABEL_SUFFIXES):
        rules = {line.split()[0].lower() for line in lines if line.strip() and not line.strip().startswith("//")}
        self.exceptions = sorted(r[1:] for r in rules if r.startswith("!"))
        self.any_label = sorted(r[2:] for r in rules if r.startswith("*."))
        self.plain = sorted(r for r in rules if r[0] not in "!*")
        self.longest = max([1, *(r.count(".") + 1 for r in self.plain), *(r.count(".") + 2 for r in [*self.any_label, *self.exceptions])])

    def labels(self, host: Column) -> Column:
        """How many labels of the host are its suffix: by an exception, else the longest rule, else 1."""
        last = lambda n: F.substring_index(host, ".", -n)
        found = F.lit(1)
        for n in range(2, self.longest + 1):
            fits = last(n).isin(*self.plain) if self.plain else F.lit(False)
            fits |= last(n - 1).isin(*self.any_label) & (last(n) != last(n - 1)) if self.any_label else F.lit(False)
            found = F.when(fits, n).otherwise(found)
        for n in range(2, self.longest + 1):
            found = F.when(last(n).isin(*self.exceptions), n - 1).otherwise(found) if self.exceptions else found
        return found

    def suffix(self, host: Column) -> Column:
        return self._last(host, 0)

    def domain(self, host: Column) -> Column:
        """The suffix and one label more; hosts that are numbers stand alone."""
        return F.when(host.rlike(r"^[0-9.]+$|:"), host).otherwise(self._last(host, 1))

    def _last(self, host: Column, more: int) -> Column:
        labels, out = self.labels(host), F.substring_index(host, ".", -1 - more)
        for n in range(2, self.longest + 1):
            out = F.when(labels == n, F.substring_index(host, ".", -n - more)).otherwise(out)
        return out


def chance_above(limit: float, alpha: Column, beta: Column) -> Column:
    """Probability that a beta variate exceeds the limit. Both sides of the limit are integrated by
    Simpson's rule over the log-odds, where the density is one smooth hump for any alpha and beta."""
    mode, deviation = F.log(alpha / beta), F.sqrt((alpha + beta) / (alpha * beta))
    level = float(math.log(limit / (1 - limit)))

    def log_density(u: Column) -> Column:
        fold = F.log1p(F.exp(-F.abs(u)))
        return alpha * (F.least(u, F.lit(0.0)) - fold) + beta * (F.least(-u, F.lit(0.0)) - fold)

    def integral(low: Column, high: Column) -> Column:
        step = (high - low) / STEPS

        def term(i: Column) -> Column:
            v = low + step * i
            weight = F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return weight * F.exp(log_density(mode + deviation * F.sinh(v)) - log_density(mode)) * F.cosh(v)

        return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda total, i: total + term(i)) * step

    cut = F.least(F.greatest(F.asinh((F.lit(level) - mode) / deviation), F.lit(-REACH)), F.lit(REACH))
    below, above = integral(F.lit(-REACH), cut), integral(cut, F.lit(REACH))
    return above / (below + above)


def _strength(counts: DataFrame, parent: list[str]) -> DataFrame:
    """Beta-binomial strength of a level's members about their parent's rate, by moments:
    with p the pooled rate and s2 the weighted variance of members' rates, the
    overdispersion is rho = (s2/(p(1-p)) - mean(1/n)) / (1 - mean(1/n)); strength = 1/rho - 1."""
    pooled = F.sum("bad") / F.sum("n")
    sums = counts.filter("n > 0").groupBy(*parent).agg(
        pooled.alias("p"), F.count(F.lit(1)).alias("members"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"), F.sum("bad").alias("b"), F.sum("n").alias("nn"),
    )
    spread = (F.col("bb") - F.col("b") * F.col("p")) / F.col("nn")
    noise = F.col("members") / F.col("nn")
    rho = F.try_divide(F.try_divide(spread, F.col("p") * (1 - F.col("p"))) - noise, 1 - noise)
    fitted = F.when((F.col("p") > 0) & (F.col("p") < 1) & (noise < 1) & (rho > 0), F.try_divide(F.lit(1.0), rho) - 1).otherwise(MOST_STRENGTH)
    return sums.select(*parent, F.least(F.greatest(fitted, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)).alias("strength"))


def reputation(pages: DataFrame, outcomes: DataFrame, limit: float = LIMIT, suffixes: Suffixes | None = None) -> DataFrame:
    """host, domain, suffix, n, bad, mean, alpha, beta, chance (that the rate is above the limit; null
    where the mean is too low for CONFIDENCE: it is never below chance * limit) for every host of the pages.

    pages: page_id, host; outcomes: page_id, bad (0 or 1), any number a page."""
    rules = suffixes or Suffixes()
    seen = outcomes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = (
        pages.select("page_id", "host").join(seen, "page_id", "left").groupBy("host")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
        .withColumns({"domain": rules.domain(F.col("host")), "suffix": rules.suffix(F.col("host")), "everything": F.lit(1)})
    )
    roll = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = roll(hosts, "domain", "suffix", "everything")
    suffixes = roll(domains, "suffix", "everything")
    above = lambda key, n, bad, prior, strength: [key, n.alias("up_n"), bad.alias("up_bad"), prior.alias("up_prior"), strength.alias("up_strength")]
    whole = roll(suffixes, "everything").select(*above("everything", F.col("n"), F.col("bad"), F.lit(0.5), F.lit(1.0)))

    def shrunk(level: DataFrame, parents: DataFrame, key: str, strengths: DataFrame) -> DataFrame:
        """Adds prior and strength: pseudo-pages of the parent's other members, and how many of them are bad."""
        joined = level.join(parents, key).join(strengths, "everything", "left").withColumn("strength", F.coalesce("strength", F.lit(MOST_STRENGTH)))
        rate = (F.col("up_bad") - F.col("bad") + F.col("up_prior")) / (F.col("up_n") - F.col("n") + F.col("up_strength"))
        return joined.withColumn("prior", F.col("strength") * rate)

    # strengths are pooled over a whole level: one row each, as `whole`, so their broadcast is bounded
    pooled = lambda level: F.broadcast(_strength(level, ["everything"]))
    own = [F.col(c) for c in ("n", "bad", "prior", "strength")]
    s = shrunk(suffixes, F.broadcast(whole), "everything", pooled(suffixes))
    d = shrunk(domains, s.select(*above("suffix", *own)), "suffix", pooled(domains))
    h = shrunk(hosts, d.select(*above("domain", *own)), "domain", pooled(hosts))
    bare = F.col("n") == 0
    alpha = F.when(bare, F.col("up_bad") + F.col("up_prior")).otherwise(F.col("bad") + F.col("prior"))
    total = F.when(bare, F.col("up_n") + F.col("up_strength")).otherwise(F.col("n") + F.col("strength"))
    found = h.select("host", "domain", "suffix", "n", "bad", (alpha / total).alias("mean"), alpha.alias("alpha"), (total - alpha).alias("beta"))
    return found.withColumn("chance", F.when(F.col("mean") >= CONFIDENCE * limit, chance_above(limit, F.col("alpha"), F.col("beta"))))


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], limit: float = LIMIT, suffixes: Suffixes | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), bad_rate, bad_chance for every page."""
    parts = with_parts(pages.select("page_id", "url"))
    known = reputation(parts, outcomes, limit, suffixes)
    rule = matched_rule(rules, F.col("host"), F.col("path"))
    verdict_of = F.create_map(*(F.lit(x) for r, v in rules.items() for x in (r, v))) if rules else F.create_map().cast("map<string,string>")
    judged = parts.join(known.select("host", F.col("mean").alias("bad_rate"), F.col("chance").alias("bad_chance")), "host", "left").withColumn("rule", rule)
    blocked = (F.col("host") != "") & (F.col("bad_chance") >= CONFIDENCE)
    return judged.select("page_id", "host", "path", "rule", F.coalesce(verdict_of[F.col("rule")], F.when(blocked, "block").otherwise("allow")).alias("verdict"), "bad_rate", "bad_chance")
