"""URL filter: rules by host and path, and an empirical-Bayes reputation of hosts, in DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgram.llm.text import aside
from loomgram.tables import keep, table

#: A-Z and a-z: hosts are lower-cased in these letters only. Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels; any other suffix is a host's last label. A longer list can be given.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
#: (host, path, verdict) of the rules of the registered query. Fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: A host is blocked if less than this share of its pages is good, with at least this probability.
LEAST_GOOD, CERTAINTY = 0.5, 0.95
#: A key with over a 1000th of all rows is hot: there are under HOT of them, whatever the input.
HOT = 1000
#: Smallest and largest correlation of two outcomes under one host, domain or suffix: a prior weighs 1 to 9,999 pages.
LEAST, MOST = 1e-4, 0.5


def _rest(url: Column) -> Column:
    """The url after its first ://; empty for null and without one."""
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null and without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _tail(labels: Column, n: int) -> Column:
    """The last n labels, or all if there are fewer, joined by dots."""
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), F.lit(n)), ".")


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host: the suffix is its last two labels if they are listed, else the last one, and
    the domain has one label more. User names, ports and a last dot don't count; an IPv4 address is its own domain,
    without suffix; of a host that is no more than a suffix both are the host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:[0-9]*)?$|\.(:[0-9]*)?$", "")
    labels = F.split(bare, r"\.")
    listed = _tail(labels, 2).isin(*suffixes) if suffixes else F.lit(False)
    address = bare.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    domain = F.when(address, bare).when(listed, _tail(labels, 3)).otherwise(_tail(labels, 2))
    return domain, F.when(address, F.lit("")).when(listed, _tail(labels, 2)).otherwise(_tail(labels, 1))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of size, rule (host and path in one) and verdict of the longest rule that fits, null if none does.

    A rule fits its host and all hosts under it, if the path starts with the rule's. The rules are a literal of the plan,
    looked up by the last labels of a host, no more of them than the longest rule has. Of rules of one length the one
    that sorts last wins, block after allow.
    """
    if not rules:
        return F.lit(None).cast("struct<size int, rule string, verdict string>")
    by_host: dict[str, list[Column]] = {}
    for h, p, verdict in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(p).alias("path")))
    known = F.create_map(*(x for h, own in by_host.items() for x in (F.lit(h), F.array(*own))))
    labels, most = F.split(host, r"\."), max(h.count(".") + 1 for h in by_host)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    met = F.flatten(F.filter(F.transform(ends, lambda e: F.try_element_at(known, e)), lambda x: x.isNotNull()))
    fit = F.filter(met, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fit, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _looked_up(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """rows (key never null) joined with facts, which has one row for each key and its number of rows, weight.

    Under HOT keys can have over a HOTth of all rows each: those few facts are broadcast, so that the rows of a hot key
    stay where they are; all other rows meet in a shuffle join.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = facts.where(F.col(weight) > total / HOT).drop(weight)
    cold = facts.where(F.col(weight) <= total / HOT).drop(weight)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def _shrunk(level: DataFrame, prior: Column) -> tuple[DataFrame, float]:
    """(level with mean, weight of the prior in pages): posterior means of the good share under beta-binomial counts n, good.

    prior: the expected share of each row. How much it weighs is fitted to the spread of the level's own shares by moments:
    the correlation of two outcomes of one row is what their variance has over that of independent pages.
    """
    m = prior
    seen = level.where("n > 0")
    extra = F.sum((F.col("good") / F.col("n") - m) * (F.col("good") / F.col("n") - m) * F.col("n") - m * (1 - m))
    r = seen.agg(F.try_divide(extra, F.sum(m * (1 - m) * (F.col("n") - 1))).alias("rho")).first()
    rho = min(MOST, max(LEAST, r["rho"] if r["rho"] is not None else LEAST))
    weight = 1 / rho - 1
    return level.withColumn("mean", (F.col("good") + F.lit(weight) * m) / (F.col("n") + F.lit(weight))), weight


def reputations(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, certainty: float = CERTAINTY) -> DataFrame:
    """hosts (host, pages, n, good) plus domain, suffix, mean, lower and upper: the share of good pages of each host.

    The overall share is the prior of suffixes, a suffix's posterior mean that of its registered domains, a domain's that of its
    hosts. lower and upper hold with probability `certainty` at least, each by itself (Cantelli's inequality on the beta
    posterior's mean and deviation). A host without outcomes (n = 0) has its domain's mean; without any outcome
    all shares come from an even prior.
    """
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = keep(hosts.withColumns({"domain": domain, "suffix": suffix}))
    sums = [F.sum(c).cast("long").alias(c) for c in ("n", "good")]
    domains = keep(hosts.groupBy("domain", "suffix").agg(*sums, F.count(F.lit(1)).alias("hosts")))
    ends = keep(domains.groupBy("suffix").agg(*sums, F.count(F.lit(1)).alias("domains")))
    all_ = ends.agg(*sums).first()
    overall = ((all_["good"] or 0) + 1) / ((all_["n"] or 0) + 2)
    ends, _ = _shrunk(ends, F.lit(overall))
    domains = _looked_up(domains, ends.select("suffix", F.col("mean").alias("above"), "domains"), "suffix", "domains")
    domains, _ = _shrunk(keep(domains), F.col("above"))
    hosts = _looked_up(hosts, domains.select("domain", F.col("mean").alias("above"), "hosts"), "domain", "hosts")
    out, weight = _shrunk(keep(hosts), F.col("above"))
    size = F.col("n") + F.lit(weight)
    wide = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1)) * math.sqrt(certainty / (1 - certainty))
    return out.withColumn("lower", F.greatest(F.lit(0.0), F.col("mean") - wide)).withColumn("upper", F.least(F.lit(1.0), F.col("mean") + wide)).drop("above")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", suffixes: tuple[str, ...] = SUFFIXES, least_good: float = LEAST_GOOD, certainty: float = CERTAINTY) -> DataFrame:
    """pages plus host, path, rule, labelled, good_share, good_at_most and verdict (allow or block).

    outcomes: labelled pages as counts (host, n, good). The verdict is that of the longest rule that fits, if any (see
    best_rule()); else block if the host's share of good pages is under least_good with probability `certainty` (its
    good_at_most is below it), allow if that is not known. Every row of pages comes back once, repeated ones too; a null url and one
    without :// have the empty host, which is a host like any other. Columns of pages with one of the new names come
    back as aside() names them.
    """
    pages, moved = aside(pages, "host", "path", "rule", "verdict", "labelled", "good_share", "good_at_most")
    place = F.col(moved.get(url, url))
    rows = pages.withColumns({"host": host_of(place), "path": path_of(place)})
    counts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hosts = hosts.join(counts, "host", "left").select("host", "pages", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "good")))
    known = keep(reputations(hosts, suffixes, certainty).select("host", "pages", F.col("n").alias("labelled"), F.col("mean").alias("good_share"), F.col("upper").alias("good_at_most")))
    facts = known.withColumnRenamed("pages", "weight_of_host")
    best = best_rule(F.col("host"), F.col("path"), rules)
    out = _looked_up(rows, facts, "host", "weight_of_host").withColumn("rule", best)
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("good_at_most") < least_good, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).withColumn("rule", F.col("rule.rule"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, good of the labelled pages: the last number of a path names the document that the page shows.

    A page is good if its document's labels say quality 1 and not toxic; with several labels of a document, if all say so.
    Pages and labels are counted by host and document, and by document, before they meet, so that no key is hot.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"^.*/([0-9]{1,18})(?![0-9])", 1)
    shown = pages.select(host_of(F.col("url")).alias("host"), number.try_cast("long").alias("doc_id"))
    shown = shown.where("doc_id is not null").groupBy("host", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    good = F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(good.alias("good"))
    met = shown.join(known, "doc_id")
    return met.groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"))


def op13_urls(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, labelled of every page; labels are those of the documents that pages show."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict", "labelled")


def _level(name: str, below: str, key: str, above: str, prior: str) -> str:
    """SQL of a level: its counts with the prior's mean m, the fitted correlation and the shrunk mean."""
    return f"""{name}_m AS (SELECT l.*, {prior} AS m FROM {below} l {above}),
{name}_r AS (SELECT least({MOST}, greatest({LEAST}, coalesce((SELECT sum((good / n - m) * (good / n - m) * n - m * (1 - m)) / nullif(sum(m * (1 - m) * (n - 1)), 0) FROM {name}_m WHERE n > 0), {LEAST})))::DOUBLE AS rho),
{name}_s AS (SELECT t.*, n + 1 / rho - 1 AS size, (good + (1 / rho - 1) * m) / (n + 1 / rho - 1) AS mean FROM {name}_m t, {name}_r)"""


ORACLE = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), shown AS (
  SELECT host, TRY_CAST(regexp_extract(path, '^.*/([0-9]{{1,18}})($|[^0-9])', 1) AS BIGINT) AS doc_id FROM parts
), known AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), counts AS (
  SELECT host, count(*) AS n, sum(good) AS good FROM shown JOIN known USING (doc_id) GROUP BY host
), bare AS (
  SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?$|\\.(:[0-9]*)?$', '') AS b FROM parts
), cut AS (
  SELECT host, b, regexp_matches(b, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') AS address, regexp_extract(b, '[^.]*$') AS one, regexp_extract(b, '([^.]*\\.)?[^.]*$') AS two, regexp_extract(b, '([^.]*\\.)?([^.]*\\.)?[^.]*$') AS three FROM bare
), hosts AS (
  SELECT host, CASE WHEN address THEN b WHEN two IN {SUFFIXES} THEN three ELSE two END AS domain, CASE WHEN address THEN '' WHEN two IN {SUFFIXES} THEN two ELSE one END AS suffix,
    CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(good, 0) AS BIGINT) AS good FROM cut LEFT JOIN counts USING (host)
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
ends AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
overall AS (SELECT (sum(good) + 1)::DOUBLE / (sum(n) + 2) AS mean FROM ends),
{_level("e", "ends", "suffix", ", overall o", "o.mean")},
{_level("d", "domains", "domain", "JOIN e_s a USING (suffix)", "a.mean")},
{_level("h", "hosts", "host", "JOIN d_s a USING (domain)", "a.mean")},
known_hosts AS (SELECT host, n AS labelled, mean + sqrt(mean * (1 - mean) / (size + 1)) * sqrt({CERTAINTY} / (1 - {CERTAINTY})) AS upper FROM h_s),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN upper < {LEAST_GOOD} THEN 'block' ELSE 'allow' END AS verdict, labelled
FROM ruled JOIN known_hosts USING (host)
"""
