"""URL rules and empirical-Bayes host reputation, in DataFrame functions only.

A host's rate of bad pages is shrunk through beta-binomial priors: the overall rate is the prior of
every public suffix, a suffix that of its registered domains, a domain that of its hosts. How
strongly a level is pulled to its parents comes from the spread of its counts (moments). A host is
blocked if a lower posterior bound of its rate exceeds the limit. Counts are exact integers at every
level; each level is one row a group and is written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Fixed values: (verdict, host, start of the path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Public suffixes of two labels under which domains are registered; all others have one label.
TWO_LABELS = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au", "co.nz", "org.nz", "net.nz", "ac.nz", "govt.nz",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "ac.kr", "go.kr", "re.kr",
    "com.cn", "net.cn", "org.cn", "edu.cn", "gov.cn", "com.tw", "org.tw", "edu.tw", "com.hk", "org.hk", "edu.hk", "com.sg", "edu.sg",
    "co.in", "net.in", "org.in", "ac.in", "gov.in", "co.id", "ac.id", "or.id", "co.th", "ac.th", "in.th", "com.my", "com.ph", "com.vn", "edu.vn",
    "com.br", "net.br", "org.br", "gov.br", "edu.br", "com.ar", "gob.ar", "com.mx", "org.mx", "gob.mx", "com.co", "edu.co", "com.pe", "com.ve", "com.ec", "com.uy",
    "co.za", "org.za", "ac.za", "gov.za", "co.ke", "or.ke", "com.ng", "org.ng", "com.eg", "com.gh", "co.tz", "co.ug",
    "com.tr", "org.tr", "edu.tr", "gov.tr", "co.il", "org.il", "ac.il", "com.sa", "com.pk", "org.pk", "edu.pk", "com.bd",
    "com.ua", "org.ua", "net.ua", "com.pl", "net.pl", "org.pl", "edu.pl", "com.es", "org.es", "com.pt", "com.gr", "co.at", "or.at", "ac.at", "co.hu", "com.ro",
)
#: Number of a document at the end of a path, with a slash or a file ending or nothing behind it.
_NUMBER = r"/([0-9]{1,18})(?:/|[.][^/]*)?\z"
_IP = r"^([0-9]+([.][0-9]+){3}|\[.*)\z"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ReputationParams:
    max_bad_rate: float = 0.3
    z: float = 1.645

    def __post_init__(self):
        if not 0 < self.max_bad_rate < 1 or self.z < 0:
            raise ValueError("max_bad_rate must be in (0, 1) and z at least 0")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null or without "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path joined; null if none) and its verdict. A rule fits its host
    and all subdomains of it where the path starts with the rule's."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def site(host: Column) -> tuple[Column, Column, Column]:
    """Host without user and port, its registered domain and its public suffix. An address is its own domain, without a suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), r":[0-9]*\z", "")
    ip = bare.rlike(_IP)
    two = F.substring_index(bare, ".", -2).isin(*TWO_LABELS)
    domain = F.when(ip, bare).when(two, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    suffix = F.when(ip, F.lit("")).when(two, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    return bare, domain, suffix


def _level(counts: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """Posterior (key, n, bad, prior, m) of every group of ``counts`` (key, parent, n, bad) under its parent's rate, from
    which the group's own pages are taken out: ``prior`` bad pages of ``m`` are added to the group's own.

    The intraclass correlation r solves sum of n (bad/n - p)^2 / (p (1 - p)) = K + r (N - K) over K groups
    with N pages; the prior weighs 1/r - 1 pages, and one at least. ``p`` lies between 0 and 1: parents keep exact
    counts, of which the group's are a part, and a prior above 0.
    """
    above = parents.select(parent, F.col("n").alias("_n"), F.col("bad").alias("_bad"), "prior", "m")
    p = (F.col("prior") + (F.col("_bad") - F.col("bad"))) / (F.col("m") + (F.col("_n") - F.col("n")))
    both = written(counts.join(above, parent).select(key, "n", "bad", p.alias("p")), f"reputation-{key}")
    spread = both.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("p"), 2) / (F.col("p") * (1 - F.col("p")))).alias("s"),
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("k"),
    ).first()
    r = (spread["s"] - spread["k"]) / (spread["total"] - spread["k"]) if (spread["total"] or 0) > spread["k"] else 0.5
    m = 1 / min(0.5, max(0.001, r)) - 1
    return both.select(key, "n", "bad", (F.col("p") * m).alias("prior"), F.lit(m).alias("m"))


def reputations(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors of hosts, domains, suffixes and everything from (host, bad) rows with bad 0 or 1; nulls are left out."""
    bare, domain, suffix = site(F.col("host"))
    seen = outcomes.where("host is not null and bad is not null")
    hosts = written(seen.groupBy(bare.alias("site")).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("bad")).withColumn("domain", site(F.col("site"))[1]).withColumn("suffix", site(F.col("site"))[2]), "reputation-counts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("all", F.lit(1))
    root = written(suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).select(F.lit(1).alias("all"), "n", "bad", F.lit(0.5).alias("prior"), F.lit(1.0).alias("m")), "reputation-root")
    by_suffix = _level(suffixes, "suffix", root, "all")
    by_domain = _level(domains, "domain", by_suffix, "suffix")
    return _level(hosts, "site", by_domain, "domain"), by_domain, by_suffix, root


def judge(pages: DataFrame, outcomes: DataFrame, params: ReputationParams | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and bad_rate (the host's posterior mean) of every page.

    Rules come first; other pages get ``block`` where the lower bound of the bad rate of their host (or,
    without outcomes, of its domain, suffix or everything) exceeds ``max_bad_rate``. Repeated rows give
    equal rows; null URLs have an empty host, judged like any other; other columns are dropped. Joins are by host,
    domain and suffix with one row a key on the other side: small ones are broadcast by their size, and
    AQE splits the hot keys of large ones.
    """
    params = params or ReputationParams()
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("_verdict", verdict)
    by_host, by_domain, by_suffix, root = reputations(outcomes)
    rate, weight = (F.col("prior") + F.col("bad")) / (F.col("m") + F.col("n")), F.col("m") + F.col("n")
    named = lambda df, key, n: df.select(key, rate.alias(f"r{n}"), weight.alias(f"w{n}"))
    bare, domain, suffix = site(F.col("host"))
    hosts = parts.select("host").distinct().select("host", bare.alias("site"), domain.alias("domain"), suffix.alias("suffix"))
    known = hosts.join(named(by_host, "site", 1), "site", "left").join(named(by_domain, "domain", 2), "domain", "left").join(named(by_suffix, "suffix", 3), "suffix", "left")
    everything = named(root, "all", 4).first()
    rate = F.coalesce("r1", "r2", "r3", F.lit(everything["r4"]))
    weight = F.coalesce("w1", "w2", "w3", F.lit(everything["w4"]))
    bound = rate - params.z * F.sqrt(rate * (1 - rate) / (weight + 1))
    judged = written(known.select("host", rate.alias("bad_rate"), F.when(bound > params.max_bad_rate, F.lit("block")).otherwise(F.lit("allow")).alias("_by_host")), "reputation-judged")
    out = parts.join(judged, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", "_by_host").alias("verdict"), "bad_rate")


def page_outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, bad) of the pages whose path ends with a labelled document's number, as ``/7``, ``/7/`` or ``/7.html``; bad is ``toxic``."""
    host, path = host_and_path(F.col(url_col))
    numbered = pages.select(host.alias("host"), F.regexp_extract(path, _NUMBER, 1).try_cast("long").alias("doc_id")).where("doc_id is not null")
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("bad"))
    return numbered.join(marked, "doc_id").select("host", "bad")


def oracle_sql(params: ReputationParams | None = None, rules=RULES) -> str:
    """DuckDB SQL for ``judge`` over pages with ``page_outcomes`` (without bad_rate)."""
    params = params or ReputationParams()
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in ordered) + " end"
    verdict = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in ordered) + " end"

    def level(key: str, counts: str, parents: str, parent: str) -> str:
        p = "((q.prior + (q.bad - c.bad)) / (q.m + (q.n - c.n)))"
        return f"""select b.{key}, b.n, b.bad, b.p * w.m as prior, w.m from
        (select c.*, {p} as p from {counts} c join {parents} q using ({parent})) b,
        (select 1 / least(0.5, greatest(0.001, case when sum(c.n) > count(*) then (sum(c.n * pow(c.bad / c.n - {p}, 2) / ({p} * (1 - {p}))) - count(*)) / (sum(c.n) - count(*)) else 0.5 end)) - 1 as m
         from {counts} c join {parents} q using ({parent})) w"""

    label = lambda n: f"array_to_string(list_slice(string_split(site, '.'), -{n}, -1), '.')"
    two = f"{label(2)} in ({', '.join(repr(t) for t in TWO_LABELS)})"
    ip = f"regexp_matches(site, '{_IP}')"
    post = lambda t: f"({t}.prior + {t}.bad) / ({t}.m + {t}.n)"
    return f"""
    with rest as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    split_url as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from rest),
    sites as (select *, regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*\\z', '') as site from split_url),
    parts as (select page_id, host, path, site, case when {ip} then site when {two} then {label(3)} else {label(2)} end as domain,
        case when {ip} then '' when {two} then {label(2)} else {label(1)} end as suffix from sites),
    outcomes as (select site, domain, suffix, bad from parts join (select doc_id, max(toxic)::bigint as bad from labels where doc_id is not null and toxic is not null group by 1) l
        on l.doc_id = try_cast(regexp_extract(path, '{_NUMBER}', 1) as bigint)),
    hosts as (select site, domain, suffix, count(*) as n, sum(bad)::bigint as bad from outcomes group by all),
    domains as (select domain, suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from hosts group by all),
    suffixes as (select suffix, 1 as one, sum(n)::bigint as n, sum(bad)::bigint as bad from domains group by all),
    root as (select 1 as one, coalesce(sum(n), 0)::bigint as n, coalesce(sum(bad), 0)::bigint as bad, 0.5::double as prior, 1::double as m from suffixes),
    by_suffix as ({level("suffix", "suffixes", "root", "one")}),
    by_domain as ({level("domain", "domains", "by_suffix", "suffix")}),
    by_host as ({level("site", "hosts", "by_domain", "domain")}),
    scored as (select p.page_id, p.host, p.path, coalesce({post("h")}, {post("d")}, {post("s")}, {post("r")}) as rate, coalesce(h.m + h.n, d.m + d.n, s.m + s.n, r.m + r.n) as weight
        from parts p left join by_host h using (site) left join by_domain d using (domain) left join by_suffix s using (suffix) cross join root r)
    select page_id, host, path, {rule} as rule,
        coalesce({verdict}, case when rate - {params.z} * sqrt(rate * (1 - rate) / (weight + 1)) > {params.max_bad_rate} then 'block' else 'allow' end) as verdict
    from scored
    """
