"""URL filters: allow and block rules, and an empirical-Bayes reputation of hosts for what no rule decides.

A host's labelled pages are k good ones of n. Their rate is shrunk from the top down: the suffix's towards that of
all labelled pages, the registered domain's towards its suffix's, the host's towards its domain's. Each level's
prior is a beta distribution around the parent's rate; its weight comes from the data by the method of moments for
the beta-binomial (groups that differ more than chance would have it weigh their parent less). A page is allowed if
the lower bound of its host's posterior, mean less ``z`` standard deviations, reaches ``least``; a host without
labelled pages is judged by its domain's prior alone. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import lower_ascii, stage

# The public suffixes of two labels that the SQL knows too.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn",
                      "com.mx", "com.tr", "gov.uk", "net.au", "ne.jp", "or.jp", "org.au", "org.uk")
#: The list shipped: much used entries of the public suffix list, by first labels, without its wildcards. It is a parameter
#: (``suffixes``) of what judges hosts; any other suffix is the last label.
SUFFIXES = tuple(sorted({*TWO_LABEL_SUFFIXES, *(f"{first}.{last}" for first, lasts in {
    "com": "af ag ai al ar au az ba bb bd bh bm bn bo br bs by bz ci cn co cu cy dm do dz ec ee eg es et fj fr ge gh gi gl gr gt gu gy hk hn hr ht im iq jm jo "
           "kg ki kw ky kz la lb lc lk lr lv ly mg mk ml mm mo ms mt mu mv mw mx my na ng ni nr om pa pe pf ph pk pl pr ps pt py qa re ro sa sb sc sd sg sl sn "
           "so st sv sy tj tm tn to tr tt tw ua ug uy uz vc ve vi vn vu ws ye zm",
    "co": "ag ao at bb bi bw ca ci cr gg gy hu id il im in it je jp ke kr ls ma me mu mw mz na nz om pn pw rs rw st sz th tj tt tz ug uk us uz ve vi za zm zw",
    "org": "ae af ag al ar au az ba bb bd bh bm bn bo br bs bw bz ci cn co cu cy do dz ec ee eg es et fj ge gg gh gi gr gt hk hn ht hu il im in iq je jm jo kg "
           "kw ky kz la lb lk lv ly ma me mg mk mo mt mu mv mw mx my mz na ng ni nz om pa pe ph pk pl pr ps pt py qa ro rs ru sa sd sg sv sy tm tn tr tt tw ua "
           "ug uk uy uz ve vn za zm zw",
    "net": "ae ar au az ba bd bh bo br cn co cy do dz ec eg ge gg gr gt hk id il im in iq je jo kw kz lb lk lv ly ma me mk mo mt mu mx my mz ng ni nz om pa pe "
           "ph pk pl ps pt py qa ru sa sg sy th tn tr tt tw ua uk uy uz ve vn za",
    "gov": "ae ar au az ba bd bh br by cn co cy do dz ec eg ge gh gr hk ie il in iq it jo kw kz lb lk lt lv ly ma mk mo mt mx my ng om ph pk pl ps pt qa rs ru "
           "sa sg si sy tn tr tt tw ua uk vn za zw",
    "edu": "ar au az ba bd bh bo br cn co cy do dz ec ee eg es et ge gh gr gt hk hn in iq it jm jo kw kz lb lk lv ly mk mo mt mx my ng ni om pa pe ph pk pl ps "
           "pt py qa rs ru sa sg sv sy tr tt tw ua uy ve vn za",
    "ac": "ae at be bw ci cn cr cy fj gn id il im in ir jp ke kr ma me mu mw mz ni nz rs ru rw se sz th tz ug uk vn za zm zw",
    "go": "ci cr id jp ke kr th tz ug", "or": "at bi ci cr id it jp ke kr mu na th tz ug us", "ne": "jp ke kr tz ug us", "gob": "ar bo cl do ec es gt hn mx ni pa pe sv ve",
    "gouv": "ci fr ht km ml sn", "govt": "nz", "gub": "uy", "mil": "ar br cn co id in kr pl tr za", "nom": "br co es fr", "geek": "nz", "school": "nz", "maori": "nz",
    "ad": "jp", "ed": "ao cr jp", "gr": "it jp", "lg": "jp", "re": "kr", "pe": "kr", "asn": "au", "id": "au ir lv", "ltd": "uk cn", "me": "uk tz", "plc": "uk", "sch": "id uk ae lk",
    "nhs": "uk", "police": "uk", "web": "app id tr za", "my": "id", "biz": "id pk tr", "desa": "id", "firm": "in", "gen": "in nz tr", "ind": "in br", "nic": "in", "res": "in",
    "gc": "ca", "idv": "hk tw", "per": "sg", "info": "pl tr", "waw": "pl", "muni": "il", "k12": "il tr", "art": "br", "blog": "br", "eco": "br", "adv": "br", "in": "th ua rs",
    "kiev": "ua", "kyiv": "ua", "priv": "at no hu", "asso": "fr", "tm": "fr hu", "msk": "ru", "spb": "ru",
    # suffixes that hosting firms registered
    "github": "io", "gitlab": "io", "readthedocs": "io", "blogspot": "com de fr jp in ca it nl ru mx co.uk com.au com.br com.ar com.es com.tr co.id co.il co.nz co.za", "wordpress": "com",
    "herokuapp": "com", "appspot": "com", "wixsite": "com", "myshopify": "com", "weeblysite": "com", "firebaseapp": "com", "onrender": "com", "s3": "amazonaws.com", "netlify": "app",
    "vercel": "app", "fly": "dev", "pages": "dev", "workers": "dev", "azurewebsites": "net", "cloudfront": "net", "glitch": "me", "surge": "sh", "repl": "co"}.items() for last in lasts.split())}))
#: Bounds of the correlation within a group, so that a prior weighs 1 to 999 pages.
RHO = (0.001, 0.5)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    path what follows up to ``?``, ``#`` or the end. Null or without ``://``: both empty."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. Rules are (verdict, host and path's start);
    a rule fits its host and all subdomains. Of equal rules a block counts. They are parameters, not data: each is
    a condition of the plan."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def site_parts(host: Column, suffixes: Iterable[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, less its port: the longest of ``suffixes`` (up to three labels) that it
    ends with, else its last label, and one label more. An IP address is a domain of its own, under the suffix [ip]."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    address = F.rlike(name, F.lit(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"))
    domain, suffix = F.when(address, name), F.when(address, F.lit("[ip]"))
    for n in (3, 2):
        listed = last(n).isin(*sorted(s for s in set(suffixes) if s.count(".") == n - 1))
        domain, suffix = domain.when(listed, last(n + 1)), suffix.when(listed, last(n))
    return domain.otherwise(last(2)), suffix.otherwise(last(1))


def prior_weight(groups: DataFrame) -> DataFrame:
    """One row, ``w``: the pages that a prior of ``groups`` (n, k) weighs."""
    sums = groups.filter("n > 0").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.expr("k * k / n")).alias("kk"))
    # sum of n (k/n - p)^2 is sum of k^2/n less p sum of k; by chance alone it is p (1 - p) for each group
    p = F.col("k") / F.col("n")
    over = (F.col("kk") - p * F.col("k")) / (p * (1 - p)) - F.col("g")
    rho = F.when((F.col("n") > F.col("g")) & (p > 0) & (p < 1), over / (F.col("n") - F.col("g"))).otherwise(F.lit(RHO[0]))
    rho = F.least(F.greatest(rho, F.lit(RHO[0])), F.lit(RHO[1]))
    return sums.select(((1 - rho) / rho).alias("w"))


def reputations(hosts: DataFrame, z: float = 1.645, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """(host, bound) from ``hosts`` (host, n, k: labelled pages and good ones, each host once)."""
    domain, suffix = site_parts(F.col("host"), suffixes)
    hosts = stage(hosts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    counted = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = counted(hosts, "domain", "suffix")
    suffixes = counted(domains, "suffix")
    every = suffixes.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("rate"))
    shrunk = lambda rate, w: (F.col("k") + w * rate) / (F.col("n") + w)
    weigh = lambda df: prior_weight(df).scalar()
    suffixes = suffixes.select("suffix", shrunk(every.scalar(), weigh(suffixes)).alias("suffix_rate"))
    domains = (domains.withColumn("w", weigh(domains)).join(suffixes, "suffix")
               .select("domain", "suffix", shrunk(F.col("suffix_rate"), F.col("w")).alias("domain_rate")))
    hosts = hosts.withColumn("w", weigh(hosts)).join(domains, ["domain", "suffix"])
    a = F.col("k") + F.col("w") * F.col("domain_rate")
    b = F.col("n") - F.col("k") + F.col("w") * (1 - F.col("domain_rate"))
    return hosts.select("host", (a / (a + b) - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
           z: float = 1.645, least: float = 0.5, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict), one row per input row; verdict is the rule's, else by the host's reputation.

    ``outcomes`` (id, good) labels pages 1 or 0; of several labels of a page the worst counts, null ones don't. Pages
    without host share the empty one. No labelled page at all: every host stands at the prior of 1/2. Null and
    repeated ids are rows like others; null ids are unlabelled. Empty table: no rows. ``suffixes`` are the public
    suffixes of two and three labels, in lower case, as :func:`site_parts` takes them.

    Pages are counted per host before anything else is done with hosts, and the bounds come back by a join with one
    row per host, which Spark can split for a host with a third of all pages.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    told = outcomes.filter("good IS NOT NULL").groupBy("id").agg(F.min("good").cast("long").alias("good")).withColumnRenamed("id", "_id")
    counts = (rows.join(told, F.col("id") == F.col("_id"), "left").groupBy("host")
              .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k")))
    bounds = stage(reputations(counts, z, suffixes), "hosts-judged")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= least, F.lit("allow")).otherwise(F.lit("block"))
    return rows.join(bounds, "host").select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
