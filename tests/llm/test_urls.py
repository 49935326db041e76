import random
import re

import pytest
from pyspark.sql import functions as F

from kestrel.llm import urls
from kestrel.llm.catalog import RULES


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [(len(t), t, v) for v, t in RULES
           if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return max(fit)[1:] if fit else (None, None)


def plain_site(host):
    labels = re.sub(r":[0-9]*$", "", host).split(".")
    n = 2 if ".".join(labels[-2:]) in urls.TWO_LABEL_SUFFIXES else 1
    return ".".join(labels[-n - 1:]), ".".join(labels[-n:])


def plain_weight(groups):
    groups = [(n, k) for n, k in groups if n]
    total, good = sum(n for n, _ in groups), sum(k for _, k in groups)
    rho = urls.RHO[0]
    if total > len(groups) and 0 < good < total:
        p = good / total
        rho = (sum(n * (k / n - p) ** 2 for n, k in groups) / (p * (1 - p)) - len(groups)) / (total - len(groups))
    rho = min(max(rho, urls.RHO[0]), urls.RHO[1])
    return (1 - rho) / rho


def plain_bounds(hosts, z=1.645):
    def summed(key):
        out = {}
        for h, (n, k) in hosts.items():
            a, b = out.get(key(h), (0, 0))
            out[key(h)] = (a + n, b + k)
        return out
    domains, suffixes = summed(plain_site), summed(lambda h: plain_site(h)[1])
    top = (sum(k for _, k in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    ws, wd, wh = (plain_weight(g.values()) for g in (suffixes, domains, hosts))
    out = {}
    for h, (n, k) in hosts.items():
        d = plain_site(h)
        s = (suffixes[d[1]][1] + ws * top) / (suffixes[d[1]][0] + ws)
        m = (domains[d][1] + wd * s) / (domains[d][0] + wd)
        a, b = k + wh * m, n - k + wh * (1 - m)
        out[h] = a / (a + b) - z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
    return out


URLS = [None, "", "no scheme.com/x", "http://", "http://COM/", "http://com", "https://a.Example.com/en/1?x=://y", "http://example.com/en", "HTTP://www.example.com/en/#t",
        "http://x.www.example.com/en/z", "http://notexample.com/en/", "http://example.net/es/", "ftp://example.net?/es/", "http://exÄmple.net/fr/\nline", "x://y://z/fr/",
        "http://net/fr/a", "http://shop.co.uk:8080/a", "http://a.b.co.uk/", "http://10.0.0.1/x", "http://evil.org/1" + "a" * 30000]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    host, path = urls.url_parts(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path)
    rule, verdict = urls.rule_for(F.col("host"), F.col("path"), RULES)
    for r in df.select("url", "host", "path", rule.alias("rule"), verdict.alias("verdict")).collect():
        assert (r.host, r.path) == plain_parts(r.url)
        assert (r.rule, r.verdict) == plain_rule(r.host, r.path)


def test_verdicts_match_a_plain_version(spark):
    rnd = random.Random(2)
    hosts = [f"{h}.{d}" for d, hs in (("good.org", "abc"), ("bad.org", "abcdefg"), ("mixed.co.uk", "ab"), ("rare.net", "a")) for h in hs]
    pages, outcomes = [], []
    for i in range(1500):
        h = rnd.choice(hosts)
        pages.append((i, f"http://{h}/en/{i}", "clash"))
        if rnd.random() < 0.4:
            outcomes.append((i, int(rnd.random() < (0.1 if "bad" in h else 0.9))))
    pages += [(5000 + i, u, "") for i, u in enumerate(URLS)] + [(None, "http://new.bad.org/", ""), (None, "http://new.good.org/", ""), (3, "http://twice.org/", "")]
    outcomes += [(3, 0), (3, 1), (4, None), (None, 0), (99999, 0)]
    got = urls.judged(spark.createDataFrame(pages, "page_id long, url string, host string").repartition(3), spark.createDataFrame(outcomes, "id long, good int"), RULES).collect()
    told = {}
    for i, g in outcomes:
        if i is not None and g is not None:
            told[i] = min(g, told.get(i, 1))
    counts = {}
    for i, u, _ in pages:
        h = plain_parts(u)[0]
        n, k = counts.get(h, (0, 0))
        counts[h] = (n + (i in told), k + told.get(i, 0))
    bounds = plain_bounds(counts)
    want = [(i, *plain_parts(u), *(plain_rule(*plain_parts(u)))) for i, u, _ in pages]
    want = [(i, h, p, r, v or ("allow" if bounds[h] >= 0.5 else "block")) for i, h, p, r, v in want]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    by = {r.host: r.verdict for r in got if r.rule is None}
    assert by["a.good.org"] == "allow" and by["a.bad.org"] == "block" and by["new.bad.org"] == "block" and by["new.good.org"] == "allow"


def test_sites_by_the_longest_suffix_and_addresses_of_their_own(spark):
    want = {"a.shop.com.sg": ("shop.com.sg", "com.sg"), "x.com.hk:80": ("x.com.hk", "com.hk"), "b.x.co.id": ("x.co.id", "co.id"), "me.github.io": ("me.github.io", "github.io"),
            "w.me.blogspot.com": ("me.blogspot.com", "blogspot.com"), "me.blogspot.co.uk": ("me.blogspot.co.uk", "blogspot.co.uk"), "github.io": ("github.io", "github.io"),
            "a.b.example.com": ("example.com", "com"), "a.b.co.uk": ("b.co.uk", "co.uk"), "localhost": ("localhost", "localhost"), "": ("", ""),
            "10.0.0.1": ("10.0.0.1", "[ip]"), "10.9.0.1:8080": ("10.9.0.1", "[ip]"), "[2001:db8::1]:80": ("[2001:db8::1]", "[ip]"), "1.2.3.4.com": ("4.com", "com")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    parts = lambda *how: {r.host: (r.d, r.s) for r in df.select("host", urls.site_parts(F.col("host"), *how)[0].alias("d"), urls.site_parts(F.col("host"), *how)[1].alias("s")).collect()}
    assert parts() == want
    assert parts(["example.com", "b.example.com"])["a.b.example.com"] == ("a.b.example.com", "b.example.com")
    assert parts([])["b.x.co.id"] == ("co.id", "id")
    # a stranger's pages under the same suffix weigh less than those of the own site
    counts = spark.createDataFrame([(f"h.bad{i}.com.sg", 40, 2) for i in range(6)] + [("a.good.com.sg", 40, 40), ("new.good.com.sg", 0, 0)] + [(f"g{i}.org", 40, 40 - i) for i in range(6)], "host string, n long, k long")
    bound = lambda *how: {r.host: r.bound for r in urls.reputations(counts, 1.645, *how).collect()}["new.good.com.sg"]
    assert bound() > bound(urls.TWO_LABEL_SUFFIXES)


def test_bounds_match_a_plain_version(spark):
    rnd = random.Random(7)
    hosts = {f"h{i}.d{i % 7}.{'org' if i % 3 else 'co.uk'}": (n := rnd.randrange(40), rnd.randrange(n + 1)) for i in range(60)}
    got = urls.reputations(spark.createDataFrame([(h, n, k) for h, (n, k) in hosts.items()], "host string, n long, k long")).collect()
    assert {r.host: r.bound for r in got} == pytest.approx(plain_bounds(hosts))


def test_no_labels_no_rules_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    none = spark.createDataFrame([], "id long, good int")
    (row,) = urls.judged(pages, none, []).collect()
    assert (row.host, row.rule, row.verdict) == ("a.b", None, "block" if plain_bounds({"a.b": (0, 0)})["a.b"] < 0.5 else "allow")
    assert urls.judged(pages.filter("false"), none, RULES).count() == 0
