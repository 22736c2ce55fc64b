import math
import random
import re
from collections import defaultdict

from tablehaul.llm import hosts


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fits = [r for r in hosts.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(str(r)), default=None)


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/12?x#y", "http://example.org", "http://example.org/", "http://notexample.org/es/1", "http://x.com/fr/2",
    "http://x.com/de/?q", "http://X.COM/de", "a://b://c/d", "http://x.net?a=/fr/", "http://user@x.com:80/fr/", "http://ÄÖ.com/de/", "http://h\nx.com/de/\n", "http://example.org/es/../en/1", "http://com/de/",
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    for r in hosts.judge(df, none, keep=("page_id", "url")).collect():
        assert (r.host, r.path) == split(r.url)
        want = rule(r.host, r.path)
        assert (r.rule, r.verdict) == ((str(want), want.verdict) if want else (None, "allow"))


def names_of(host):
    bare = re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", host))
    if re.fullmatch(r"([0-9]{1,3}\.){3}[0-9]{1,3}", bare) or bare.startswith("["):
        return "#", bare
    labels = bare.split(".")
    size = 2 if ".".join(labels[-2:]) in hosts.SUFFIXES else 1
    return ".".join(labels[-size:]), ".".join(labels[-size - 1 :])


def weight_of(members, fallback):
    """members: list of (group, n, bad)."""
    groups = defaultdict(list)
    for g, n, bad in members:
        groups[g].append((n, bad))
    a = b = c = 0.0
    for m in groups.values():
        n, bad = sum(x for x, _ in m), sum(y for _, y in m)
        share = bad / n
        a += sum(x * (y / x - share) ** 2 for x, y in m)
        b += share * (1 - share) * (len(m) - 1)
        c += share * (1 - share) * (n - sum(x * x for x, _ in m) / n)
    if c - b <= 1e-9:
        return fallback
    return hosts.MOST_WEIGHT if a <= b else min(max((c - b) / (a - b) - 1, hosts.LEAST_WEIGHT), hosts.MOST_WEIGHT)


def reputation(outcomes, asked):
    """host -> (mean, lower bound), level by level."""
    def total(rows):
        out = defaultdict(lambda: [0.0, 0.0])
        for g, n, bad in rows:
            out[g][0] += n
            out[g][1] += bad
        return out

    def alike(n, bad, weight):
        size = n / (1 + (n - 1) / (weight + 1))
        return size, bad / n * size

    def posterior(n, bad, weight, mean):
        return (bad + weight * mean) / (n + weight), n + weight

    by_host = total((h, 1, bad) for h, bad in outcomes)
    w_h = weight_of([(names_of(h), n, bad) for h, (n, bad) in by_host.items()], hosts.LEVEL_WEIGHT)
    by_domain = total((names_of(h), *alike(n, bad, w_h)) for h, (n, bad) in by_host.items())
    w_d = weight_of([(s, n, bad) for (s, _), (n, bad) in by_domain.items()], hosts.STRANGERS)
    by_suffix = total((s, *alike(n, bad, w_d)) for (s, _), (n, bad) in by_domain.items())
    w_s = weight_of([((), n, bad) for n, bad in by_suffix.values()], hosts.PRIOR_WEIGHT)
    (n, bad), = total([((), 0.0, 0.0), *(((), *alike(n, bad, w_s)) for n, bad in by_suffix.values())]).values()
    top = (bad + hosts.PRIOR_BAD * hosts.PRIOR_WEIGHT) / (n + hosts.PRIOR_WEIGHT)
    out = {}
    for h in asked:
        s, d = names_of(h)
        mean, sure = posterior(*by_suffix.get(s, (0, 0)), w_s, top)
        mean, sure = posterior(*by_domain.get((s, d), (0, 0)), 1 / (1 / w_d + 1 / sure), mean)
        mean, sure = posterior(*by_host.get(h, (0, 0)), 1 / (1 / w_h + 1 / sure), mean)
        out[h] = (mean, mean - hosts.Z * math.sqrt(mean * (1 - mean) / (sure + 1)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "host string, bad int")


def test_reputation_against_plain_python(spark):
    pick = random.Random(4)
    rows = [("bad.a.net", 1)] * 60 + [("few.a.net", 1)] * 2 + [("good.b.net", 0)] * 50 + [("good.b.net", 1)] + [("x.c.info:8080", 0)] * 3 + [("u@10.1.2.3:80", 1)] * 4 + [("[::1]:9", 0)] * 2
    for i in range(300):
        rows.append((f"h{pick.randrange(40)}.d{i % 9}.{pick.choice(['com', 'co.uk', 'org'])}", int(pick.random() < (i % 9) / 9)))
    asked = sorted({h for h, _ in rows} | {"new.a.net", "new.d3.co.uk", "new.nowhere.co.uk", "a.b.c.zz", "10.1.2.4", "co.uk", "x"})
    got = {r.host: (r.mean, r.lower) for r in hosts.reputations(frame(spark, [(h, 0) for h in asked + asked[:3]]), frame(spark, rows + [(None, 1), ("y", None)])).collect()}
    want = reputation(rows, asked)
    assert set(got) == set(want)
    assert all(abs(a - b) < 1e-9 for h in want for a, b in zip(got[h], want[h]))


def judged(spark, outcomes, *urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return [r.verdict for r in sorted(hosts.judge(pages, frame(spark, outcomes)).collect(), key=lambda r: r.page_id)]


def test_domains_speak_for_hosts_nobody_has_labelled(spark):
    assert judged(spark, [("old.spam.net", 1)] * 300, "http://new.spam.net/", "http://old.spam.net/") == ["block"] * 2
    rows = [("bad.a.net", 1)] * 60 + [("few.a.net", 1)] * 2 + [("good.b.net", 0)] * 50 + [("good.b.net", 1)]
    assert judged(spark, rows, "http://few.a.net/", "http://good.b.net/x", "http://new.a.net/", "http://new.b.net/") == ["block", "allow", "block", "allow"]
    # hosts of one domain that differ say little about a new one
    mixed = [(f"u{i}.home.net", i % 2) for i in range(40) for _ in range(30)]
    assert judged(spark, mixed, "http://u1.home.net/", "http://u2.home.net/", "http://new.home.net/") == ["block", "allow", "allow"]


def test_long_suffixes_and_addresses(spark):
    rows = [("a.co.uk", 1)] * 300 + [("b.co.uk", 0)] + [("10.1.2.3", 1)] * 50 + [("10.9.2.3", 0)] * 50
    assert judged(spark, rows, "http://a.co.uk/", "http://b.co.uk/", "http://10.1.2.3:80/", "http://10.9.2.3/") == ["block", "allow", "block", "allow"]
    df = frame(spark, [(h, 0) for h in ("10.1.2.3", "x.y.co.uk", "y.co.uk", "co.uk", "uk", "a.b.c", "[::1]:8")])
    got = {r.host: (r.suffix, r.domain) for r in df.withColumns(hosts.levels(df.host)).collect()}
    assert got == {h: names_of(h) for h in got}
    three = {r.host: (r.suffix, r.domain) for r in df.withColumns(hosts.levels(df.host, ["a.b.c", "y.co.uk"])).collect()}
    assert three["x.y.co.uk"] == ("y.co.uk", "x.y.co.uk") and three["a.b.c"] == ("a.b.c", "a.b.c") and three["co.uk"] == ("uk", "co.uk")


def test_very_long_urls_and_repeated_pages(spark):
    long = "http://h." + "x" * 30_000 + ".net/" + "p/" * 30_000 + "?" + "q" * 30_000
    assert judged(spark, [("h." + "x" * 30_000 + ".net", 1)] * 50, long, long, "http://" + "a." * 5000 + "net/") == ["block", "block", "allow"]


def test_empty_and_clashing(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/5", 9, 9, 9)], "page_id long, url string, host int, n int, lower int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = hosts.judge(pages, hosts.page_outcomes(pages, none)).first()
    assert (row.host, row.path, row.verdict) == ("a.b", "/en/5", "allow")
    assert hosts.judge(pages.limit(0), hosts.page_outcomes(pages, none)).count() == 0
    odd = spark.createDataFrame([(5, 0, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert hosts.reputations(hosts.with_host(pages).select("host"), hosts.page_outcomes(pages, odd)).first().bad == 1
