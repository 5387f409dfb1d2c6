import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from perilgrid.llm.url_filter import RULES, _log_ratios, judge_urls

URLS = [
    None,
    "",
    "no scheme.net/en/",
    "http://Blog.Example.NET/en/1?x://y",
    "http://example.net/en",
    "https://badexample.net/en/",
    "http://net/",
    "http://net",
    "http://x.net#/en/",
    "ftp://m.example.com/de/7#top",
    "http://example.com/fr/7",
    "http://ÉCOLE.org/fr/é",
    "a\nb://h.org/fr/\n?",
    "http://" + "a" * 20000 + ".org/fr/" + "é" * 20000,
]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    return re.sub("[A-Z]", lambda c: c[0].lower(), host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "clash", "x") for i, u in enumerate(URLS)] + [(None, URLS[3], None, None), (3, URLS[3], "y", "z")]
    got = judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string, _url string")).collect()
    want = []
    for i, u, *_ in rows:
        h, p = parts(u)
        want.append((str(i), h, p, *rule(h, p)))
    assert sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=str) == sorted(want, key=str)
    assert all(r.verdict in ("allow", "block") for r in got)


def test_models_against_brute_force(spark):
    a, r, order = ["abab", "abc"], ["bbb", "cab"], 2
    seen = Counter()
    for side, urls in (("a", a), ("r", r)):
        for u in urls:
            s = "\u0002" * order + u
            seen.update((side, s[i : i + order + 1]) for i in range(len(u)))
    grams = sorted({g for _, g in seen} | {"zab"})
    df = spark.createDataFrame([(g, seen["a", g], seen["r", g]) for g in grams], "_gram string, _a bigint, _r bigint")
    got = {x[0]: x[1] for x in _log_ratios(df, order).collect()}
    chars = {g[-1] for g in grams}

    def prob(side, gram):
        below = prob(side, gram[1:]) if len(gram) > 1 else 1 / (len(chars) + 1)
        follow = defaultdict(int)
        for (s, g), n in seen.items():
            if s == side and g[-len(gram) :][:-1] == gram[:-1]:
                follow[g[-1]] += n
        n, t = sum(follow.values()), len(follow)
        return (follow[gram[-1]] + t * below) / (n + t) if n else below

    for g in grams:
        assert math.isclose(got[g], math.log10(prob("a", g) / prob("r", g)), abs_tol=1e-9)


def test_models_tell_the_sides_apart(spark):
    rows = [(i, f"http://shop{i}.cheapdeals.net/buy/{i}") for i in range(200)]
    rows += [(1000 + i, f"http://ecole{i}.lycee.org/fr/cours/{i}") for i in range(200)]
    rows += [(5000 + i, f"http://shop{i}.cheapdeals.biz/buy/{i}") for i in range(20)]
    rows += [(6000 + i, f"http://ecole{i}.lycee.edu/fr/cours/{i}") for i in range(20)]
    got = judge_urls(spark.createDataFrame(rows, "page_id int, url string"))
    by = {(r.side, r.verdict): r["count"] for r in got.filter("rule is null").groupBy((F.col("page_id") >= 6000).alias("side"), "verdict").count().collect()}
    assert by == {(False, "block"): 20, (True, "allow"): 20}


def test_empty_and_undecided_tables(spark):
    schema = "page_id bigint, url string"
    assert judge_urls(spark.createDataFrame([], schema)).count() == 0
    got = judge_urls(spark.createDataFrame([(1, "http://a.b/c"), (2, None)], schema)).collect()
    assert [r.verdict for r in got] == ["allow", "allow"]
