"""URL verdicts against plain string tests; the filter against a set."""

import random
import re

from streamops.llm import url_filter as uf
from streamops.llm.common import prepare

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
         ("block", "Shop.example.org"), ("allow", "shop.example.org/item"), ("block", "org/fr/"), ("allow", None),
         (None, "com/"), ("block", "/x"), ("allow", "a.b/" + "p" * 70_000)]
LISTED = ["example.com/bad?x=1", "example.com/bad", "deep.example.com", None, "example.com/bad"]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split(r"[/?#]", rest)[0])
    before = re.split(r"[?#]", rest)[0]
    path = before[before.index("/"):] if "/" in before else ""
    fits = []
    for verdict, rule in RULES:
        if not rule or not verdict or rule.startswith("/"):
            continue
        name, slash, tail = rule.partition("/")
        if (host == name.lower() or host.endswith("." + name.lower())) and path.startswith(slash + tail):
            fits.append((len(rule), verdict, name.lower() + slash + tail))
    if fits:
        _, verdict, rule = max(fits)
        return host, path, rule, verdict
    query = re.match(r"[^?#]*\?([^#]*)", url or "")
    kept = sorted(p for p in (query[1].split("&") if query else [])
                  if p and not re.match(r"(utm_[a-z]+|ref)(=|$)", p))
    whole = re.sub(r"^www\.", "", host) + re.sub(r"/+\Z", "", path) + ("?" + "&".join(kept) if kept else "")
    return host, path, None, "block" if host and whole in LISTED else "allow"


def test_verdicts_equal_plain_tests(spark):
    prepare(spark)
    rnd = random.Random(2)
    hosts = ["net", "example.net", "www.EXAMPLE.net", "anexample.com", "example.com", "www.example.com", "a.b.example.com",
             "shop.example.org", "m.shop.example.org", "example.org", "deep.example.com", "", "net:80", "." * 5000, "a.b"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/y//", "/bad", "/bad/", "/item/2", "/" + "p" * 70_001, "/x\ny/"]
    ends = ["", "?", "?x=1", "?utm_source=a&x=1&ref=q", "#net/en/", "?a=/en/", "?&&x=1"]
    urls = [f"{rnd.choice(['http', 'https', ''])}://{h}{p}{e}" for h in hosts for p in paths for e in ends]
    urls += [None, "", "no scheme/en/", "://", "http://x://net/", urls[3], urls[3]] + ["http://example.net/de/"] * 200
    pages = spark.createDataFrame([(k, u, "own", "kept") for k, u in enumerate(urls)],
                                  "page_id int, url string, rule string, key string")
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    found = uf.judge(pages, rules, listed)
    assert found.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert len(got) == len(urls) and got == {k: plain(u) for k, u in enumerate(urls)}
    empty = uf.judge(pages, rules.limit(0), listed.limit(0))
    assert {r.verdict for r in empty.select("verdict").distinct().collect()} == {"allow"}
    assert uf.judge(pages.limit(0), rules, listed).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    prepare(spark)
    keys = spark.range(5000).selectExpr("concat('host', id, '.com/') AS key", "concat('host', id, '.com/') AS rule")
    found = uf.build(keys)
    assert found.passes([f"host{k}.com/".encode() for k in range(5000)]).all()
    assert found.passes([f"other{k}.com/".encode() for k in range(20_000)]).mean() < 0.01
    crowded = uf.build(keys, most=64)
    assert crowded.passes([f"host{k}.com/".encode() for k in range(5000)]).all()
