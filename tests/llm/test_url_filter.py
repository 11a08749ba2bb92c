import random
import re

import pytest
from pyspark.sql import functions as F

from declcensus.llm import url_filter as U
from declcensus.llm.queries import URL_RULES

AWKWARD = [
    None, "", "no scheme", "://", "http://", "http://ORG/", "https://a.Example.ORG/en/1?x=1", "https://example.org/en/2#a/es/",
    "http://notexample.org/es/", "http://example.org", "http://com/fr/x", "http://x.com/de/?q", "http://x.com?/fr/", "x://y://org/",
    "http://É.ORG/", "http://a.net/" + "p/" * 5000, "http://a.net/100%25?a=1&b=2&b=2", "http://u:p@h.com:80/fr/", "http://a.net/\nb?c",
]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def urls(spark):
    pick = random.Random(1)
    rows = list(enumerate(AWKWARD))
    for k in range(400):
        host = pick.choice(["", "www.", "m."]) + pick.choice("abc") + pick.choice([".example.org", ".com", ".net", ".example.org"])
        path = pick.choice(["/es/", "/en/", "/fr/", "/de/"]) + str(pick.randrange(300))
        rows.append((100 + k, "https://" + host + path + pick.choice(["", "?a=1", "#t"])))
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")


def test_hosts_paths_and_rules_match_plain_parsing(urls):
    got = U.judge(urls, URL_RULES).collect()
    known = {r["page_id"]: r["url"] for r in urls.collect()}
    assert len(got) == len(known)
    for r in got:
        host, path = parsed(known[r["page_id"]])
        rule, verdict = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_trees_learn_what_the_rules_say(urls):
    """Of URLs that the rules decide, the trees give most the same verdict."""
    got = U.judge(urls, URL_RULES).filter("rule IS NOT NULL")
    same = (F.col("block_probability") > 0.5) == (F.col("verdict") == "block")
    assert got.agg(F.avg(same.cast("int"))).first()[0] > 0.95


def test_one_kind_or_no_labels(urls, spark):
    assert {r["verdict"] for r in U.judge(urls, []).collect()} == {"allow"}
    assert {r["verdict"] for r in U.judge(urls, [("block", "com", "/")]).collect()} == {"block"}
    assert U.judge(urls.limit(0), URL_RULES).count() == 0


def test_bound_on_training_rows(urls):
    assert U.judge(urls, URL_RULES, train_rows=150).count() == urls.count()


def test_lexical_features_match_plain_ones(spark):
    import math
    from collections import Counter

    urls = [u for u in AWKWARD if u is None or len(u) < 5000] + ["http://a-b.c-d.org/x1/yy22/z?q=1&r=&s", "https://h.net/?#f", "http://h.net/a?b#c?d&e"]
    rows = U.with_parts(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "id long, url string"))
    got = rows.select("id", "host", "path", *[c.alias(n) for n, c in U._lexical(F.col("url")).items()]).collect()
    for r in got:
        url = urls[r["id"]] or ""
        host, path = parsed(urls[r["id"]])
        assert (r["host"], r["path"]) == (host, path)
        counts, some = Counter(url), max(1, len(url))
        query = re.search(r"\?([^#]*)", url)
        query = query[1] if query else ""
        expected = {
            "length": len(url), "host_length": len(host), "path_length": len(path), "depth": len(re.findall("/[^/]", path)),
            "labels": len(re.findall(r"[^.]+", host)), "digits": len(re.findall("[0-9]", url)) / some,
            "letters": len(re.findall("[A-Za-z]", url)) / some, "hyphens": host.count("-"),
            "entropy": -sum(n / some * math.log2(n / some) for n in counts.values()),
            "parameters": query.count("&") + 1 if query else 0, "fragment": float("#" in url),
            "longest_segment": max((len(x) for x in path.split("/")), default=0),
        }
        assert {n: r[n] for n in expected} == pytest.approx(expected), url
