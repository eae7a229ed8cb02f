"""The URL filter against plain Python: parts, listed rules, mined rules and verdicts."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tillscope.llm import urlrules


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def listed(host, path):
    fits = [(len(h + p), h + p, kind) for kind, h, p in urlrules.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def words(text, part):
    return {part + ("0" if re.fullmatch(r"\d+", w) else w) for w in re.split(r"[\W_]+", text.lower()) if w}


def tokens(url):
    if url is None:
        return set()
    host, path = parts(url)
    asked = re.match(r"[^?#]*\?([^#]*)", url.split("://", 1)[1]) if "://" in url else None
    scheme = url.split("://", 1)[0] if "://" in url else ""
    return words(scheme, "s:") | words(host, "h:") | words(path, "p:") | words(asked[1] if asked else "", "q:")


def mined(labelled, support, least, confidence):
    """All sets of tokens, by brute force."""
    known = [(frozenset(tokens(u)), b) for u, b in labelled if u is not None and b is not None]
    least = max(least, int(support * len(known)))
    every = sorted(set().union(*[t for t, _ in known]) if known else [])
    where = {t: frozenset(i for i, (s, _) in enumerate(known) if t in s) for t in every}
    where = {t: w for t, w in where.items() if least <= len(w) < len(known)}
    kept = {}
    for t in sorted(where):
        kept.setdefault(where[t], t)
    items = sorted(kept.values())
    rules = {}
    for k in range(1, len(items) + 1):
        for combination in itertools.combinations(items, k):
            held = [b for s, b in known if s.issuperset(combination)]
            if sum(held) >= least and held and sum(held) / len(held) >= confidence:
                rules[frozenset(combination)] = (sum(held) / len(held), sum(held) / len(known))
    return {r: v for r, v in rules.items() if not any(s < r and rules[s][0] >= v[0] for s in rules)}


ODD = [None, "", "no address", "://", "http://", "http://NET/x", "http://net", "http://a.net/", "http://xnet/", "HTTP://Sub.EXAMPLE.net/en/1", "https://example.com/de/", "https://example.com/de", "https://example.com.org/fr/?q=1", "ftp://a.org/fr/#x", "x://example.net/EN/", "http://É.org/fr/", "a?u=http://b.net/", "http://u:p@c.net:80/", "http://c.net\n/x", "http://example.net?/en/", "x" * 100_000 + "://a.com/" + "y/" * 50_000]


def test_parts_and_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(ODD)] + [(None, "http://a.net/", 1), (3, None, 1)], "page_id long, url string, host int")
    rows = urlrules.judge(pages.select("*", *[F.lit(1).alias(c) for c in ("path", "rule", "tokens", "filed", "_id", "_url", "confidence")]), urlrules.mine(pages.select("url", F.lit(False).alias("bad")))).collect()
    expected = []
    for i, u in [*enumerate(ODD), (None, "http://a.net/"), (3, None)]:
        rule, kind = listed(*parts(u))
        expected.append((i, *parts(u), rule, kind or "allow"))
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows), key=repr) == sorted(expected, key=repr)
    assert urlrules.judge(pages.limit(0), urlrules.mine(pages.limit(0).select("url", F.lit(True).alias("bad")))).collect() == []


def test_tokens(spark):
    urls = [*ODD[:-1], "https://Spam-Farm.example.org/win/12/a_b%20c?id=7&ref=x#q", "http://日本.jp/ü/ß1/2"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", urlrules.tokens(F.col("url")).alias("t")).collect()
    for r in rows:
        assert len(set(r["t"] or [])) == len(r["t"] or []) and set(r["t"] or []) == tokens(r["url"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_against_all_sets(spark, seed):
    rng = random.Random(seed)
    hosts, paths, extras = ["a", "b", "win", "shop"], ["en", "de", "buy"], ["", "?ref=x", "?utm=feed", "?utm=feed&tag=t"]
    labelled = []
    for i in range(300):
        url = f"http://{rng.choice(hosts)}.{rng.choice(hosts)}.com/{rng.choice(paths)}/{i}{rng.choice(extras)}"
        bad = ("win" in url and "buy" in url) or ("shop" in url and rng.random() < 0.6)
        labelled.append((url, bad if rng.random() < 0.95 else None))
    labelled += [(None, True)] * 5
    rules = urlrules.mine(spark.createDataFrame(labelled, "url string, bad boolean"), min_support=0.02, min_count=5, min_confidence=0.7)
    got = {frozenset(r["tokens"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in rules.collect()}
    expected = mined(labelled, 0.02, 5, 0.7)
    assert got == {k: (round(a, 9), round(b, 9)) for k, (a, b) in expected.items()} and got
    fresh = [f"https://{a}.{b}.com/{p}/9{e}" for a in hosts for b in hosts for p in paths for e in extras]
    rows = urlrules.judge(spark.createDataFrame(list(enumerate(fresh)), "page_id int, url string"), rules).collect()
    for r in rows:
        fired = [(c, s, sorted(k)) for k, (c, s) in expected.items() if k <= tokens(fresh[r["page_id"]])]
        assert r["verdict"] == ("block" if fired else "allow")
        assert r["mined"] == (max(fired)[2] if fired else None)


def test_tokens_of_one_set_do_not_multiply(spark):
    """Forty parameters that always come together are one item, not 2^40 sets."""
    asked = "&".join(f"p{i}=v" for i in range(40))
    rows = [(f"http://h{i % 7}.com/x?{asked}", True) for i in range(100)] + [(f"http://h{i % 7}.com/x", False) for i in range(100)]
    rules = urlrules.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert [(len(r["tokens"]), r["confidence"]) for r in rules] == [(1, 1.0)]


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([("http://a.com/en/1/",), ("http://a.com/en/2.html?x=9",), ("http://a.com/3",), ("http://a.com/x",), (None,), ("http://a.com/" + "9" * 40,)], "url string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 0), (3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = urlrules.labelled_pages(pages, labels).collect()
    assert sorted((r["url"], r["bad"]) for r in got) == [("http://a.com/en/1/", True), ("http://a.com/en/2.html?x=9", False)]
    assert urlrules.labelled_pages(pages, labels.limit(0)).collect() == []
