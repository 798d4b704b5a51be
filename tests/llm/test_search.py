"""Nearest neighbours and URL filters."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tablefit.llm import nearest, url_filter
from tablefit.llm.common import literal_rows
from tablefit.llm.queries import RULES


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 3)
    monkeypatch.setattr(nearest, "CANDIDATE_BLOCK", 40)
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=8).astype(np.float32)]) for i in range(120)]
    rows += [(200 + i, rows[20][1]) for i in range(4)]  # ties
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [math.nan] * 8), (304, [None] + [1.0] * 7), (None, rows[3][1]),
             (310, [1.0, 2.0]), (320, [math.inf] * 8), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in nearest.nearest(df, F.col("vec_id") % 10 == 0, k=5).collect())
    good = [(i, v) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    want = []
    for q, a in sorted({(q, tuple(a)) for q, a in good if q % 10 == 0}):
        near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))), i) for i, b in good if i != q and len(a) == len(b))
        want += [(q, rank, i, score) for rank, (score, i) in enumerate(near[:5], 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-15)
    assert nearest.nearest(df.filter("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_an_outlier_keeps_the_pruning(monkeypatch):
    """A vector 10^4 times longer than the others makes more pairs to measure again for its own search only."""
    rnd = np.random.default_rng(6)
    vectors = rnd.normal(size=(3000, 32))
    ids = np.arange(3000)
    measured = []
    original = nearest.distances
    monkeypatch.setattr(nearest, "distances", lambda a, b: measured.append(len(a)) or original(a, b))
    counts = []
    for scale in (1, 1e4):
        vectors[17] *= scale
        measured.clear()
        q, c, score = nearest.tile(ids[:50], vectors[:50], ids, vectors, 10)
        counts.append(sum(measured))
        assert max(measured) <= nearest.PAIRS
        far = np.sqrt(((vectors[:50, None] - vectors[None]) ** 2).sum(axis=2))
        far[np.arange(50), np.arange(50)] = np.inf
        want = np.argsort(far, axis=1, kind="stable")[:, :10]
        assert all(set(c[q == i]) == set(want[i]) for i in range(50))
    assert counts[1] - 3000 < 1.5 * counts[0] < 0.3 * 50 * 3000


def slow_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    rnd = random.Random(7)
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "x://a://b.net/", "HTTP://A.EXAMPLE.NET/en/x?/y",
            "http://notexample.net/en/", "http://example.com/de", "http://example.com/de/", "http://É.org/fr/#a",
            "http://org/fr/", "http://.net/", "http://a.net?x", "http://a.net#/"]
    urls += [f"http://{'a.' * rnd.randint(0, 3)}{rnd.choice(['example.net', 'example.com', 'x.org', 'net', 'org'])}"
             f"{rnd.choice(['', '/', '/en/', '/de/', '/fr/', '/en', '/fr/x/y'])}{rnd.choice(['', '?a=/en/', '#b'])}" for _ in range(200)]
    df = spark.createDataFrame([(i % 150, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    rules = literal_rows(spark, ["host", "path", "verdict"], RULES)
    got = sorted((tuple(r) for r in url_filter.filter_urls(df, rules).collect()), key=str)
    assert got == sorted(((i % 150, *slow_verdict(u)) for i, u in enumerate(urls)), key=str)
    plan = url_filter.filter_urls(df, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {r.verdict for r in url_filter.filter_urls(df, rules.filter("false")).collect()} == {"allow"}
    assert url_filter.filter_urls(df.filter("false"), rules).count() == 0


def test_long_hosts(spark):
    """A host of a megabyte costs as many keys as the longest listed host has labels."""
    long = "a." * (1 << 19)
    df = spark.createDataFrame([(1, f"http://{long}example.net/en/x"), (2, f"http://{long}"), (3, f"http://{'b' * (1 << 20)}.org/fr/"),
                                (4, f"http://x.org/{'/fr/' * (1 << 18)}")], "page_id long, url string")
    rules = literal_rows(spark, ["host", "path", "verdict"], RULES)
    begun = time.monotonic()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: ("org/fr/", "allow"), 4: (None, "allow")}
    assert time.monotonic() - begun < 30


def test_bloom_filter_has_no_false_negatives(spark):
    hosts = [f"h{i}.example.org" for i in range(500)]
    rules = literal_rows(spark, ["host", "path", "verdict"], [(h, "/", "block") for h in hosts])
    df = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)] + [
        (i, f"http://h{i}.example.com/x") for i in range(500, 900)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, rules).collect()}
    assert all((got[i] == "block") == (i < 500) for i in got) and len(got) == 900
