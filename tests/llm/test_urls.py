import re
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import urls
from corpusloom.llm.common import Scratch

PAGES = [
    (1, "https://A.Example.ORG/en/2?x=http://q", '<a href="http://bad.example.com/x">', "h"), (2, "http://example.org/es/1", None, "h"), (3, "http://example.org/en/12#f", "", "h"),
    (4, "http://b.com/fr/", '<a href="https://C.net/">', "h"), (5, "http://b.com/de/a", "<img src=//d.net/i>", "h"), (6, "http://c.net/x", "", "h"), (7, "http://d.net/", '<a href="http://bad.example.com/">', "h"),
    (8, None, "x", "h"), (9, "no scheme", "x", "h"), (10, "http://org", "", "h"), (11, "http://xorg/a", "", "h"), (12, "://k.org?p", "", "h"), (13, "http://bad.example.com/de/1", "", "h"),
    (13, "http://bad.example.com/de/1", "", "h"), (14, "http://bad.example.com/en", '<a href="/self">', "h"), (15, "http://é.org/ü", "", "h"), (16, "http://a://b/c", "", "h"),
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def rank(edges, seeds):
    total = sum(seeds.values())
    start = {h: s / total for h, s in seeds.items()}
    out = Counter()
    for (a, _), w in edges.items():
        out[a] += w
    now = dict(start)
    for _ in range(urls.ROUNDS):
        new = defaultdict(float)
        for (a, b), w in edges.items():
            new[b] += urls.DAMPING * now.get(a, 0) * w / out[a]
        lost = 1 - sum(new.values())
        for h, s in start.items():
            new[h] += s * lost
        now = new
    return now


def test_equals_brute_force(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, host string")
    edges, good, bad = Counter(), Counter(), Counter()
    hosts = set()
    for _, url, html, _ in PAGES:
        h, p = split(url)
        if h:
            hosts.add(h)
        for d in re.findall(r"""(?i)(?:href|src)=["']?(?:https?:)?//([^/?#"'\s>]+)""", html or ""):
            edges[h, d.lower()] += 1 if h != d.lower() else 0
            hosts.add(d.lower())
        v = rule(h, p)[1]
        good[h] += v == "allow"
        bad[h] += v == "block"
    for h in {h[k:] for h in hosts for k in [0, *(m.end() for m in re.finditer(r"\.", h))]}:
        if "." in h:
            edges[h, h.split(".", 1)[1]] += 1
            edges[h.split(".", 1)[1], h] += 1
    edges = {k: v for k, v in edges.items() if v}
    trust, distrust = rank(edges, good), rank({(b, a): w for (a, b), w in edges.items()}, bad)
    got = sorted(urls.judge(df).collect())
    assert len(got) == len(PAGES)
    for r, (i, url, _, _) in zip(got, sorted(PAGES, key=str and (lambda x: x[0])), strict=True):
        h, p = split(url)
        name, verdict = rule(h, p)
        t, d = (trust.get(h, 0), distrust.get(h, 0)) if h else (0, 0)
        assert (r.page_id, r.host, r.path, r.rule) == (i, h, p, name)
        assert r.trust == pytest.approx(t, abs=1e-8) and r.distrust == pytest.approx(d, abs=1e-8)
        assert r.verdict == (verdict or ("block" if d > 0.5 * (t + d) + 1e-12 else "allow"))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_small_ranks_count_by_their_share(spark):
    rules = (("block", "bad.big.net", "/"), ("allow", "good.org", "/"))
    hosts = [f"h{i}.{'h0.' * k}big.net" for k in range(5) for i in range(200)]
    # distrust of the last level is below 5e-10; trust, which starts at another tree, does not reach it
    rows = [(0, "http://bad.big.net/", None), (1, "http://good.org/", None)] + [(2 + i, f"http://{h}/", None) for i, h in enumerate(hosts)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()
    assert len(got) == len(rows) and {r.verdict for r in got if r.rule is None} == {"block"}
    assert 0 < min(r.distrust for r in got if r.rule is None) < 5e-10


def test_far_hosts_are_reached(spark):
    far = ".".join(["a"] * 15) + ".bad.net"
    rows = [(0, "http://bad.net/x", None), (1, f"http://{far}/", None), (2, "http://c.org/", None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), (("block", "bad.net", "/x"),)).collect()}
    assert [got[i].verdict for i in range(3)] == ["block", "block", "allow"] and got[1].distrust > 0


def test_slices_of_hosts_of_many_edges_change_no_rank(spark):
    import random

    draw = random.Random(4)
    pairs = {(f"h{draw.randrange(12)}", f"h{draw.randrange(60)}"): draw.randint(1, 4) for _ in range(260)} | {("h70", "h3"): 1, ("h3", "h71"): 2}
    edges = spark.createDataFrame([("w", a, b, float(n)) for (a, b), n in pairs.items()], "walk string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("w", "h1", 2.0), ("w", "h70", 1.0)], "walk string, host string, seed double")
    assert edges.groupBy("src").count().agg({"count": "max"}).first()[0] > 15
    ranks = lambda most: {r.host: r["rank"] for r in urls.personalised_ranks(edges, seeds, Scratch(spark), most_out=most).collect()}
    whole, sliced = ranks(1000), ranks(3)
    assert set(whole) == set(sliced) and sum(sliced.values()) == pytest.approx(1, abs=1e-9)
    assert all(sliced[h] == pytest.approx(r, rel=1e-7) for h, r in whole.items())
    want = rank(pairs, {"h1": 2.0, "h70": 1.0})
    assert all(whole[h] == pytest.approx(r, abs=1e-8) for h, r in want.items())


def test_a_small_graph_takes_few_tasks(spark):
    edges = spark.createDataFrame([("w", f"h{i}", f"h{(i * 7 + j) % 20}", 1.0 + j) for i in range(20) for j in range(1, 3)], "walk string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("w", "h1", 2.0), ("w", "h5", 1.0)], "walk string, host string, seed double")
    tracker, set_to = spark.sparkContext.statusTracker(), {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    try:
        spark.sparkContext.setJobGroup("few", "few")
        ranks = {r.host: r["rank"] for r in urls.personalised_ranks(edges, seeds, Scratch(spark), rounds=16, tolerance=1.0).collect()}
        stages = {s for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds}
        few = sum(s.numCompletedTasks for i in stages if (s := tracker.getStageInfo(i)))
        spark.sparkContext.setJobGroup("dealt", "dealt")
        dealt = {r.host: r["rank"] for r in urls.personalised_ranks(edges, seeds, Scratch(spark), rounds=16, tolerance=1.0, one_task=0).collect()}
        stages = {s for j in tracker.getJobIdsForGroup("dealt") for s in tracker.getJobInfo(j).stageIds}
        many = sum(s.numCompletedTasks for i in stages if (s := tracker.getStageInfo(i)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    # dealt out, each of the 16 rounds has a task for each of the 20 partitions; what stands around the rounds counts in both
    assert few < 16 * 20 <= many, (few, many)
    assert set(ranks) == set(dealt) and all(ranks[h] == pytest.approx(r, rel=1e-9) for h, r in dealt.items())
