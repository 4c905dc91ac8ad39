import numpy as np
import pytest

from sparkwell.llm import url_filter as uf


def brute(links, seeds):
    """(score, mean heard) of each host: the linear equations, solved."""
    hosts = sorted({h for a, b, _ in links for h in (a, b)} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    share = np.zeros((len(hosts), len(hosts)))
    for a, b, n in links:
        share[at[b], at[a]] += n
    into = share.sum(axis=1)
    share[into > 0] /= into[into > 0, None]
    start = np.array([seeds.get(h, 0.0) for h in hosts]) * np.where(into > 0, 1 - uf.DAMPING, 1)
    score = np.linalg.solve(np.eye(len(hosts)) - uf.DAMPING * share, start)
    return {h: (score[i], (share @ score)[i]) for h, i in at.items()}


def reverse(links):
    return [(b, a, n) for a, b, n in links]


@pytest.mark.parametrize("steps", [4, 12])
def test_propagation(spark, monkeypatch, steps):
    monkeypatch.setattr(uf, "STEPS", steps)
    links = [("a", "b", 3), ("b", "c", 1), ("c", "a", 1), ("b", "d", 1), ("e", "a", 2), ("f", "e", 1)]
    good, bad = {"a": 1.0, "e": 0.5, "z": 1.0}, {"d": 0.7, "c": 0.2}
    frame = lambda seeds: spark.createDataFrame(list(seeds.items()), "host string, weight double")
    got = {r.host: r for r in uf.propagate(spark.createDataFrame(links, "src string, dst string, n long"), frame(good), frame(bad), 0.3).collect()}
    trust, distrust = brute(links, good), brute(reverse(links), bad)
    for h in "abcdefz":
        t, d, mine = trust.get(h, (0, 0)), distrust.get(h, (0, 0)), got.get(h, (h, 0, 0, 0, 0))
        assert all(-1e-9 <= x - y <= 0.3 for x, y in zip((*t, *d), mine[1:], strict=True))  # never above, and near enough to decide
        assert (d[1] - t[1] > 0.3) == (mine[4] - mine[2] > 0.3)


def test_rules_and_parts(spark):
    urls = [
        (1, "HTTPS://WWW.Example.COM/en/x?q#f"), (2, "http://blog.example.com/en/1"), (3, "http://example.com/de/"), (4, "http://a.net/es/1"),
        (5, "http://a.net/EN/"), (6, None), (7, "no scheme/en/"), (8, "http://example.com"), (9, "x://h?y://z/"), (10, "http://badnet/es/"), (10, "http://badnet/es/"),
    ]
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in urls], "page_id bigint, url string, html string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in uf.judge(pages).collect())
    assert got[:3] == [(1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "blog.example.com", "/en/1", "example.com/en/", "block"), (3, "example.com", "/de/", "com/", "allow")]
    assert got[3] == (4, "a.net", "/es/1", "net/es/", "block")
    assert [g[1:4] for g in got[4:]] == [("a.net", "/EN/", None), ("", "", None), ("", "", None), ("example.com", "", None), ("h", "", None), ("badnet", "/es/", None), ("badnet", "/es/", None)]


def test_links_carry_distrust(spark):
    html = '<a href="http://bad.net/es/1">x</a> <A HREF=//bad.net/es/2>y</A> <a href="/own">'
    pages = spark.createDataFrame([(1, "http://bad.net/es/1", ""), (2, "http://farm.org/1", html), (3, "http://fine.org/1", "")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in uf.judge(pages).collect()}
    assert got[2].distrust > 0.3 and got[3].distrust == 0
    assert uf.judge(pages.limit(0)).count() == 0


def test_verdicts_against_brute_force(spark):
    """Random hosts, links and rules: the verdict of every page that no rule decides, from both propagations by many steps."""
    import random

    r = random.Random(11)
    hosts = [f"h{k}.{z}" for k in range(12) for z in ("com", "net", "org")]
    pages, links = [], {}
    for i in range(150):
        host = r.choice(hosts)
        to = [r.choice(hosts) for _ in range(r.randrange(3))]
        for h in to:
            if h != host:
                links[host, h] = links.get((host, h), 0) + 1
        pages.append((i, f"http://{host}/{r.choice(['es', 'fr', 'de'])}/x", "".join(f'<a data-href="http://h0.net/es/" href="https://{h}/a">' for h in to)))
    rule = lambda h, p: "allow" if h.endswith("com") else "block" if h.endswith("net") and p in ("es", "fr") else None
    share = {}
    for _, u, _ in pages:
        h, p = u.split("/")[2:4]
        share.setdefault(h, []).append(rule(h, p))
    part = lambda v: {h: x.count(v) / len(x) for h, x in share.items() if v in x}
    edges = [(a, b, n) for (a, b), n in links.items()]
    trust, distrust = brute(edges, part("allow")), brute(reverse(edges), part("block"))
    got = {x.page_id: x for x in uf.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for i, u, _ in pages:
        h, p = u.split("/")[2:4]
        gap = distrust.get(h, (0, 0))[1] - trust.get(h, (0, 0))[1]
        blocked = gap > uf.LINK_MARGIN or part("block").get(h, 0) - part("allow").get(h, 0) > uf.MARGIN
        assert got[i].verdict == (rule(h, p) or ("block" if blocked else "allow")), (i, h, gap)
    assert {x.verdict for x in got.values() if x.rule is None} == {"allow", "block"}


@pytest.mark.parametrize("steps", [4, 8])
def test_no_verdict_hangs_on_the_steps(spark, monkeypatch, steps):
    """A chain of hosts to a blocked seed, a farm around another, and a popular site with one bad link."""
    monkeypatch.setattr(uf, "STEPS", steps)
    link = lambda *hosts: "".join(f'<a href="http://{h}/es/1">x</a>' for h in hosts)
    pages = [(0, "http://c0.net/es/1", "")] + [(i, f"http://c{i}.org/1", link("c0.net" if i == 1 else f"c{i - 1}.org")) for i in range(1, 40)]
    pages += [(100, "http://f.net/es/1", link(*[f"f{k}.org" for k in range(30)]))] + [(101 + k, f"http://f{k}.org/1", link("f.net")) for k in range(30)]
    pages += [(200, "http://popular.org/1", link("c0.net", *[f"p{k}.org" for k in range(20)]))] + [(201 + k, f"http://p{k}.org/1", link("popular.org")) for k in range(20)]
    pages += [(300, "http://known.com/1", link("mixed.org")), (301, "http://mixed.org/1", link("c0.net", "p1.org"))]
    got = {r.page_id: r.verdict for r in uf.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    near = [i for i in range(1, 40) if got[i] == "block"]
    assert near == [i for i in range(1, 40) if uf.DAMPING ** (i - 1) > uf.LINK_MARGIN]
    assert all(got[101 + k] == "block" for k in range(30)) and got[0] == got[100] == "block"
    assert got[200] == "allow" and all(got[201 + k] == "allow" for k in range(20))
    assert got[301] == "allow"  # half its links are bad, but all that link to it are trusted


def test_long_urls_and_pages(spark):
    url = "http://a.net/es/" + "x" * 200_000
    html = "<p>word</p>" * 50_000 + '<a href="http://a.net/es/">'
    got = {x.page_id: x for x in uf.judge(spark.createDataFrame([(1, url, None), (2, "http://b.org/", html)], "page_id bigint, url string, html string")).collect()}
    assert got[1].verdict == "block" and len(got[1].path) == 200_004 and got[2].verdict == "block"


def test_links_to_a_blocked_seed_block(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/es/1">x</a>' for h in hosts)
    pages = [(1, "http://bad.net/es/1", ""), (2, "http://farm.org/1", link("bad.net")), (3, "http://fine.org/1", link("farm.org", "half.net"))]
    pages += [(4, "http://half.net/es/1", ""), (5, "http://half.net/de/1", ""), (6, "http://half.net/de/2", ""), (7, "http://good.com/1", link("known.org", "farm.org")), (8, "http://known.org/1", link("good.com"))]
    crowd = [(100 + k, f"http://f{k}.org/1", link("worse.net")) for k in range(50)] + [(99, "http://worse.net/fr/1", "")]
    judged = lambda rows: {r.page_id: r.verdict for r in uf.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    # One host that links to one blocked seed; then fifty that share what another seed has.
    assert judged(pages[:2]) == {1: "block", 2: "block"}
    got = judged(pages[:1] + [pages[1]] + pages[3:6] + pages[7:] + crowd)
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 4, 99, *range(100, 150)}
    # Trust from an allowed host outweighs nothing where no distrust comes in, and hosts are not blocked by their own few blocked pages.
    got = judged(pages[3:])
    assert got == {4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow"}
