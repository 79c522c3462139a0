import random
from urllib.parse import urlsplit

from weirlog.llm import urls


def verdicts(spark, rows, clash=lambda d: d, **options):
    got = urls.url_filter(clash(spark.createDataFrame(rows, "page_id long, url string, html string")), **options).collect()
    return {r["page_id"]: r for r in got}


def test_rules(spark, clash):
    cases = [
        ("http://a.com/en/1", "a.com", "/en/1", "com/en/", "block"), ("https://X.Example.COM/en/77?q=/de/", "x.example.com", "/en/77", "example.com/en/7", "allow"), ("http://example.net/de/8#x", "example.net", "/de/8", "example.net/de/8", "block"),
        ("http://example.net/de/9", "example.net", "/de/9", "net/de/", "allow"), ("http://q.org/es/", "q.org", "/es/", "org/es/", "block"), ("http://notcom/en/1", "notcom", "/en/1", None, None), ("http://com/en/", "com", "/en/", "com/en/", "block"),
        ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://h?x=1", "h", "", None, None), ("ftp://É.com/en/é x", "É.com", "/en/é x", "com/en/", "block"), ("a://b://c/d", "b:", "//c/d", None, None), ("http://h\n/p", "h\n", "/p", None, None),
    ]
    rows = [(i, u, None) for i, (u, *_) in enumerate(cases)] + [(None, "http://a.com/en/1", "<p>")]
    got = verdicts(spark, rows, clash)
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block")
        if verdict:
            assert got[i]["verdict"] == verdict
    assert urlsplit(cases[0][0]).netloc == "a.com"


def rank(edges, seeds, damping=0.85, rounds=60):
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    x = dict(seeds)
    for _ in range(rounds):
        got = {}
        for (a, b), n in edges.items():
            got[b] = got.get(b, 0) + damping * x.get(a, 0) * n / out[a]
        home = 1 - sum(got.values())
        x = {k: seeds.get(k, 0) * home + got.get(k, 0) for k in {*seeds, *got}}
    return x


def test_ranks_follow_links(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">t</a>' for h in hosts)
    rows = [
        (1, "http://good.net/de/1", link("friend.info", "peer.info")), (2, "http://bad.com/en/1", link("peer.info")), (3, "http://friend.info/1", link("peer.info", "friend.info")),
        (4, "http://farm.info/1", link("bad.com") + ' <a HREF=//BAD.com:80/y>z</a>'), (5, "http://peer.info/2", "<p>none</p>"), (6, "http://alone.info/", None), (7, "http://farm.info/2", link("bad.com", "friend.info")),
    ]
    got = verdicts(spark, rows, rounds=60)
    edges = {("good.net", "friend.info"): 1, ("good.net", "peer.info"): 1, ("bad.com", "peer.info"): 1, ("friend.info", "peer.info"): 1, ("farm.info", "bad.com"): 3, ("farm.info", "friend.info"): 1}
    trust = rank(edges, {"good.net": 1.0})
    distrust = rank({(b, a): n for (a, b), n in edges.items()}, {"bad.com": 1.0})
    for r in got.values():
        assert abs(r["trust"] - trust.get(r["host"], 0)) < 2e-3
        assert abs(r["distrust"] - distrust.get(r["host"], 0)) < 2e-3
    assert got[4]["verdict"] == "block"
    assert got[3]["verdict"] == got[5]["verdict"] == got[6]["verdict"] == "allow"


def test_long_chains_and_many_seeds_reach_all(spark):
    link = lambda h: f'<a href="http://{h}/x">t</a>'
    rows = [(i, f"http://h{i}.info/", link(f"h{i - 1}.info" if i > 1 else "bad.com")) for i in range(1, 25)]
    rows += [(0, "http://bad.com/en/1", None)] + [(100 + i, f"http://lone{i}.com/en/1", None) for i in range(20_000)]
    got = verdicts(spark, rows)
    assert all(got[i]["verdict"] == "block" and got[i]["distrust"] > 0 for i in range(25))


def test_made_link_graph_with_a_hub(spark):
    """Ports, user names, a hub that a third of the hosts link to, repeated rows, tied ranks and a long page, against plain iteration."""
    r = random.Random(6)
    link = lambda h: f'<a href="https://{h}/x">t</a>'
    hosts = [f"h{i}.info" for i in range(60)] + ["hub.info", "good.net", "bad.com"]
    rows, edges, seeds = [], {}, {"good.net": 0, "bad.com": 0}
    for i in range(400):
        a = r.choice(hosts[:60])
        if i % 40 == 0:
            a = ("good.net", "bad.com")[i // 40 % 2]
        to = set(r.sample(hosts, r.randint(0, 3))) | ({"hub.info"} if i % 3 == 0 else set())
        path = {"good.net": "/de/1", "bad.com": "/en/1"}.get(a, "/p")
        rows.append((i, f"http://{a}{':8080' if i % 5 == 0 else ''}{path}", " ".join(link(("u@" if i % 2 else "") + h + (":443" if i % 7 == 0 else "")) for h in sorted(to))))
        seeds[a] = seeds.get(a, 0) + 1
        for b in to - {a}:
            edges[a, b] = edges.get((a, b), 0) + 1
    again = [x for x in rows[:20]]
    for i, u, html in again:
        a = u.split("//")[1].split("/")[0].split(":")[0]
        seeds[a] += 1
        for b in {x for x in hosts if f"{x}/x" in html or f"{x}:443/x" in html} - {a}:
            edges[a, b] += 1
    rows += again + [(900, "http://long.info/1", "<p>" + "words " * 200_000 + link("twin1.info") + link("twin2.info"))]
    edges["long.info", "twin1.info"] = edges["long.info", "twin2.info"] = 1
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), rules=[("allow", "good.net", "/"), ("block", "bad.com", "/"), ("allow", "good.net:8080", "/"), ("block", "bad.com:8080", "/")]).collect()
    assert len(got) == len(rows)
    trust, distrust = rank(edges, {"good.net": 1.0}, rounds=100), rank({(b, a): n for (a, b), n in edges.items()}, {"bad.com": 1.0}, rounds=100)
    for x in got:
        h = x["host"].split(":")[0]
        assert abs(x["trust"] - trust.get(h, 0)) < 1e-3
        assert abs(x["distrust"] - distrust.get(h, 0)) < 1e-3
        if x["rule"] is None and abs(trust.get(h, 0) - distrust.get(h, 0)) > 1e-3:
            assert x["verdict"] == ("block" if distrust.get(h, 0) > trust.get(h, 0) else "allow")
    assert any(":8080" in x["host"] and x["distrust"] > 0 for x in got)


def test_empty_table(spark):
    assert verdicts(spark, []) == {}
