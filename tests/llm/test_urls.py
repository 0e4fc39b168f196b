import random
from collections import Counter, defaultdict

from paperlake.llm import urls
from paperlake.llm.queries import QUERIES

from .conftest import SMALL


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_for(host, path):
    fits = []
    for rule, says in urls.RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append((len(rule), rule, says))
    return max(fits)[1:] if fits else (None, None)


def brute(pages):
    """The same tree, counted by dictionaries."""
    rows = [(i, *parsed(u)) for i, u in pages]
    paths = Counter((h, p) for _, h, p in rows)
    shape = {key: "" for key in paths}
    parts = {key: [x for x in key[1].split("/") if x] for key in paths}
    variable = lambda c: len(c) >= urls.VALUES and max(c.values()) <= urls.TOP_SHARE * sum(c.values())
    for level in range(urls.DEPTH):
        nodes, wide = defaultdict(Counter), defaultdict(Counter)
        for key, n in paths.items():
            if level < len(parts[key]):
                nodes[key[0], shape[key]][parts[key][level]] += n
                wide[shape[key]][parts[key][level]] += n
        before = dict(shape)
        for key in paths:
            if level < len(parts[key]):
                own = nodes[key[0], before[key]]
                star = variable(wide[before[key]]) if sum(own.values()) < urls.VALUES else variable(own)
                shape[key] += "/" + ("*" if star else parts[key][level])
    known, bad = Counter(), Counter()
    for key, n in paths.items():
        if len(parts[key]) > urls.DEPTH:
            shape[key] += "/**"
        says = rule_for(*key)[1]
        known[key[0], shape[key]] += n if says else 0
        bad[key[0], shape[key]] += n if says == "block" else 0
    total = sum(known.values())
    share = sum(bad.values()) / total if total else 0.0
    smooth = lambda b, k, to: (b + urls.PRIOR * to) / (k + urls.PRIOR)
    fifth = {b: min(int(5 * smooth(bad[b], known[b], share)), 4) if known[b] else -1 for b in known}
    like, every = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for b in known:
        for held in (like[b[1], fifth[b]], every[b[1]]):
            held[0] += bad[b]
            held[1] += known[b]
    out = []
    for i, host, path in rows:
        rule, says = rule_for(host, path)
        b = host, shape[host, path]
        wide = smooth(*like[b[1], fifth[b]], smooth(*every[b[1]], share))
        verdict = says or ("block" if smooth(bad[b], known[b], wide) >= urls.BLOCKED_SHARE else "allow")
        out.append((i, host, path, rule, verdict))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_production_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()]
    assert rows(QUERIES["op6_url_filter"](spark, SMALL)) == brute(pages)


def test_against_brute_force(spark):
    draw = random.Random(6)
    hosts = ["a.example.org", "EXAMPLE.org", "b.com", "c.b.com", "d.net", "x.d.net", "com", "notcom"]
    pages = [
        (i, f"http://{draw.choice(hosts)}/{draw.choice(['en', 'es', 'fr', 'de', 'En'])}/"
            f"{draw.choice([str(draw.randint(0, 40)), 'about', 'a/b/c/d/e', ''])}{draw.choice(['', '?q=/es/', '#x', '/'])}")
        for i in range(400)
    ]
    odd = [None, "", "no scheme", "://", "x://", "x://H?y", "x://h#z/w", "http://é.ORG/É", "a://b://com/de/1", "http://com/de/1"]
    pages += [(1000 + i, u) for i, u in enumerate(odd)] + [(None, "http://org/"), (1, "http://b.com/fr/1")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, host string, n string")
    assert rows(urls.judge(df.repartition(4))) == brute(pages)
    assert urls.judge(df.limit(0)).count() == 0


def test_segments_far_down_decide(spark):
    pages = [(i, f"http://example.org/en/{100 + i}/a/b/c/print") for i in range(30)]
    pages += [(100 + i, f"http://example.org/en/{200 + i}/a/b/c/view") for i in range(30)]
    pages += [(200, "http://d.net/en/150/a/b/c/print"), (201, "http://d.net/en/150/a/b/c/view")]
    found = urls.judge(spark.createDataFrame(pages, "page_id long, url string")).where("page_id >= 200")
    assert {r.page_id: (r.rule, r.verdict) for r in found.collect()} == {200: (None, "block"), 201: (None, "allow")}


def test_deep_paths_against_brute_force(spark, monkeypatch):
    draw = random.Random(8)
    hosts = ["example.org", "a.example.org", "b.com", "c.b.com", "d.net", "x.d.net"]
    pages = []
    for i in range(600):
        segments = [draw.choice(["en", "es", "fr", "de"]), str(draw.randint(90, 250))]
        segments += [draw.choice(["a", "a", "b", str(draw.randint(0, 30))]) for _ in range(draw.randint(0, 9))]
        pages.append((i, f"http://{draw.choice(hosts)}/{'/'.join(segments)}/{draw.choice(['print', 'view', ''])}"))
    pages += [(1000 + i, f"http://b.com/fr/{'x/' * 60}{i}") for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    found = rows(urls.judge(df.repartition(3)))
    monkeypatch.setattr(urls, "DEPTH", 70)  # beyond all of these
    assert found == brute(pages)


def test_no_python_on_the_way(spark):
    plan = QUERIES["op6_url_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
