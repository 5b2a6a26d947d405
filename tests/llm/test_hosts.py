from eoframe.llm import hosts

PAGES = [
    (1, "http://www.Example.com/en/x?q#f"), (2, "https://a.b.example.com/en/"), (3, "https://example.com/fr/1"), (4, "ftp://x.net/es/"),
    (5, "http://y.net/de/"), (6, "http://z.org"), (7, "no url"), (8, None), (8, "http://notexample.com/en/"), (None, "https://q.net?es/"), (9, "http://spam.biz/a"),
]


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]


def rule(host, path):
    best = (None, None)
    for text, says in hosts.RULES:
        h, p = text[: text.index("/")], text[text.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best[0] is None or len(text) > len(best[0])):
            best = (text, says)
    return best


def test_rules_and_parts(spark):
    d = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, None)], "doc_id long, quality int")
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in hosts.judge(d, labels).collect()), key=repr)
    assert got == sorted(((i, *plain(u), rule(*plain(u))[0]) for i, u in PAGES), key=repr)
    for r in hosts.judge(d, labels).collect():
        if r.rule:
            assert r.verdict == dict(hosts.RULES)[r.rule]


def test_reputation_shrinks(spark):
    pages = [(i, f"http://h{i % 3}.bad.biz/{i}") for i in range(300)] + [(300 + i, f"http://g{i % 50}.fine.org/{i}") for i in range(900)]
    pages += [(5000, "http://new.bad.biz/"), (5001, "http://new.fine.org/")]
    labels = [(i, 0 if i < 290 else 1) for i in range(0, 1200)]
    d = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r for r in hosts.judge(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got[0].verdict == "block" and got[301].verdict == "allow"
    assert got[5000].posterior > 0.5 > got[5001].posterior  # unlabelled hosts lean on their domain
    assert got[5000].bound < got[0].bound


def test_empty_and_unlabelled(spark):
    d = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert hosts.judge(d, labels).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert hosts.judge(one, labels).first().verdict == "allow"


def test_domains(spark):
    d = spark.createDataFrame([("a.b.co.uk",), ("example.com",), ("x.y.example.com",), ("localhost",), ("",)], "h string")
    got = [tuple(r) for r in d.select(hosts.domain_of(d.h), hosts.suffix_of(d.h)).collect()]
    assert got == [("b.co.uk", "co.uk"), ("example.com", "com"), ("example.com", "com"), ("localhost", "localhost"), ("", "")]
