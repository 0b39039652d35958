import datetime
import random

from sensorloom.llm.url_lists import filter_urls, validity

DAY = datetime.date(2024, 1, 1)


def at(n):
    return None if n is None else DAY + datetime.timedelta(n)


def test_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org", "localhost"]
    entries = [(rng.choice([*hosts, "a.com/p", "com"]), rng.choice("mn"), at(rng.randrange(60)), rng.random() < 0.6) for _ in range(60)]
    entries += [entries[0], (None, "m", at(1), True), ("x.org", "m", None, True), ("x.org", None, at(0), True)]
    pages = [(i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u@'])}{rng.choice(hosts).upper()}{rng.choice(['', ':80', '/', '/p', '/p/q?x', '?y', '#z'])}",
              at(rng.randrange(70))) for i in range(300)]
    pages += [(300, None, at(3)), (301, "no url", at(3)), (302, "http://a.com/p", None), (None, "http://a.com/p", at(40)), pages[0]]
    got = filter_urls(spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, day date, host string, n_active int"),
                      spark.createDataFrame(entries, "pattern string, category string, day date, listed boolean"))
    want = []
    for page, url, day in pages:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else None
        host = segment = None
        if rest is not None:
            for c in "/?#":
                rest = rest.replace(c, "/" if c == "/" else " ")
            authority, _, path = rest.partition("/") if " " not in rest.split("/")[0] else (rest.split(" ")[0], "", "")
            host, segment = authority.split("@")[-1].split(":")[0].lower(), path.split("/")[0].split(" ")[0]
        active = []
        if host and day:
            parts = host.split(".")
            patterns = {".".join(parts[i:]) for i in range(max(1, len(parts) - 1))} | ({f"{host}/{segment}"} if segment else set())
            for pattern in patterns:
                for category in "mn":
                    dated = [(d, listed) for p, c, d, listed in entries if p == pattern and c == category and d and d <= day]
                    last = max((d for d, _ in dated), default=None)
                    if last and any(listed for d, listed in dated if d == last):
                        active.append((-len(pattern), pattern, category, last))
        best = min(active, default=(None,) * 4)
        want.append((page, host, day, bool(active), len(active), *best[1:]))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "pattern string, category string, day date, listed boolean")
    pages = spark.createDataFrame([(1, "http://a.com", DAY)], "page_id long, url string, day date")
    assert validity(none).count() == 0
    assert [r.blocked for r in filter_urls(pages, none).collect()] == [False]
    assert filter_urls(pages.limit(0), none).count() == 0
