import datetime
import random

from threadshelf.llm import urls

D = datetime.date


def test_hosts(spark):
    cases = {
        "http://A.Example.com/x": "a.example.com", "https://u:p@b.org:80/?q=http://c": "b.org", "ftp://x.y.": "x.y",
        "no url": None, "": None, None: None, "http:///path": None, " http://t.u#f ": "t.u",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r["url"]: r["h"] for r in df.select("url", urls.host(df["url"]).alias("h")).collect()} == cases


def brute(captures, log):
    rank = {a: i for i, a in enumerate(urls.ACTIONS)}
    days = {}
    for domain, action, on in log:
        if domain and action in rank and on:
            key = domain.lower(), on
            days[key] = min(days.get(key, 9), rank[action])
    out = []
    for page, host, day in captures:
        verdict = ("none", None, None)
        labels = host.split(".") if host else []
        for i in range(len(labels)):
            name = ".".join(labels[i:])
            known = [on for d, on in days if d == name and day and on <= day]
            if known and days[name, max(known)] < 2:
                verdict = (urls.ACTIONS[days[name, max(known)]], name, max(known))
                break
        out.append((page, host, day, *verdict))
    return sorted(out, key=str)


def test_verdicts_follow_the_list_as_it_stood(spark):
    r = random.Random(1)
    names = ["com", "a.com", "b.a.com", "c.b.a.com", "z.org", "x.z.org", "10.0.0.1"]
    day = lambda: D(2023, 1, 1) + datetime.timedelta(r.randrange(400))
    log = [(r.choice([*names, None, "A.com"]), r.choice([*urls.ACTIONS, "odd", None]), r.choice([day(), day(), None])) for _ in range(150)]
    log += log[:10]
    captures = [(i, r.choice([*names, None]), r.choice([day(), day(), day(), None])) for i in range(300)]
    captures += captures[:5]
    df = spark.createDataFrame([(p, h and f"https://{h}/p?q", d, "m", "v") for p, h, d in captures], "page_id long, url string, fetched_at date, month string, verdict string")
    got = urls.filter_captures(df, spark.createDataFrame([(*x, 1) for x in log], "domain string, action string, listed_on date, rank int"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(captures, log)


def test_a_timed_log_is_followed_within_the_day(spark):
    t = lambda d, h, m=0: datetime.datetime(2023, 1, d, h, m)
    log = [
        ("a.b", "block", t(5, 9)), ("a.b", "remove", t(5, 10)), ("a.b", "allow", t(6, 20)), ("b", "block", t(6, 12)),
        ("a.b", "block", t(8, 7)), ("a.b", "remove", t(8, 7)), ("c.d", "block", t(31, 23, 59)),
    ]
    want = {
        t(5, 8): "none", t(5, 9): "block", t(5, 9, 59): "block", t(5, 10): "none", t(6, 8): "none",
        t(6, 13): "block", t(6, 20): "allow", t(7, 0): "allow", t(8, 6, 59): "allow", t(8, 7): "block",
    }
    df = spark.createDataFrame([(i, "http://a.b", x) for i, x in enumerate(want)], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame(log, "domain string, action string, listed_on timestamp")
    got = urls.filter_captures(df, entries).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == list(want.values())
    assert got[5]["listed_domain"] == "b" and got[6]["listed_on"] == t(6, 20)
    days = spark.createDataFrame([(1, "http://a.b", D(2023, 1, 5)), (2, "http://c.d", D(2023, 1, 31)), (3, "http://c.d", D(2023, 2, 1))], "page_id long, url string, fetched_at date")
    assert [r["verdict"] for r in urls.filter_captures(days, entries).orderBy("page_id").collect()] == ["none", "block", "block"]


def test_empty_tables(spark):
    captures = spark.createDataFrame([], "page_id long, url string, fetched_at timestamp")
    log = spark.createDataFrame([], "domain string, action string, listed_on date")
    assert urls.filter_captures(captures, log).count() == 0
    one = spark.createDataFrame([(1, "http://a.b", D(2023, 5, 5))], "page_id long, url string, fetched_at date")
    assert [tuple(r) for r in urls.filter_captures(one, log).collect()] == [(1, "a.b", D(2023, 5, 5), "none", None, None)]


def test_hosts_cannot_be_dodged(spark):
    cases = {
        "http://a@b@h.com/": "h.com", "http://h.com\\@evil.com/": "h.com", "http://[2001:db8::1]:80/x": "[2001:db8::1]",
        "HTTP://User:p%40q@Ex.COM.:8080?x@y": "ex.com", "http:///ex.com/x": "ex.com", "http:\\\\ex.com\\x": "ex.com",
        "ht\ntp://e\tx.com/": "ex.com", "http://e%78.com/": "ex.com", "http://a+b.com/": "a+b.com", "http://ex%zz.com/": "ex%zz.com",
        "http://ex.com..": "ex.com", "http://?q": None, "//ex.com/": None, "mailto:a@b.c": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r["url"]: r["h"] for r in df.select("url", urls.host(df["url"]).alias("h")).collect()} == cases


def test_entries_are_written_in_many_ways(spark):
    day = D(2023, 5, 5)
    captures = spark.createDataFrame([(1, "http://x@a.Ex.com.:80/", day)], "page_id long, url string, fetched_at date")
    for name in ("ex.com.", " ex.com ", "EX.COM", "e%78.com", "a.ex.com"):
        log = spark.createDataFrame([(name, "block", day)], "domain string, action string, listed_on date")
        assert [r["verdict"] for r in urls.filter_captures(captures, log).collect()] == ["block"], name
