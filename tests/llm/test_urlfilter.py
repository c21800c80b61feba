import datetime as dt

from pyspark.sql import functions as F

from driftline.llm import urlfilter

D = dt.date
LOG = [
    ("bad.org", "block", D(2024, 1, 10), "on"), ("bad.org", "block", D(2024, 2, 1), "off"), ("bad.org", "block", D(2024, 3, 1), "on"), ("bad.org", "block", D(2024, 3, 5), "on"),
    ("ok.bad.org", "allow", D(2024, 1, 1), "on"), ("site.com/x/", "block", D(2024, 1, 1), "on"), ("tie.com", "block", D(2024, 1, 1), "on"), ("tie.com", "allow", D(2024, 1, 1), "on"),
    ("same.com", "block", D(2024, 1, 1), "on"), ("same.com", "block", D(2024, 1, 1), "off"), (None, "block", D(2024, 1, 1), "on"),
]


def test_verdicts(spark, monkeypatch):
    urls = ["http://bad.org/", "https://u:p@A.Bad.org.:80/q?x", "http://ok.bad.org", "http://notbad.org/", "http://site.com/x/y", "http://site.com/xy", "http://site.com/z", "http://tie.com", "http://same.com/", None, "no url", ""]
    days = [D(2024, 1, 9), D(2024, 1, 10), D(2024, 1, 31), D(2024, 2, 1), D(2024, 2, 29), D(2024, 3, 1), D(2024, 4, 1), None]
    rows = [(u, d, "clash") for u in urls for d in days] * 2
    caps = spark.createDataFrame(rows, "url string, fetched date, verdict string")
    log = spark.createDataFrame(LOG, "entry string, verdict string, at date, action string")

    def want(u, d):
        on = lambda a, b=D(9999, 1, 1): d is not None and a <= d < b
        bad = on(D(2024, 1, 10), D(2024, 2, 1)) or on(D(2024, 3, 1))
        if u in (urls[0], urls[1]):
            return "block" if bad else "allow"
        if u in (urls[4], urls[7]):
            return "block" if on(D(2024, 1, 1)) else "allow"
        return "allow"

    for small in (urlfilter.small, lambda df: df):
        monkeypatch.setattr(urlfilter, "small", small)
        got = urlfilter.filtered(caps, log)
        assert got.count() == len(rows)
        for r in got.distinct().collect():
            assert r.verdict == want(r.url, r.fetched), r
    two = urlfilter.filtered(caps, log).where(F.col("url") == urls[2]).where("fetched = DATE '2024-03-01'").first()
    assert (two.n_active, two.entry) == (2, "ok.bad.org")
    assert urlfilter.filtered(caps.where("false"), log).count() == 0
    assert {r.verdict for r in urlfilter.filtered(caps, log.where("false")).collect()} == {"allow"}


def test_case_and_segments_and_names(spark):
    log = spark.createDataFrame([("Example.net", "block", D(2024, 1, 1), "on"), ("example.net", "block", D(2024, 2, 1), "off"), ("h.org/En", "block", D(2024, 1, 1), "on"), ("h.org/fr/", "block", D(2024, 1, 1), "on")], "entry string, verdict string, at date, action string")
    urls = {"http://example.NET/": "allow", "http://h.org/en": "block", "http://h.org/EN/1": "block", "http://h.org/english": "allow", "http://h.org/fr": "allow", "http://h.org/fr/x": "block", "http://h.org/" + "a/" * 3000: "allow"}
    caps = spark.createDataFrame([(u, D(2024, 3, 1), 1, 2) for u in urls], "url string, fetched date, best int, `a.b` int")
    got = urlfilter.filtered(caps, log)
    assert got.columns == [*caps.columns, "n_active", "entry", "verdict"]
    assert {r.url: r.verdict for r in got.collect()} == urls and {(r.best, r["a.b"]) for r in got.collect()} == {(1, 2)}
