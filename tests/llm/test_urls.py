"""The URL filter against its SQL, its rules against plain Python."""

import duckdb
import pytest

from atalaya.llm import urls
from compare import rows_of


def plain(url):
    """(host, path, rule, verdict of the rule)."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return (host, path, None, None) if best is None else (host, path, best[1] + best[2], best[0])


URLS = [
    None, "", "nothing", "http://", "http://A.Example.NET/en/1", "https://x.net", "https://x.net/", "http://notnet/", "http://net/a?b",
    "http://example.com/de/3#x", "http://sub.example.com/de", "ftp://a.org/fr/", "http://ÄB.org/fr/x", "://x.net/y", "http://a.org?u=http://b.net/",
    "http://u:p@h.com:80/a//b/", "http://h.com/1/2/3/4/5/6.html", "http://h.com/\nx/", "http://EXAMPLE.net/en/",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "x", "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x", "x"), (None, "http://x.net/q", None, None)]
    rows += [(100 + i, f"http://big.com/story/title-{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'qwertzuiop'[i // 26]}/{i}", "x", "x") for i in range(200)]
    rows += [(400 + i, f"http://s.net/{'en' if i % 3 else 'fr'}/{i}", "x", "x") for i in range(30)]
    return spark.createDataFrame(rows, "page_id long, url string, verdict string, segment string")


def test_rules(pages):
    by_id = {r["page_id"]: r["url"] for r in pages.collect()}
    for r in urls.filter_urls(pages).collect():
        host, path, rule, verdict = plain(by_id[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_equals_sql(pages):
    found = urls.filter_urls(pages)
    database = duckdb.connect()
    database.register("pages", pages.toPandas())
    cursor = database.execute(urls.oracle())
    names = [c[0] for c in cursor.description]
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(names, cursor.fetchall())


def test_wildcards_and_rejection(spark, pages):
    templates = {r["template"] for r in urls.filter_urls(pages).where("host = 'big.com'").collect()}
    assert templates == {"/story/*/*"}
    # One host's section is known to be bad by labels, its other section is not judged by it.
    rules = [("block", "h.com", "/bad/1"), ("allow", "h.com", "/good/")]
    rows = [(i, f"http://h.com/bad/{i}") for i in range(1, 400)] + [(1000 + i, f"http://h.com/good/{i}") for i in range(50)]
    rows += [(2000 + i, f"http://h.com/new/x{i}/y") for i in range(5)]
    found = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules)
    verdicts = {(r["page_id"] // 1000, r["verdict"]) for r in found.collect()}
    assert verdicts == {(0, "block"), (1, "allow"), (2, "allow")}


def test_empty_table(pages):
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_paths_of_many_segments_stay_whole(spark):
    path = "/" + "/".join("ab" for _ in range(120_000))
    pages = spark.createDataFrame([(1, "http://h.test" + path)], "page_id long, url string")
    assert [(r["path"], r["template"]) for r in urls.filter_urls(pages).collect()] == [(path, path)]
