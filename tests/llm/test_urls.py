"""The URL filter against a loop over entries, on captures with nulls, ties, repeats, addresses and clashing names."""

import re

import pytest
from cases import same

from cohortloom.llm import urls

ENTRIES = "list string, kind string, pattern string, action string, day long"


def host(url):
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.%]+\]|[^/:?#\[\]]+)([^?#]*)", (url or "").lower())
    name = m[1].rstrip(".") if m else ""
    if not name:
        return None, None
    path = re.match(r"(?::\d*)?/([^/]+)", m[2])
    return name, path and f"{name}/{path[1]}"


def brute(captures, entries):
    out = []
    for row in captures:
        url, day = row[1], row[2]
        name, prefix = host(url)
        active = []
        if name is not None and day is not None:
            labels = name.split(".") if name[0] != "[" else [name]
            mine = {("host", name), ("prefix", prefix), *(("domain", ".".join(labels[k:])) for k in range(len(labels)))}
            for key in {e[:3] for e in entries if None not in e and e[1:3] in mine}:
                before = [e for e in entries if None not in e and e[:3] == key and e[4] <= day]
                if before:
                    last = max(e[4] for e in before)
                    if "remove" not in {e[3] for e in before if e[4] == last}:
                        active.append((key[0], last))
        lists = sorted({x for x, _ in active})
        # Of one list and pattern added on several days without a removal, each day starts an interval of its own.
        out.append((*row[:3], len(active), ",".join(lists), min((d for _, d in active), default=None), bool(active) and "allow" not in lists))
    return out


CAPTURES = [
    (1, "http://www.a.com/x/y", 5), (2, "http://www.a.com/x/y", 50), (2, "http://www.a.com/x/y", 50), (3, "HTTPS://User:pw@A.COM.:8080/", 120), (4, "https://[2001:db8::1]:443/p/q", 9),
    (5, "ftp://b.org", 0), (6, None, 5), (7, "", 5), (8, "no url", 5), (9, "http:///path", 5), (10, "http://c.b.org/?q=http://a.com/", None), (11, "http://windows.com/x?y", 130), (None, "http://a.com#f", 64), (12, "http://" + "s." * 200 + "a.com/" + "p" * 100_000, 64),
]
LISTED = [
    ("block", "domain", "a.com", "add", 3), ("block", "domain", "a.com", "remove", 60), ("block", "domain", "a.com", "add", 100), ("allow", "prefix", "www.a.com/x", "add", 40), ("allow", "prefix", "www.a.com/x", "remove", 50),
    ("spam", "host", "[2001:db8::1]", "add", 9), ("block", "prefix", "[2001:db8::1]/p", "add", 9), ("spam", "host", "b.org", "add", 0), ("spam", "host", "b.org", "remove", 0), ("block", "domain", "org", "add", 0), ("block", "domain", "org", "add", 0),
    (None, "domain", "com", "add", 0), ("block", None, "com", "add", 0), ("block", "domain", None, "add", 0), ("block", "domain", "com", None, 0), ("block", "domain", "com", "add", None), ("late", "host", "windows.com", "add", 131),
]


@pytest.mark.parametrize("most", [500_000, 0])
def test_url_filter(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_ROWS", most)
    entries = spark.createDataFrame(LISTED, ENTRIES)
    df = spark.createDataFrame([(*c, "x", "y", 7, True) for c in CAPTURES], "page_id long, url string, day long, lists string, since string, n_active long, blocked boolean").repartition(3)
    got = urls.evaluate(df, entries)
    assert got.columns == ["page_id", "url", "day", "n_active", "lists", "since", "blocked"]
    same(got, brute(CAPTURES, LISTED))
    other = urls.evaluate(df.select("page_id", "url", "day", "lists").withColumnRenamed("lists", "pattern").selectExpr("*", "pattern AS kind"), entries)
    assert other.columns[:5] == ["page_id", "url", "day", "pattern", "kind"]
    same(other.select("page_id", "url", "day", "n_active", "lists", "since", "blocked"), brute(CAPTURES, LISTED))


def test_url_filter_of_nothing(spark):
    entries, df = spark.createDataFrame(LISTED, ENTRIES), spark.createDataFrame(CAPTURES, "page_id long, url string, day long")
    assert urls.evaluate(df.limit(0), entries).count() == 0
    none = urls.evaluate(df, entries.limit(0)).collect()
    assert len(none) == len(CAPTURES) and not any(r["n_active"] or r["blocked"] or r["lists"] for r in none)


def test_hosts_of_the_sample_list(spark):
    pages = spark.createDataFrame([(k, f"http://windows{k}.com/x") for k in range(60)] + [(k, f"http://win.site{k}.com/") for k in range(60, 120)], "page_id long, url string")
    kinds = {(r["pattern"].startswith("windows"), r["list"]) for r in urls.sample_entries(pages).where("kind = 'host'").collect()}
    assert (True, "spam") not in kinds and (False, "spam") in kinds
