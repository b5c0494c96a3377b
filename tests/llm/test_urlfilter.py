"""The URL filter against its SQL counterpart and plain versions of its parts."""

import random
import re

import duckdb
import pytest

from tidemark.llm import urlfilter as U

SCHEMA = "page_id long, url string"


@pytest.fixture(scope="module")
def pages():
    r = random.Random(8)
    good, bad = ["news", "river", "garden", "museum", "library", "atlas"], ["xxwin", "casin0", "freebet", "spamz", "clickk", "qqbonus"]
    rows = []
    for i in range(900):
        side = i % 2
        host = r.choice(bad if side else good) + str(r.randint(0, 99))
        end, path = (r.choice([(".net", "/es/"), (".example.com", "/de/")]) if side else r.choice([(".example.net", "/en/"), (".org", "/fr/")])) if i < 600 else (".example.com", "/pt/")
        rows.append((i, f"https://{host}{end}{path}{r.choice(bad if side else good)}/{r.randint(0, 9999)}"))
    odd = [None, "", "no scheme", "://", "HTTP://A.Example.NET/en/x", "http://example.net/en", "http://example.net/en/", "http://net/", "http://net", "http://x.net?/q", "ftp://org/fr/ü#é/?", "http://myexample.net/en/", "a://b://c.net/d", "http://x.example.com/de/\nnew", "http://é.org/fr/", "http://É.ORG/x" + "y" * 3000, "http://x.net#/", "http://user@x.net:80/"]
    rows += [(1000 + i, u) for i, u in enumerate(odd)]
    return rows + [(None, rows[0][1]), (5, rows[5][1]), (5, rows[650][1]), (5, rows[650][1])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA + ", host string, text int, verdict string").repartition(3)


def test_rules(spark, pages):
    def brute(url):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].translate(str.maketrans(U.UPPER, U.LOWER)), found[2]) if found else ("", "")
        fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None)))

    got = sorted((tuple(r) for r in U.judged(frame(spark, pages)).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u in pages), key=str)


def test_equals_sql_and_separates(spark, pages):
    got = sorted((tuple(r) for r in U.classify(frame(spark, pages)).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    assert got == sorted(con.execute("SELECT page_id, host, path, rule, verdict FROM (" + U.oracle_sql() + ")").fetchall(), key=str)
    free = {i: v for i, _, _, rule, v in got if rule is None and i is not None and 600 <= i < 900}
    assert sum((v == "block") == bool(i % 2) for i, v in free.items()) >= 0.97 * 300


def test_model_is_a_distribution_and_bounded(spark, pages):
    known = U.labelled(U.judged(frame(spark, pages)))
    model = U.train(known, contexts=20)
    assert model.count() <= 20 * U.ORDER + 1
    rows = {r["ctx"]: r["ratios"] for r in model.collect()}
    assert "" in rows and all(len(v) == len(U.ALPHABET) for v in rows.values())
    assert all(c[1:] in rows for c in rows if c)  # shorter contexts are kept as well


def test_nothing_to_learn_from(spark):
    rows = [(1, "http://a.com/x"), (2, "http://b.org/fr/"), (3, None)]
    assert sorted((r["page_id"], r["verdict"]) for r in U.classify(frame(spark, rows)).collect()) == [(1, "allow"), (2, "allow"), (3, "allow")]
    assert U.classify(frame(spark, rows).limit(0)).collect() == []
