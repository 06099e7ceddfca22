"""Near duplicates, quality rules, decontamination, sites and URLs against brute force or held-out labels."""
import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftwatch.llm import decontaminate, ngram_join, quality_rules, site_quality, url_filter
from tests.llm.conftest import words

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
null_last = lambda r: tuple((x is None, x or 0) for x in r)


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block_bytes", [1 << 20, 9000])
def test_near_duplicates(docs, corpus, block_bytes):
    last = ngram_join.LAST
    items = sorted({(last if i is None else i, t or "") for i, t in corpus})
    sets = [shingles(t) for _, t in items]
    top = list(range(len(items)))

    def root(a):
        while top[a] != a:
            a = top[a]
        return a
    for a in range(len(items)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    label = {item: (len(s), items[root(n)][0]) for n, (item, s) in enumerate(zip(items, sets))}
    want = []
    for i, t in corpus:
        n, c = label[last if i is None else i, t or ""]
        want.append((i, n, None if c == last else c))
    got = [tuple(r)[:3] for r in ngram_join.near_duplicates(docs, block_bytes=block_bytes).collect()]
    assert sorted(got, key=null_last) == sorted(want, key=null_last)
    assert len({r[2] for r in got}) < len(got) - 20


def test_quality_counts(docs, corpus):
    def count(i, text):
        w = words(text)
        grams = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if grams[tuple(w[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
                len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))
    out = quality_rules.judge(docs).collect()
    assert sorted((tuple(r)[:7] for r in out), key=null_last) == sorted((count(*r) for r in corpus), key=null_last)
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_quality_against_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    out = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    n = {(r["label"], r["kept"]): r["count"] for r in out.groupBy("label", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_em_learns_who_is_right():
    none = (0,) * 8
    bad, doubtful = (0, 0, -1, 0, -1, 0, 0, 0), (0, 0, 0, -1, 0, 0, 0, 1)
    base, adds = quality_rules.fit([(none, 800), (bad, 100), (doubtful, 5)])
    assert quality_rules._posterior(bad, base, adds) < 0.05 < 0.5 < quality_rules._posterior(none, base, adds)
    assert quality_rules.fit([])[0] == pytest.approx(math.log(4))


@pytest.mark.parametrize("bound", [50_000, 0])
def test_decontamination(spark, docs, corpus, bound):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    long = [t for _, t in corpus if t and len(norm(t)) > 40]
    bench = [("a", " ".join(norm(long[0])[5:20])), ("b", " ".join(norm(long[1])[:10])), ("c", "ONE"), ("d", None), ("e", "--"),
             ("a2", " ".join(norm(long[0])[9:30])), ("f", " ".join(norm(long[2])[3:7])), ("g", "x y x"), (None, "y")]
    want = []
    for i, t in corpus:
        w, hit, items = norm(t), set(), set()
        for item, text in bench:
            b = norm(text)
            n = min(10, len(b))
            for s in range(len(b) - n + 1) if n and item else ():
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == b[s:s + n]:
                        hit.update(range(p, p + n))
                        items.add(item)
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    items = spark.createDataFrame(bench, "item_id string, text string")
    got = [tuple(r)[:6] for r in decontaminate.find(docs, items, broadcast_windows=bound).collect()]
    assert Counter(got) == Counter(want)
    none = decontaminate.find(docs, items.limit(0)).collect()
    assert len(none) == len(corpus) and not any(r["contaminated"] for r in none)


def test_sites_on_held_out_labels(spark, docs, empty):
    docs1, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out = site_quality.classify(docs1, labels.where(~held)).drop("quality").join(labels.where(held), "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in out) >= 0.97 * len(out)
    few = spark.createDataFrame([(1, 1), (408, 0), (409, None), (None, 1)], "doc_id long, quality int")
    assert site_quality.classify(docs, few).count() == docs.count()
    alone = site_quality.classify(docs, few.limit(0))
    assert alone.where("kept").count() == docs.count()
    assert site_quality.classify(empty, few).count() == 0


def test_shrinkage(spark):
    groups = spark.createDataFrame([(1000, 900.0), (1000, 100.0), (1000, 500.0)], "n long, good double")
    assert site_quality._strength(groups, 0.5) < 10
    assert site_quality._strength(groups.limit(1), 0.5) == site_quality.STRONGEST


URLS = [(1, "https://A.Example.ORG/es/x?q=1#z"), (2, "http://example.org/en/12"), (3, "http://x.org"), (4, "http://x.org/"),
        (5, "ftp://shop.com/fr/a#b"), (6, "https://com/de/"), (7, "no scheme"), (8, None), (9, ""), (10, "a://b.net/fr/c"),
        (11, "a://b.net/de/c"), (11, "a://b.net/de/c"), (None, "https://w.com/en/1"), (12, "http://notexample.org/es/"), (13, "x://h?/p"),
        (14, "http://y.com/" + "ab/" * 3000)]


def test_url_rules_and_ratio(spark):
    pages = spark.createDataFrame(URLS + [(100 + i, f"http://s{i}.com/{p}/{i}") for i in range(40) for p in ("fr", "de")],
                                  "page_id long, url string")
    out = {(r["page_id"], r["path"]): r for r in url_filter.filter_urls(pages).collect()}
    rule = lambda i: next((r["host"], r["path"], r["rule"], r["verdict"]) for (k, _), r in out.items() if k == i)
    assert rule(1) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert rule(2) == ("example.org", "/en/12", "example.org/en/1", "block")
    assert rule(3)[:3] == ("x.org", "", None) and rule(4)[2:] == ("org/", "allow")
    assert rule(5)[2:] == ("com/fr/", "allow") and rule(6) == ("com", "/de/", "com/de/", "block")
    assert rule(7)[:3] == rule(8)[:3] == rule(9)[:3] == ("", "", None) and rule(13)[:2] == ("h", "")
    assert rule(12)[2] == "org/" and rule(10)[3] == "allow" and rule(11)[3] == "block"


def test_url_scores(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = url_filter.filter_urls(pages).collect()
    order, start, end = 4, url_filter.START, url_filter.END
    verdict = {r["host"] + r["path"]: r["verdict"] for r in rows if r["rule"]}
    held = {r["s"] for r in spark.createDataFrame([(s,) for s in verdict], "s string").where(
        F.pmod(F.xxhash64(F.lit(7), "s"), F.lit(5)) == 0).collect()}
    counts = {c: [Counter() for _ in range(order + 1)] for c in ("allow", "block")}
    for r in rows:
        s = r["host"] + r["path"]
        if r["rule"] and s not in held:
            t = start * order + s + end
            for i in range(order, len(t)):
                for k in range(order + 1):
                    counts[r["verdict"]][k][t[i - k:i + 1]] += 1
    totals = {c: [defaultdict(lambda: [0, 0]) for _ in range(order + 1)] for c in counts}
    for c, by in counts.items():
        for k, grams in enumerate(by):
            for g, n in grams.items():
                totals[c][k][g[:-1]][0] += n
                totals[c][k][g[:-1]][1] += 1

    def log(c, t, i):
        p = url_filter.UNIFORM
        for k in range(order + 1):
            n, kinds = totals[c][k].get(t[i - k:i], (0, 0))
            if n:
                p = (counts[c][k][t[i - k:i + 1]] + kinds * p) / (n + kinds)
        return math.log(p)
    for r in rows:
        if not r["rule"]:
            t = start * order + r["host"] + r["path"] + end
            want = sum(log("allow", t, i) - log("block", t, i) for i in range(order, len(t))) / (len(t) - order)
            assert r["score"] == pytest.approx(want, abs=1e-6)


def test_whole_urls_are_scored(spark):
    from driftwatch.llm import queries
    rows = [(i, f"https://s{i}.com/{p}/x?{q}={i}") for i in range(200) for p, q in (("fr", "page"), ("de", "utm"))]
    rows += [(1001, "https://n.net/x?page=7"), (1002, "https://n.net/x?utm=7"), (1003, "https://n.net/x#utm=7"),
             (1004, "page=7"), (1005, "utm=7"), (1006, None), (1007, "http://n.net/x?page=7")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, whole=True).where("page_id > 1000").collect()}
    assert {(r["host"], r["path"], r["rule"]) for i, r in got.items() if i in (1001, 1002, 1003, 1007)} == {("n.net", "/x", None)}
    assert got[1001]["score"] > got[1002]["score"] and got[1004]["score"] > got[1005]["score"]
    assert len({got[i]["score"] for i in got}) == len(got)
    table = spark.read.parquet(f"{SF}/pages.parquet")
    assert Counter(queries.op2(spark, SF).collect()) == Counter(url_filter.filter_urls(table, whole=True).collect())


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([("a", "b")], "item_id string, text string")
    pages = spark.createDataFrame([], "page_id long, url string")
    for df in (ngram_join.near_duplicates(empty), quality_rules.judge(empty), decontaminate.find(empty, bench), url_filter.filter_urls(pages)):
        assert df.collect() == []
