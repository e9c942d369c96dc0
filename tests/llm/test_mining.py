"""Collocations, periodic runs and URL filters against plain versions."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest import duck, rows_of

from quillgraph.llm import periodic_runs as runs
from quillgraph.llm import url_filters as filters
from quillgraph.llm.collocations import collocations
from quillgraph.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_collocations", "op13_url_filters"])
def test_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck(SF).execute(ORACLES[name]).df())


# ---- collocations


def plain_collocations(rows, max_words, least, percent, top):
    phrases, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", small):
            found = re.findall("[^ \t]+", piece)
            words[lang] += len(found)
            counts = phrases.setdefault(lang, Counter())
            for k in range(1, max_words + 1):
                counts.update(tuple(found[i : i + k]) for i in range(len(found) - k + 1))
    out = []
    for lang, counts in phrases.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        mine = []
        for p, a in able.items():
            inner = [q for q in able if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * able[q] >= percent * a for q in inner):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("max_words", "block_chars"), [(3, 40), (2, 10_000), (4, 300)])
def test_collocations(spark, max_words, block_chars):
    rng = random.Random(max_words)
    words = ["a", "b", "C", "é", "É", "d-e", "\x00", "\x1f", "\u2003", "'"]
    rows = [(rng.choice(["en", "en", "en", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "?"]) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    rows += [("en", None), (None, None), ("en", ""), ("xx", " . ,"), ("en", "of the old town " * 50), ("en", rows[0][1]), ("en", rows[0][1])]
    docs = spark.createDataFrame([(lang, text, "x") for lang, text in rows], "lang string, text string, phrase string").repartition(3)
    got = collocations(docs, max_words, 4, 50, 12, block_chars)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, max_words, 4, 50, 12)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations(empty).count() == 0


# ---- periodic runs


def plain_runs(words, least=6, times=4):
    found = set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            begin = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i + q - begin
            part = words[begin : begin + size]
            if size >= max(least, times * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.add((begin, size, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant=True):
    words = re.findall("[^ \t-\r]+", text or "")
    if plant and doc_id is not None:
        words = [w.decode() for w in runs.repeated_by_id(str(doc_id), [w.encode() for w in words])]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *figures, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, kinds = rng.choice([0, 1, 5, 6, 7, 20, 60, 200]), rng.choice([1, 2, 3, 50])
            words = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), 1 + n // rng.randint(3, 10)
                words = words[:a] + [words[a + k % p] if a + k % p < n else 0 for k in range(n - a)]
            texts.append(words)
        assert runs.runs_of([np.array(w, dtype=np.int64) for w in texts]) == [plain_runs(w) for w in texts]


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for n, kinds in ((1, 1), (2, 1), (50, 2), (300, 1), (700, 5), (400, 10**7)):
        words = rng.integers(0, kinds, n)
        words = np.append(words, kinds + 1)
        order, rank = runs.suffix_order(words)
        want = sorted(range(len(words)), key=lambda k: words[k:].tolist())
        assert order.tolist() == want and rank[order].tolist() == list(range(len(words)))
        both = runs.Extensions(words)
        a, b = rng.integers(0, len(words), 300), rng.integers(0, len(words), 300)
        a, b = a[a != b], b[a != b]

        def alike(x, y):
            k = 0
            while max(x, y) + k < len(words) and words[x + k] == words[y + k]:
                k += 1
            return k

        assert both.of(a, b).tolist() == [alike(x, y) for x, y in zip(a, b, strict=True)]


def test_planted_runs_are_found(spark):
    rng = random.Random(4)
    text = lambda n, kinds: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    rows = [(k, text(rng.randint(0, 90), rng.choice([2, 9, 400]))) for k in range(220)]
    rows += [(None, "x y " * 9), (5, None), (6, ""), (7, " \t\n "), (8, "a\u2003b " * 30), (8, "a\u2003b " * 30), (9, "É\x1fé É\x1fé é " * 8), (10, text(5000, 3000) + " go on" * 700)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, period int").repartition(3)
    for plant in (False, True):
        got = runs.periodic_runs(docs, runs.repeated_by_id if plant else None, batch_words=500)
        assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_row(i, t, plant) for i, t in rows), key=str)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_runs_query(spark):
    got = QUERIES["op12_periodic_runs"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert len(found) == 200 and len(docs) > 100
    assert all(found[r["doc_id"]] == plain_row(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in found.values()) >= 10


# ---- URL filters


def test_parts_of_urls(spark):
    urls = {
        None: ("", ""), "": ("", ""), "example.org/x": ("", ""), "http://A.Example.ORG": ("a.example.org", ""), "http://É.x/É?q#f": ("É.x", "/É"), "x://a?b/c": ("a", ""), "x://a#b": ("a", ""),
        "http://u@h:80/a/b#c?d": ("u@h:80", "/a/b"), "://": ("", ""), "a://b://c/d": ("b:", "//c/d"), "http://a.b/x\ny": ("a.b", "/x\ny"),
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = filters.host_and_path(rows["url"])
    assert {r["url"]: (r["h"], r["p"]) for r in rows.select("url", host.alias("h"), path.alias("p")).collect()} == urls


def test_sites(spark):
    from pyspark.sql import functions as F

    sites = {"a.b.example.com": ("com", "example.com"), "b.example.co.uk": ("co.uk", "example.co.uk"), "co.uk": ("co.uk", "co.uk"), "com": ("com", "com"), "": ("", ""), "10.0.0.1": ("", "10.0.0.1"), "[::1]": ("", "[::1]"), "x.shop.fr": ("fr", "shop.fr")}
    site = F.col("site")
    got = spark.createDataFrame([(s,) for s in sites], "site string").select("site", filters.suffix_of(site).alias("s"), filters.domain_of(site, filters.suffix_of(site)).alias("d"))
    assert {r["site"]: (r["s"], r["d"]) for r in got.collect()} == sites
    named = spark.createDataFrame([("u:p@a.b:80",), ("a.b.",), ("a.b",), ("a.b.:1",)], "h string").select(filters.site_of(F.col("h")).alias("s")).collect()
    assert [r["s"] for r in named] == ["a.b"] * 4


def test_rules_before_reputation(spark):
    rules = [filters.Rule("example.org", "/", "block"), filters.Rule("example.org", "/a/", "allow"), filters.Rule("b.example.org", "/", "allow")]
    urls = {"http://example.org/x": "block", "http://w.example.org/a/1": "allow", "http://b.example.org/x": "allow", "http://c.b.example.org/": "allow", "http://notexample.org/": "allow", "http://example.org": "allow", "http://bad.net/": "block", None: "allow"}
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(None, None, "x"), (0, "http://example.org/x", "x")], "page_id long, url string, verdict string")
    found = spark.createDataFrame([("bad.net", 0.1), ("b.example.org", 0.1)], "site string, upper double")
    rows = filters.judge(pages, found, rules).collect()
    assert len(rows) == len(urls) + 2 and {r["page_id"]: r["verdict"] for r in rows if r["page_id"] is not None} == dict(enumerate(urls.values()))
    assert {r["rule"] for r in rows} == {None, "example.org/", "example.org/a/", "b.example.org/"}


def test_reputation_finds_planted_hosts(spark):
    """Hosts of a bad domain with few or no labels go with it; a good host of mixed company stays; one bad label blocks
    nobody; a third of all pages has one host."""
    rng = random.Random(1)
    pages = []
    for d in range(60):
        share = 0.03 if d < 6 else 0.95
        for h in range(8):
            labelled = rng.choice([0, 1, 3, 30]) if h else 60
            pages += [(f"h{h}.d{d}.com", int(rng.random() < share)) for _ in range(labelled)] + [(f"h{h}.d{d}.com", None)] * 3
    pages += [("one.alone.net", 0), ("big.net", None)] + [("big.net", int(rng.random() < 0.9)) for _ in range(3000)]
    found = {r["site"]: r for r in filters.reputations(spark.createDataFrame([(*p, "x") for p in pages], "host string, good int, site string")).collect()}
    blocked = {s for s, r in found.items() if r["upper"] < 0.5}
    assert blocked == {f"h{h}.d{d}.com" for d in range(6) for h in range(8)}
    assert found["big.net"]["n"] == 3000 and abs(found["big.net"]["mean"] - 0.9) < 0.03 and found["h1.d9.com"]["upper"] <= 1
    assert filters.reputations(spark.createDataFrame([], "host string, good int")).count() == 0
    unlabelled = filters.reputations(spark.createDataFrame([("a.b", None), (None, None), (None, 1)], "host string, good int")).collect()
    assert {r["site"]: r["n"] for r in unlabelled} == {"a.b": 0, "": 1}
