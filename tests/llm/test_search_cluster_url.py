"""Lexical search, clustering and the URL filter against brute force and DuckDB, and on odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from orbifold.llm import clusters, lexical, queries, url_filter

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=20):
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in own:
            m = 75 + 25 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


@pytest.fixture
def small_windows(monkeypatch):
    """Windows, pieces and blocks small enough for several of each."""
    monkeypatch.setattr(lexical, "WINDOW", 64)
    monkeypatch.setattr(lexical, "PIECE", 40)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)


def test_search_is_brute_force(spark, small_windows):
    rng = random.Random(5)
    words = ["Alpha", "beta", "ÄRGER", "ärger", "x1", "Ω", "naïve", "go", "zz", "1"] + [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "\u00a0", ".", "\x00", "\u3000end"]) for _ in range(400)]
    docs = [(i * 7 if i % 9 else i * 10**12, t) for i, t in enumerate(texts)] + [(7, texts[1]), (7, texts[1]), (None, texts[3]), (None, "go go go"), (5, None), (6, ""), (8, "go " * 5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(40)] + [(90, None), (91, "..."), (92, "go, go; GO"), (93, "unheardof")]
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, score int, item_id int").repartition(3)
    out = lexical.search(frame, spark.createDataFrame([*items, (3, "zzzz later text"), (None, "go")], "item_id long, text string"))
    got = sorted((tuple(r) for r in out.collect()), key=lambda x: x[:2])
    assert got == plain_search(docs, [(i, min(t, "zzzz later text") if i == 3 else t) for i, t in items])


def test_windows_are_clear_again():
    w = lexical.Windows()
    rng = np.random.default_rng(1)
    term, place = rng.integers(0, 5, 500), rng.integers(0, lexical.WINDOW, 500)
    keep = np.unique(term * lexical.WINDOW + place, return_index=True)[1]
    term, place, score = term[keep], place[keep], rng.integers(0, 9, len(keep))
    w.load(term, place, score, 6)
    for own, times in (([0, 3], [1, 2]), ([5], [1]), ([1, 2, 4], [1, 1, 1])):
        want = Counter()
        for t, n in zip(own, times, strict=True):
            for p, s in zip(place[term == t].tolist(), score[term == t].tolist(), strict=True):
                want[p] += n * s
        found, scores = w.of_item(np.array(own), np.array(times))
        assert dict(zip(found.tolist(), scores.tolist(), strict=True)) == {p: want[p] for p in want}
        assert not w.scores.any() and not w.occupied.any()


def test_search_of_nothing(spark, no_docs):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical.search(no_docs, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "word")], "doc_id long, text string"), items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r) for r in lexical.search(spark.createDataFrame([(1, "word")], "doc_id long, text string"), items).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 1200)))]


def plain_clusters(vectors, k, rounds):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [best(v)[1] for _, v in rows]
        centres = [[sum(col) // len(m) for col in zip(*m, strict=True)] if (m := [v for (_, v), o in zip(rows, own, strict=True) if o == j]) else c for j, c in enumerate(centres)]
    told = [(i, *best(v)) for i, v in rows]
    each = Counter()
    for _, d, j in told:
        each[j] += d
    return sorted(((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in told), key=str)


def test_clusters_are_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(3 * (i % 5), 1) for _ in range(8)]) for i in range(200)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (None, rows[1][1]), (1000, [0.0] * 8), (1001, [0.0] * 8), (1002, [30000.0] * 8)]
    odd = [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [None] + [1.0] * 7), (2004, [math.nan] + [1.0] * 7), (2005, [math.inf] + [1.0] * 7)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int").repartition(3)
    for k, rounds in ((6, 5), (500, 1), (1, 2)):
        got = sorted((tuple(r) for r in clusters.cluster_vectors(frame, k, rounds, dim=8).collect()), key=str)
        assert got == plain_clusters(rows, k, rounds)
    assert clusters.cluster_vectors(frame.where("false")).count() == 0


def test_bounds_hold_and_screen():
    rng = np.random.default_rng(2)
    centres = np.floor(rng.normal(0, 1, (30, 64)) * rng.choice([1, 100], (30, 64))).astype(np.int64)
    x = centres[rng.integers(0, 30, 2000)] + rng.integers(-2, 3, (2000, 64))
    exact = ((x[:, None] - centres) ** 2).sum(axis=2)
    assert (clusters.lower_bounds(clusters.segment_norms(x), clusters.segment_norms(centres)) <= exact).all()
    cluster, distance, taken = clusters.nearest(x, clusters.segment_norms(x), centres)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert taken < 0.2 * exact.size  # most centroids are ruled out
    wide = np.array([[clusters.LARGEST] * 64, [-clusters.LARGEST] * 64])
    assert clusters.nearest(wide, clusters.segment_norms(wide), wide[:1])[1].tolist() == [0, 64 * (2 * clusters.LARGEST) ** 2]


def test_components_are_cut(spark):
    rows = spark.createDataFrame([(1, [1e30] * 64), (2, [-1e30] * 64)], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.distance for r in clusters.cluster_vectors(rows, 1, 0).collect()}.keys() == {1, 2}


URLS = [
    "http://a.net/", "http://net", "http://net/x", "https://EXAMPLE.net/en/1", "http://sub.example.net/en/", "http://sub.example.net/en", "http://badexample.net/en/9",
    "http://example.com/de/", "http://x.example.com/de/5?q=1", "http://example.com/DE/", "http://y.org/fr/2#a", "http://org/fr/", "http://anorg/fr/", "http://y.org/en/",
    "ftp://cheapcasinowin.com/free-pills", "http://goodwordshere.org/read/more/12", "no scheme", "", None, "x://a://b.net/", "http://h?x=/y", "http://h#/y", "http://ÜBER.Net/", "://net/", "http://" + "the" * 3000 + ".com/",
    "http://evilpills.net/es/1", "http://evilpills.net/es/2", "http://goodwords.example.net/en/1", "http://evilpills.com/es/3", "http://goodwords.com/x",
]


def plain_segment(cost, unknown, name):
    """The least cost of a name by trying known words and runs of other letters from each place on."""
    least = [(math.inf, math.inf)] * len(name) + [(0.0, 0.0)]  # (best, best where the letters before are an open run)
    for a in range(len(name) - 1, -1, -1):
        ways = [cost[name[a:b]] + least[b][0] for b in range(a + 1, min(len(name), a + 24) + 1) if name[a:b] in cost]
        run = math.log(26) + least[a + 1][1]
        least[a] = (min([*ways, unknown + run]), min([*ways, run]))
    return least[0][0]


def test_segments_have_the_least_cost():
    rng = random.Random(4)
    counts = {w.encode(): rng.randint(1, 500) for w in ("the", "he", "then", "cheap", "heap", "cas", "win", "in", "ow", "word", "s", "words", "a", "and")}
    words = url_filter.Words.of(counts)
    assert words.segment(b"cheapcasinowin") == (b"cheap", b"casino", b"win") and words.segment(b"goodwordsandthen") == (b"good", b"words", b"and", b"then")
    for _ in range(300):
        name = "".join(rng.choices(["the", "cheap", "win", "q", "zx", "and", "s", "in"], k=rng.randint(1, 6))).encode()
        found = words.segment(name)
        spent = sum(words.cost.get(w, words.unknown + len(w) * math.log(26)) for w in found)
        assert b"".join(found) == name and math.isclose(spent, plain_segment(words.cost, words.unknown, name))


def test_urls_are_judged_by_rules_then_words(spark):
    html = "<p class='cheap'>the good words here read more good words the the and then evil word</p>" * 20
    rows = [(i, u, None if i == 3 else html) for i, u in enumerate(URLS)]
    frame = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string").repartition(3)
    got = {r.page_id: r for r in url_filter.judge_urls(frame).collect()}
    assert len(got) == len(URLS)
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", [(i, u) for i, u, _ in rows])
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    want = db.sql(f"""
      WITH h AS (SELECT page_id, translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                        regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
      r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
      SELECT page_id, h.host, h.path, arg_max(r.host || r.path, length(r.host || r.path)), arg_max(r.verdict, length(r.host || r.path))
      FROM h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY ALL""").fetchall()
    for i, host, path, rule, verdict in want:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[i]
        assert r.verdict == verdict if rule else r.verdict == ("block" if r.log_odds > 0 else "allow")
    by = {URLS[i]: r for i, r in got.items()}
    assert by["http://net"].rule is None and by["http://a.net/"].rule == "net/" and by["http://badexample.net/en/9"].rule == "net/"
    assert by["ftp://cheapcasinowin.com/free-pills"].words == ["cheap", "casino", "win", "com"] and by["ftp://cheapcasinowin.com/free-pills"].verdict == "block"
    assert by["http://evilpills.com/es/3"].verdict == "block" and by["http://goodwords.com/x"].verdict == "allow" and by[None].verdict == by[""].verdict == "allow"
    # the whole method again, counted plainly
    counts = Counter(w for _, _, t in rows if t for w in re.findall(rb"[a-z]+", re.sub(rb"<[^>]*>", b" ", t.encode())))
    words = url_filter.Words.of(counts, url_filter.RULES)
    n = {v: Counter(w for i, r in got.items() if r.rule and r.verdict == v for w in words.telling(r.host, r.path)) for v in ("block", "allow")}
    share = max(1.0, url_filter.SEED_SHARE * n["block"].total())
    seen = len(set(n["block"]) | set(n["allow"]) | {s.encode() for s in url_filter.SEEDS})
    block = {w: n["block"][w] + share * (w.decode() in url_filter.SEEDS) for w in set(n["block"]) | set(n["allow"]) | {s.encode() for s in url_filter.SEEDS}}
    for r in got.values():
        s = sum(math.log((block[w] + 1) / (sum(block.values()) + seen)) - math.log((n["allow"][w] + 1) / (n["allow"].total() + seen)) for w in words.telling(r.host, r.path) if w in block)
        assert math.isclose(s, r.log_odds, abs_tol=1e-9), r


def test_no_urls(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", ["op11_lexical", "op12_clusters"])
def test_queries_equal_their_sql(spark, name):
    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    out = queries.queries()[name](spark, path)
    assert sorted(tuple(r) for r in out.collect()) == sorted(db.sql(queries.oracle_sql()[name]).select(*out.columns).fetchall())
