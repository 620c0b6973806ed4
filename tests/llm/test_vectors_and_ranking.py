"""Centroid clustering, ranked search and language-model scores against brute force, with edge rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import katz_lm, lexical_search, orchard_kmeans, topk_search, url_filter
from ledgerlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 11: centroid clustering

def plain_kmeans(vectors, k, rounds, seed=3):
    """(id, cluster, distance) by comparing every vector with every centroid."""
    ranked = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)
    centroids = [v for _, v in ranked[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in vectors:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, centroids)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in vectors), key=repr)


def test_orchard_finds_the_nearest_of_many_centroids():
    rnd = np.random.default_rng(3)
    centroids = rnd.integers(-40, 40, (60, 3))
    centroids[7] = centroids[3]
    search = orchard_kmeans.Orchard(centroids.tolist())
    x = np.concatenate([rnd.integers(-50, 50, (400, 3)), centroids, (centroids[:30] + centroids[30:]) // 2])
    now, dist = search.nearest(x)
    for v, c, d in zip(x, now, dist):
        assert (d, c) == min((int(((v - o) ** 2).sum()), j) for j, o in enumerate(centroids))
    assert search.measured < 0.6 * len(x) * len(centroids)  # the walk ends early


def test_orchard_on_numbers_beyond_a_long():
    search = orchard_kmeans.Orchard([[0, 0], [1 << 53, 0], [0, 1 << 53]])
    now, dist = search.nearest(np.array([[1 << 52, 1], [-(1 << 53), 1 << 53], [5, 5]]))
    assert now.tolist() == [0, 2, 0] and dist.tolist() == [(1 << 104) + 1, 1 << 106, 50]


def test_clusters_with_ties_repeated_rows_and_unusable_vectors(spark):
    rnd = random.Random(4)
    vectors = [(i, [rnd.randrange(-3, 4) for _ in range(3)]) for i in range(90)]
    vectors += [vectors[5], vectors[6], (None, [1, 2, 3]), (200, [0, 0, 0])]
    unusable = [(300, None), (301, [1.0, None, 2.0]), (302, [1.0, 2.0]), (303, [float("nan")] * 3), (304, [float("inf"), 0.0, 0.0]), (305, [])]
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], "c", 1, 2, 3) for i, v in vectors + unusable],
                               "vec_id long, embedding array<double>, cluster string, id int, part int, v int")
    got = orchard_kmeans.cluster(df, k=6, rounds=4, dim=3, scale=1.0)
    rows = got.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in rows), key=repr) == plain_kmeans(vectors, 6, 4)
    total = Counter()
    for r in rows:
        total[r.cluster] += r.distance
    assert all(r.cluster_inertia == total[r.cluster] and r.inertia == sum(total.values()) for r in rows)
    few = orchard_kmeans.cluster(df.where("vec_id < 3"), k=6, rounds=4, dim=3, scale=1.0).collect()
    assert [r.distance for r in few] == [0, 0, 0]
    for none in (df.limit(0), df.where("vec_id >= 300")):
        out = orchard_kmeans.cluster(none, dim=3)
        assert out.count() == 0 and out.columns == got.columns
    huge = spark.createDataFrame([(1, [1e300, 0.0, 0.0]), (2, [-1e300, 0.0, 0.0]), (3, [1e300, 0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.distance for r in orchard_kmeans.cluster(huge, k=1, rounds=1, dim=3).collect()}[2] == orchard_kmeans.LONG_MAX


@pytest.mark.parametrize("name", ["op11_orchard_kmeans", "op12_lexical_search"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows_of(QUERIES[name](spark, SF)) == sorted(con.execute(ORACLE[name]).fetchall(), key=repr)


# 12: ranked search

def plain_search(docs, items, k):
    cut = [(i, lexical_search.terms_of(t)) for i, t in docs]
    cut = [(i, Counter(ts), len(ts)) for i, ts in cut if ts]
    n_docs, total = len(cut), sum(n for *_, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(lexical_search.terms_of(t))
    out = []
    for i, ts in asked.items():
        found = []
        for j, c, n in cut:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                found.append((-s, j is None, j or 0))
        out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def searched():
    rnd = random.Random(8)
    words = ["w" + str(int(rnd.paretovariate(0.7))) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(rnd.choice([1, 2, 5, 9, 40, 40, 40, 300]))) for i in range(260)]
    docs += [(400 + i, docs[3][1]) for i in range(30)]  # ties
    docs += [docs[9], (None, docs[10][1]), (None, None), (500, None), (501, ""), (502, " .,!"), (503, "Größe W1 w1 中文_w2\x7fw3"), (504, "w1 " * 30000)]
    items = [(i, text(rnd.choice([1, 3, 30]))) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere else"), (None, "w1 w2"), (33, docs[3][1]), (33, "GRÖSSE größe 中文")]
    return docs, items


def test_search_against_plain_scores(spark, searched, monkeypatch):
    docs, items = searched
    d = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in docs], "doc_id long, text string, id int, n int, score int, terms string").repartition(3)
    q = spark.createDataFrame([(i, t, 0, "y") for i, t in items], "item_id long, text string, rank int, item string")
    expected = plain_search(docs, items, 7)
    assert rows_of(lexical_search.search(d, q, k=7)) == expected
    # thresholds from a few documents, many blocks of items, shares and pieces of strata
    for name, value in (("MAX_ITEMS", 4), ("MAX_PAIRS", 40), ("SHARE_POSTINGS", 100), ("CELLS", 50), ("COLUMNS", 3)):
        monkeypatch.setattr(lexical_search, name, value)
    assert rows_of(lexical_search.search(d, q, k=7, seed_docs=20)) == expected


def test_search_without_documents_or_items(spark, searched):
    d = spark.createDataFrame(searched[0], "doc_id long, text string")
    q = spark.createDataFrame(searched[1], "item_id long, text string")
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.where("text is null"), q), (d, q.where("text is null"))):
        got = lexical_search.search(a, b)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_leave_out_strata_but_no_result():
    rnd = random.Random(2)
    block = lexical_search.Block([(0, ["a", "b"]), (1, ["c"])])
    weight = np.array([700, 600, 500])
    found = []
    for m in range(50, 90):
        n = rnd.randrange(1, 6)
        at = sorted({(rnd.randrange(n), rnd.randrange(3)) for _ in range(4)})
        found.append(lexical_search.Stratum(m, np.array([m * 10 + i for i in range(n)], object), np.array([a for a, _ in at]), np.array([b for _, b in at]),
                                            np.array([rnd.choice([1, 1, 2, 60]) for _ in at])))
    s = lexical_search.Search(block, weight, 3, np.zeros(2, np.int64))
    s.add(found)
    every = {q: sorted((-int(v), (False, i)) for f in found for first, out in f.scores(weight, block.has, np.array([q])) for i, v in zip(f.ids[first:], out[:, 0]) if v)[:3] for q in (0, 1)}
    assert s.best == [every[0], every[1]] and s.scored < s.met


# 13: Katz backoff

class PlainKatz:
    def __init__(self, texts):
        cut = [katz_lm.words_of(t) + [katz_lm.END] for t in texts]
        pairs = Counter(p for ts in cut for p in zip([katz_lm.START, *ts], ts))
        self.c1, self.context = Counter(t for ts in cut for t in ts), Counter()
        for (a, _), n in pairs.items():
            self.context[a] += n
        unit = katz_lm.SCALE
        star = lambda c: {x: (t[n] if n <= 5 else n * unit) for t in [katz_lm.discounted([0] + [sum(v == r for v in c.values()) for r in range(1, 7)])] for x, n in c.items()}
        self.s1, self.s2 = star(self.c1), star(pairs)
        self.n, kept = sum(self.c1.values()), sum(self.s1.values())
        self.whole = self.n * unit if kept < self.n * unit else (self.n + 1) * unit
        self.unknown = (self.whole - kept) / self.whole
        self.kept, mass = Counter(), Counter()
        for (a, b), x in self.s2.items():
            self.kept[a] += x
            mass[a] += self.s1[b]
        self.wholes = {a: (n if self.kept[a] < n * unit else n + 1) * unit for a, n in self.context.items()}
        self.bow = {a: (1 - self.kept[a] / w) / (1 - mass[a] / self.whole) for a, w in self.wholes.items()}

    def p(self, a, b):
        if (a, b) in self.s2:
            return self.s2[a, b] / self.wholes[a]
        return self.bow.get(a, 1.0) * (self.s1[b] / self.whole if b in self.s1 else self.unknown)

    def scores(self, text):
        ts = katz_lm.words_of(text) + [katz_lm.END]
        base = sum(math.log10((self.c1[t] + 1) / (self.n + len(self.c1) + 1)) for t in ts)
        return len(ts), sum(t in self.c1 for t in ts), base, sum(math.log10(self.p(a, b)) for a, b in zip([katz_lm.START, *ts], ts))


KATZ_TEXTS = [None, "", " \t\n", "a", "a a a a a a a a", "The cat sat on the mat", "the cat sat on THE rug\nthe dog sat", "Ä ä \x1c\x85 x", "new words only", "the cat " * 4000]


def check_katz(spark, rows, monkeypatch=None, **small):
    for name, value in small.items():
        monkeypatch.setattr(katz_lm, name, value)
    df = spark.createDataFrame([(i, t, m, "s", 1, "w") for i, t, m in rows], "doc_id long, text string, train boolean, words string, seg int, score string")
    got, model = katz_lm.learn_and_score(df, F.col("train"))
    plain = PlainKatz([t for _, t, m in rows if m])
    found = sorted(((r.doc_id, r.trained, r.n_tokens, r.n_known, r.base_score, r.score) for r in got.collect()), key=repr)
    expected = sorted(((i, bool(m), *plain.scores(t)) for i, t, m in rows), key=repr)
    assert len(found) == len(expected)
    for f, e in zip(found, expected):
        assert f[:4] == e[:4] and f[4:] == pytest.approx(e[4:], rel=1e-9, abs=1e-9)
    return plain, model, found


def test_katz_against_plain_backoff(spark, monkeypatch):
    rnd = random.Random(6)
    words = [str(int(rnd.paretovariate(0.8))) for _ in range(2000)]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60))), rnd.random() < 0.8) for i in range(150)]
    texts += [(200 + i, t, i % 2 == 0) for i, t in enumerate(KATZ_TEXTS)] + [texts[4], (None, "1 2 3", True), (None, "1 2 3", None)]
    plain, model, found = check_katz(spark, texts)
    for context in ("1", "3", katz_lm.START, "the"):
        assert sum(plain.p(context, w) for w in plain.c1) + plain.p(context, "\t?") == pytest.approx(1)
    ids = {r.word: r.gid for r in model.words.collect()}
    learned = {r.gid: np.array(r[1:]) for r in model.contexts.collect()}
    for a, b in plain.bow.items():
        _, bow = katz_lm.backoff(np.array([plain.context[a]]), learned[ids[a]].reshape(-1, 1), model.pair_table, model.unigrams)
        assert bow[0] == pytest.approx(b)
    stored = Counter()
    names = {g: w for w, g in ids.items()}
    for r in model.pairs.collect():
        for v, w, c in zip(*(katz_lm.unpack(x).tolist() for x in (r.v, r.w, r.c))):
            stored[names[v], names[w]] += c
    assert stored.keys() == plain.s2.keys() and sum(stored.values()) == plain.n
    again = check_katz(spark, texts, monkeypatch, SEGMENT_BYTES=2000, HOT=3, BUCKET_PAIRS=200)[2]
    assert [f[:4] for f in again] == [f[:4] for f in found]


@pytest.mark.parametrize("marks", [False, True])
def test_katz_edges(spark, marks):
    check_katz(spark, [(i, t, marks) for i, t in enumerate(KATZ_TEXTS)])
    empty = katz_lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), F.lit(True))
    assert empty.count() == 0 and empty.columns[-1] == "score"


def test_discounts_stay_between_nothing_and_the_count():
    rnd = random.Random(1)
    for _ in range(300):
        n = [0] + [rnd.choice([0, 1, 3, 50, 1000]) for _ in range(6)]
        assert all(0 < x < r * katz_lm.SCALE for r, x in enumerate(katz_lm.discounted(n)) if r)
    assert katz_lm.discounted([0, 1000, 400, 200, 120, 80, 60])[1] < 0.8 * katz_lm.SCALE


def test_katz_query_beats_unigrams_on_held_out_texts(spark):
    rows = QUERIES["op13_katz_lm"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len({r.train_tokens for r in rows}) == 1 and rows[0].train_tokens == sum(r.n_tokens for r in rows if not r.held_out)


# 8: pivots from the data, and thresholds from the sample

def test_pivots_are_spread_and_eliminate():
    rnd = np.random.default_rng(4)
    centres = rnd.integers(-200, 200, (20, 8))
    x = (centres[rnd.integers(0, 20, 1500)] + rnd.integers(-6, 7, (1500, 8))).astype(np.float64)
    pivots = topk_search.pivots_of(x, 32)
    assert len(pivots) == 32 and len(np.unique(pivots, axis=0)) == 32
    assert len(topk_search.pivots_of(np.zeros((9, 3)))) == 1 and len(topk_search.pivots_of(x[:0])) == 0
    q, ids = x[:30], np.arange(1500)
    table = topk_search.pivot_table(x, pivots)
    least = topk_search.kth_in_sample(q, ids[:30], x[:400], ids[:400], 5)
    counted: list = []
    got = topk_search.search_block(q, ids[:30], x, ids, 5, table[:30], table, least, counted)
    want = [(i, j, -s) for i in range(30) for s, j in sorted((-int(q[i] @ x[j]), j) for j in range(1500) if j != i)[:5]]
    assert got == want and sum(counted) < 0.5 * 30 * 1500


def test_topk_with_clashing_columns_ties_and_repeated_rows(spark):
    rows = [(i, [float(i % 3), 1.0], 1, "c", [2.0], 0.5) for i in range(0, 120)] + [(50, [2.0, 1.0], 1, "c", [2.0], 0.5)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, dim string, v array<double>, least double").repartition(5)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.top_k(df, 4, scale=1.0, block=16).collect())
    want = []
    for q in (0, 50, 100):  # a repeated query is asked once, its own rows are no candidates
        score = sorted((-int(q % 3 * v[0] + 1), i) for i, v, *_ in rows if i != q)[:4]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(score)]
    assert got == want
    assert topk_search.top_k(df.limit(0)).count() == 0


# 4: URLs of many segments

def test_copies_of_a_long_url_give_few_rules(spark):
    long = "http://bad.example.org/" + "/".join(f"s{i}" for i in range(40))
    pages = [(i, long) for i in range(3)] + [(10 + i, f"http://fine.example.net/a{i}/index.html") for i in range(30)] + [(50, long + "/more"), (51, None), (52, "http://bad.example.org/s1")]
    df = spark.createDataFrame([(i, u, "h", "r", [1], 2) for i, u in pages], "page_id long, url string, host string, rule string, tokens array<int>, `row` int")
    labels = spark.createDataFrame([(i, i < 10) for i, _ in pages if i < 40], "id long, bad boolean")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, labels, [], keep=["page_id"]).collect()}
    assert got[50] == "block" and got[52] == "allow" and all(v == "allow" for i, v in got.items() if 10 <= i < 40) and got[51] == "allow"
    known = spark.createDataFrame([(i, ["x", "y", "z"] if i < 4 else ["x", "w"], i < 4) for i in range(12)], "row long, tokens array<string>, bad boolean")
    assert sorted(tuple(r.members) for r in url_filter.bundles(known).collect()) == [("w",), ("x",), ("y", "z")]
    rules = {(tuple(r["items"]), r.bad): r.confidence for r in url_filter.mine_bundles(known, min_count=3).collect()}
    assert rules[("y", "z"), True] == 1.0 and rules[("x", "y", "z"), True] == 1.0 and rules[("x",), False] == pytest.approx(8 / 12) and not any(i == ("y",) for i, _ in rules)
    assert url_filter.filter_urls(df.limit(0), labels, []).count() == 0 and url_filter.filter_urls(df, labels.limit(0), []).where("verdict = 'allow'").count() == len(pages)
