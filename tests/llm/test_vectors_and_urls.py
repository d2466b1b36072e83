"""URL rules, whitening and hard negatives against brute force, and on awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import hard_negatives as hn
from wardlight.llm import url_rules, whitening
from wardlight.llm.queries import URL_RULES
from wardlight.llm.url_rules import Index, Rule

# -- URL rules ----------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "://x", "http://EXAMPLE.net/en/1", "https://a.b.Example.NET/en/", "http://example.net/EN/1",
    "http://example.net", "http://example.net?x=/en/", "http://notexample.net/en/", "http://example.com/de/1#x", "http://x.org/fr/2?y",
    "http://org/fr/", "http://x.org/fr", "http://x.org.com/fr/", "http://a/b://c.net/", "http://example.net:80/en/", "http://x.com/login",
    "http://x.com/loginpage", "http://x.com/a?page=2&ref=x", "http://x.com/" + "a/" * 50_000 + "login", "http://x.com/é?page=é&ref=", "HTTP://X.NET/\n/en/",
]


def brute_host(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in rest[:cut]), path


def brute_rule(url, rules):
    host, path = brute_host(url)
    fits = []
    for r in rules:
        rule_host, _, rule_path = r.text.partition("/")
        if url and "://" in url and (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fits.append(r)
    return max(fits, key=lambda r: len(r.text), default=None)


def test_url_rules_match_brute_force(spark):
    rows = [(k, u, "clash", 1) for k, u in enumerate(URLS)] + [(5, URLS[5], "clash", 1), (None, URLS[5], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict int").repartition(3)
    got = url_rules.judge(pages, URL_RULES).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "host", "path", "rule", "pattern", "verdict"}
    for row in got:
        rule = brute_rule(row.url, [r for r in URL_RULES if r.kind == "host"])
        assert (row.host, row.path) == brute_host(row.url)
        assert row.rule == (rule.text if rule else None)
        if rule:
            assert row.verdict == rule.action and row.pattern is None
        else:
            assert row.verdict == ("block" if row.pattern else "allow")
    of = {r.url: r.pattern for r in got}
    assert of["http://x.com/login"] == "/login^" and of["http://x.com/loginpage"] is None and of[URLS[21]] == "/login^"
    assert of["http://x.com/a?page=2&ref=x"] == of["http://x.com/é?page=é&ref="] == "?page=*&ref="
    assert url_rules.judge(pages.limit(0), URL_RULES).count() == 0


def glob(pattern, url):
    """Whether a pattern rule fits, by trying every way to place it."""
    tied, ends = pattern.startswith("|"), len(pattern) > 1 and pattern.endswith("|")
    body = pattern[tied : len(pattern) - ends]

    def fits(i, at):
        if i == len(body):
            return not ends or at == len(url)
        if body[i] == "*":
            return any(fits(i + 1, k) for k in range(at, len(url) + 1))
        if body[i] == "^":
            apart = at < len(url) and not (url[at].isascii() and url[at].isalnum()) and url[at] not in "_.%-"
            return apart and fits(i + 1, at + 1) or at == len(url) and fits(i + 1, at)
        return at < len(url) and url[at] == body[i] and fits(i + 1, at + 1)

    return any(fits(0, k) for k in ([0] if tied else range(len(url) + 1)))


def test_patterns_and_their_index():
    rng = random.Random(3)
    for _ in range(4000):
        pattern = "".join(rng.choice("ab/*^") for _ in range(rng.randint(1, 6)))
        pattern = rng.choice(["", "|"]) + pattern + rng.choice(["", "|"])
        url = "".join(rng.choice("ab/.") for _ in range(rng.randint(0, 8)))
        rule = Rule("block", pattern, "pattern")
        found = Index([rule], {}).decide(url)[2]
        assert (found is not None) == glob(pattern, url), (pattern, url)


def test_rules_are_filed_by_their_rarest_token(spark):
    rules = [*URL_RULES, *(Rule("block", f"site{k}.example/deep/path{k}/") for k in range(2000))]
    pages = spark.createDataFrame([(f"http://site{k % 7}.example/deep/path{k % 5}/x",) for k in range(100)], "url string")
    counts = url_rules.token_counts(pages, rules)
    assert counts["deep"] == 100 and counts["site0"] == 15
    index = Index(rules, counts)
    assert max(len(v) for v in index.by_token.values()) <= 3 and len(index.candidates("http://site3.example/deep/path3/")) <= 2
    judged = url_rules.judge(pages, rules).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in judged} == {"block": sum(k % 7 == k % 5 for k in range(100)), "allow": sum(k % 7 != k % 5 for k in range(100))}
    with pytest.raises(ValueError):
        Rule("maybe", "x")


# -- whitening -----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, n string, whitened string, x string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECTORS)


def test_factors_and_rotations():
    rng = np.random.default_rng(1)
    for n, rank in [(1, 1), (2, 2), (7, 7), (12, 5), (40, 40)]:
        a = rng.normal(size=(n, rank)) * 10.0 ** rng.integers(-3, 3, rank)
        v = a @ a.T
        factor, order = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-12 * v.max()) and factor.shape[1] <= n
        values, parts = whitening.eigen(v)
        want = np.linalg.eigvalsh(v)[::-1][:rank]
        assert np.allclose(values[:rank], want, rtol=1e-9, atol=1e-13 * want[0])
        assert np.allclose(parts @ parts.T, np.eye(len(parts)), atol=1e-10)
        assert np.allclose(v @ parts.T, parts.T * values, atol=1e-11 * want[0])
    assert whitening.eigen(np.zeros((3, 3)))[1].shape == (0, 3)


def brute_whitening(rows, k):
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    d = n * x - s
    cov = ((d.T @ d) / (n**3)).astype(float)
    values, vectors = np.linalg.eigh(cov)
    return [i for i, _ in kept], (d**2).sum(1), (d / n).astype(float), values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(cov)


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_whitening_matches_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.3, 12) + 2
    rows = [(k, [float(c) for c in v * scale], k % 3) for k, v in enumerate(base)]
    rows += [(300, None, 1), (301, [None, *[1.0] * 11], 1), (302, [float("nan"), *[1.0] * 11], 1), (303, [float("inf"), *[1.0] * 11], 1), (5, rows[5][1], 2), (None, rows[6][1], None)]
    got = whitening.whiten(table(spark, rows).repartition(5), components=8).collect()
    ids, deviation, centred, values, vectors, trace = brute_whitening(rows, 8)
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {len(ids)} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    want = {}
    for i, dev, row in zip(ids, deviation, centred):
        want.setdefault(i, []).append((int(dev), np.abs(row @ vectors / np.sqrt(values))))
    for r in got:
        dev, w = want[r.vec_id][0]
        assert r.deviation == (dev if dev < 1 << 63 else None)
        assert abs(abs(r.whitened) - w[r.component - 1]) < 1e-7
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-12


def test_whitening_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(rng.normal(size=(200, 6)))]
    one, many = (sorted(whitening.whiten(table(spark, rows).repartition(n)).drop("identity_error").collect()) for n in (1, 9))
    assert one == many


def test_whitening_of_awkward_tables(spark):
    assert whitening.whiten(table(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [], 1), (4, None, None)])).count() == 0
    # Each length is a space of its own; what does not vary has no component.
    rows = [(k, [float(k), 1.0], 0) for k in range(9)] + [(100 + k, [float(k % 4), float(k % 3), 0.0], 0) for k in range(12)] + [(200, [2.0**60, 0.0], 0)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {(r.n, r.component) for r in got} == {(9, 1), (12, 1), (12, 2)} and len(got) == 9 + 24
    assert max(r.identity_error for r in got) < 1e-12


# -- hard negatives --------------------------------------------------------------------


def test_hilbert_neighbours_touch():
    for axes, bits in [(2, 4), (3, 3), (4, 2)]:
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = hn.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, a = rng.integers(-500, 500, (60, 9)), rng.integers(-500, 500, (20, 9))
    low, high = hn.bounds(a, x.min(0, keepdims=True), x.max(0, keepdims=True))
    assert (low <= a @ x.T).all() and (high >= a @ x.T).all()
    big = np.full((1, 2), 1 << 30)
    assert hn.products(big, big)[0, 0] == 1 << 61


def brute_negatives(rows, s, label_of, is_anchor):
    kept = [
        (i, label_of(i, y), [int(np.floor(256 * float(np.float32(c)))) for c in v])
        for i, v, y in rows
        if i is not None and v is not None and y is not None and all(c is not None and np.isfinite(c) for c in v)
    ]
    out = []
    for at, (i, y, x) in enumerate(kept):
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(x, z)), j, w == y) for k, (j, w, z) in enumerate(kept) if k != at]
        for score, j, _ in sorted(t for t in scored if t[2])[: s.positives]:
            fits = sorted(t for t in scored if not t[2] and s.low * -score <= 100 * -t[0] <= s.high * -score)
            out += [(i, j, rank + 1, k, -score, -n) for rank, (n, k, _) in enumerate(fits[: s.negatives])]
    return sorted(out)


@pytest.mark.parametrize("s", [hn.Settings(), hn.Settings(block=8, group=4, run=2, zones=3, parts=3, positives=3, negatives=4)])
def test_hard_negatives_match_brute_force(spark, s):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 5))
    rows = [(k, [float(c) for c in centres[k % 6] + 0.4 * rng.normal(size=5)], int(rng.integers(0, 3))) for k in range(240)]
    rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(6)]  # ties
    rows += [(70, None, 1), (80, [None, 1.0], 1), (90, [float("nan"), 1.0], 1), (600, [1.0, 2.0], None), (None, [1.0] * 5, 1), (610, [1.5, -0.5], 1), (620, [], 2)]
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    got = hn.mine(table(spark, rows).repartition(4), F.col("id") % 10 == 0, label=moved, s=s).collect()
    want = brute_negatives(rows, s, lambda i, y: (y + 1) % 3 if i % 7 == 0 else y, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got)) == want and len(want) > 100


def test_hard_negatives_of_awkward_tables(spark):
    columns = {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"}
    for rows in ([], [(0, [1.0, 2.0], 1)], [(0, [1.0], 1), (100, [1.0], 1)], [(0, None, 1)]):
        got = hn.mine(table(spark, [*rows, (7, None, None)]), F.col("id") % 100 == 0)
        assert got.count() == 0 and set(got.columns) == columns
    # A hot label, equal vectors, repeated rows, scores that are zero or negative.
    rows = [(k, [1.0, 0.0], 0) for k in range(30)] + [(0, [1.0, 0.0], 0), (40, [0.5, 0.0], 1), (41, [0.9, 9.0], 1), (42, [0.91, 0.0], 1), (100, [-1.0, 0.0], 1)]
    s = hn.Settings(block=4, group=2, run=2, zones=2, parts=2)
    got = hn.mine(table(spark, rows), F.col("id") % 100 == 0, s=s).collect()
    assert sorted(set(map(tuple, got))) == sorted(set(brute_negatives(rows, s, lambda i, y: y, lambda i: i % 100 == 0)))


def test_blocks_out_of_reach_are_not_read(spark):
    """Far clusters: the zone maps rule blocks out."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(c) for c in (10 if k % 2 else -10) * np.eye(4)[k % 4] + 0.01 * rng.normal(size=4)], k % 3) for k in range(400)]
    s = hn.Settings(block=16, group=8)
    keyed = hn.usable(table(spark, rows), "vec_id", "embedding", F.col("label")).mapInArrow(hn._keys({}, s), "id long, label long, size int, curve long, x binary")
    numbered = keyed.orderBy(F.col("id") % 4).selectExpr("cast(row_number() over (order by id % 4, id) as long) as row", "id", "label", "x")
    blocks = hn.write_blocks(numbered, s)
    anchors = numbered.where("id = 4").selectExpr("0L as g", "0L as pos", "row", "id", "label", "x", "array(1000000L) as low", "array(9223372036854775807L) as high")
    needs = hn._bounded(blocks, anchors, 1, True, s)
    assert 0 < needs.count() < blocks.count() / 3
