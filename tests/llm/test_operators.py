"""The operators against brute force, and on awkward tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardlight.llm import archives, blocks, bytebpe, packing, preference, quality_model, quality_rules, queries
from wardlight.llm import repeats, shingle_join, toxicity, vectors
from wardlight.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, toxic string, vector int, same int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeats, clashing extra columns."""
    rng = random.Random(7)
    base = words(rng, 120)
    rows = [(k, words(rng, rng.randint(40, 150)), "en", f"s{k % 2}") for k in range(60)]
    rows += [(100 + k, base.replace(base.split()[50 + k], "changed"), "de", None) for k in range(6)]
    rows += [(200, base, None, "s0"), (201, base, "en", "s0"), (201, base, "en", "s0"), (None, base, "en", "s1")]
    rows += [(300, None, "en", "s0"), (301, "", "en", "s0"), (302, " \n\t ", "en", "s0"), (303, "one two", "en", "s0"), (304, "one two", "fr", "s0")]
    rows += [(400, words(rng, 30_000), "en", "s0"), (401, "x" * 50_000, "en", "s0"), (402, "#$% " * 200, "en", "s0"), (403, "é" * 300, "en", "s0")]
    rows += [(None, None, None, None)]
    return spark.createDataFrame([(*r, None, "clash", "clash", 3, 4) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, int(k % 3 == 0)) for k in range(60)] + [(None, 1, 1), (5000, 1, 0), (6, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def empty(df):
    return df.limit(0)


def sorted_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def ids(df):
    return [r[0] for r in sorted_rows(df, "doc_id")]


# -- learned scores ---------------------------------------------------------------


@pytest.mark.parametrize("name,label", [("op1_toxicity", "toxic"), ("op5_quality", "quality")])
def test_scores_tell_held_out_labels(spark, name, label):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, folder).select("doc_id", "held_out", "score", "predicted").toPandas()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    rank, yes = held.score.rank(), held[label] == 1
    area = (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())
    assert area > 0.97 and (held.predicted == held[label]).mean() > 0.97


def test_scoring_awkward_tables(spark, awkward, labels):
    tox = toxicity.learn(awkward, labels, toxicity.Settings(epochs=2))
    out = toxicity.score(awkward, tox)
    assert ids(out) == ids(awkward) and set(out.columns) >= {"score", "threshold", "toxic", "source"}
    assert out.where("score is null or not (score between 0 and 1) or toxic is null").count() == 0
    model = quality_model.learn(awkward, labels, quality_model.Settings(epochs=2))
    scored = quality_model.score(awkward, model)
    assert ids(scored) == ids(awkward) and scored.where("score is null").count() == 0
    same = {r.score for r in scored.where("doc_id in (200, 201)").collect()}
    assert len(same) == 1
    for docs, known in ((empty(awkward), labels), (awkward, labels.limit(0)), (awkward, labels.where("doc_id = 3"))):
        model = quality_model.learn(docs, known, quality_model.Settings(epochs=1))
        assert quality_model.score(docs, model, ["doc_id"]).where("score is null").count() == 0
        tox = toxicity.learn(docs, known, toxicity.Settings(epochs=1))
        assert toxicity.score(docs, tox, ["doc_id"]).where("score is null").count() == 0


def test_scores_do_not_depend_on_partitions(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = spark.createDataFrame(docs.collect() * 2, docs.schema)
    for module, settings in ((quality_model, quality_model.Settings(epochs=3)), (toxicity, toxicity.Settings(epochs=3))):
        found = []
        for n in (1, 7):
            model = module.learn(docs.repartition(n), known, settings)
            found.append(sorted((r.doc_id, r.score) for r in module.score(docs, model, ["doc_id"]).collect()))
        assert found[0] == found[1]


def test_samples_are_bounded(spark):
    from wardlight.llm.tables import first_by_hash

    rows = spark.range(20_000).withColumn("place", F.xxhash64("id")).withColumn("size", F.lit(3))
    kept = first_by_hash(rows, "place", 5000)
    assert 4900 < kept.count() <= 5000 and kept.count() == first_by_hash(rows.repartition(9), "place", 5000).count()
    assert 2900 < first_by_hash(rows, "place", 5000, "size", 9000).count() <= 3000
    assert first_by_hash(rows, "place", 10**9).count() == 20_000 and first_by_hash(rows.limit(0), "place", 5).count() == 0


def test_convolution_matches_plain_loops():
    rng = np.random.default_rng(1)
    texts = [b"", b"one", b"one two three four", "é deux".encode(), b"a b a b a b"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    buckets, filters = 50, 2
    words_, bounds = toxicity.words_of(data, offsets, buckets)
    table = np.vstack([rng.normal(size=(buckets, len(toxicity.TAPS) * filters)), np.zeros((1, len(toxicity.TAPS) * filters))])
    bias = rng.normal(size=len(toxicity.WIDTHS) * filters)
    peaks, _ = toxicity.convolve(table, bias, words_, bounds)
    for row in range(len(texts)):
        mine = words_[bounds[row] : bounds[row + 1]]
        n = len(mine) - 2  # two padding words at the end
        for b, width in enumerate(toxicity.WIDTHS):
            for f in range(filters):
                best = -np.inf
                for at in range(max(n, 0)):
                    value = 0.0
                    for k in range(width):
                        for part in range(toxicity.PARTS):
                            value += table[mine[at + k, part], toxicity.TAPS.index((width, k)) * filters + f]
                    best = max(best, value)
                want = (best if n else 0.0) + bias[b * filters + f]
                assert peaks[row, b * filters + f] == pytest.approx(want)


def test_calibration_fits_slope_and_shift():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=4000) * 3
    truth = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * logits - 1)))).astype(float)
    slope, shift = toxicity.calibration(logits, truth)
    assert slope == pytest.approx(0.5, abs=0.06) and shift == pytest.approx(-1, abs=0.15)
    slope, shift = toxicity.calibration(np.array([-1.0, -0.5, 0.5, 1.0]), np.array([0.0, 0, 1, 1]))
    assert 0 < slope < 1000 and abs(shift) < 10 and toxicity.calibration(logits, np.ones(4000)) == (1.0, 0.0)


def test_pooled_vectors_match_plain_loops():
    rng = np.random.default_rng(2)
    texts = [b"", b"x", b"a, b a", "été #a".encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    vectors_ = rng.normal(size=(64, 3)).astype(np.float32)
    ids_, bounds = quality_model.tokens(data, offsets, 64)
    got = quality_model.pooled(data, offsets, vectors_)
    for row in range(len(texts)):
        own = [vectors_[k].astype(float) for k in ids_[bounds[row] : bounds[row + 1]]]
        n = len(own)
        want = np.zeros((3, 3))
        for i, v in enumerate(own):
            want[0] += v / n
            want[1] += v * v / n
            if i + 1 < n:
                want[2] += v * own[i + 1] / n
        assert np.allclose(got[row], want.ravel(), atol=1e-6)


def test_word_vectors_do_not_depend_on_partitions(spark, awkward):
    s = quality_model.Settings(buckets=256, dims=8)
    one = quality_model.word_vectors(awkward.coalesce(1), s)
    assert np.array_equal(one, quality_model.word_vectors(awkward.repartition(7), s)) and np.abs(one).sum() > 0


def test_convolution_gradients_match_differences():
    rng = np.random.default_rng(0)
    s = toxicity.Settings(buckets=12, dims=3, filters=2)
    params = [rng.normal(size=x) for x in ((12, 3), (len(toxicity.TAPS), 3, 2), (6,), (6,), ())]
    seqs = [np.vstack([rng.integers(0, 12, (n, 2)), np.full((2, 2), 12)]) for n in (5, 3, 0)]
    joined, y = toxicity.joined(seqs), np.array([1.0, 0, 1])

    def loss(p):
        model = toxicity.Model(toxicity.tap_table(p[0], p[1]), p[2], p[3], float(p[4]))
        q = model.scores(*joined)
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    for k, grad in enumerate(toxicity.gradients(params, *joined, y, s)):
        at = tuple(0 for _ in params[k].shape) if k != 0 else (int(seqs[0][0, 0]), 0)
        up, down = [p.copy() for p in params], [p.copy() for p in params]
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert np.asarray(grad)[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=2e-4)


# -- rules ------------------------------------------------------------------------


def test_rules_refuse_outliers_only(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, rng.randint(60, 200)), "en", "s") for k in range(300)]
    rows += [(1000 + k, " ".join(w + "$$$" for w in words(rng, 100).split()), "en", "s") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality_rules.statistics(docs, keep=["doc_id", "lang", "source"])
    judged = quality_rules.judge(stats, quality_rules.fit(stats)).toPandas().set_index("doc_id")
    assert judged.loc[:299].kept.all() and not judged.loc[1000:].kept.any() and not judged.base_failed.any()


def test_rules_on_awkward_tables(spark, awkward):
    stats = quality_rules.statistics(awkward)
    judged = quality_rules.judge(stats, quality_rules.fit(stats, quality_rules.Settings(least=5)))
    assert ids(judged) == ids(awkward)
    rows = {r.doc_id: r for r in judged.where("doc_id >= 300").collect()}
    assert rows[300].n_words == 0 and rows[300].base_failed and not rows[300].kept and rows[402].base_failed
    assert quality_rules.judge(empty(stats), quality_rules.fit(empty(stats))).count() == 0


def brute_distances(stats, s):
    """Distances of the rows of one group: the estimate in plain numpy, over single rows."""
    q = quality_rules
    rows = stats.to_dict("records")
    x = []
    for r in rows:
        w, c = max(r["n_words"], 1), max(r["word_chars"], 1)
        x.append([np.log(w), r["word_chars"] / w, np.log1p(1000 * r["n_symbols"] / c), 100 * r["n_dup_lines"] / w, r["n_repeat_words"] / w])
    x = np.floor(1000 * np.array(x) + 0.5)
    fine = np.array([not r["base_failed"] for r in rows])
    distinct, m = np.unique(x[fine], axis=0, return_counts=True)

    def distance(mean, cov, z):
        return np.array([(v - mean) @ np.linalg.inv(cov) @ (v - mean) for v in z])

    def moments(z, weight, share):
        mean = sum(w * v for w, v in zip(weight, z)) / weight.sum()
        cov = sum(w * np.outer(v - mean, v - mean) for w, v in zip(weight, z)) / weight.sum()
        return mean, q.consistency(share) * cov + s.ridge

    best, falls = None, []
    for mean, cov in q.find_starts(distinct, m, s):
        last = np.inf
        while True:
            level = np.floor(64 * np.log2(1 + distance(mean, cov, x[fine])))
            weight, left = np.zeros(fine.sum()), s.share * fine.sum()
            for k in np.unique(level):
                weight[level == k] = min(1.0, left / (level == k).sum())
                left -= weight[level == k].sum()
            new = moments(x[fine], weight, s.share)
            value = np.linalg.slogdet(new[1])[1]
            falls.append((last, value))
            if value < last:
                (mean, cov), kept = new, value
            if value >= last - s.falls:
                last = kept
                break
            last = value
        if best is None or last < best[0]:
            best = (last, mean, cov)
    near = distance(best[1], best[2], x[fine]) <= 12.832502
    return best[0], distance(*moments(x[fine][near], np.ones(near.sum()), 0.975), x), distinct, m


def test_outlier_estimate_matches_plain_loops(spark):
    rng = random.Random(11)
    rows = [(k, words(rng, rng.randint(55, 300)) + " #" * rng.choice([0, 0, 1, 3]) + "\nsame line\nsame line" * rng.choice([0, 0, 0, 2])) for k in range(150)]
    rows += [(1000 + k, " ".join(w + "$$" for w in words(rng, 80).split())) for k in range(12)] + [(3, rows[3][1]), (2000, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    s = quality_rules.Settings()
    stats = quality_rules.statistics(docs)
    judged = quality_rules.judge(stats, quality_rules.fit(stats, s)).toPandas()
    logdet, want, distinct, m = brute_distances(judged, s)
    assert np.allclose(judged.distance2, want, rtol=1e-6, atol=1e-8)
    assert (judged.kept == (~judged.base_failed & (want <= quality_rules.chi2_quantile(1 - s.tail)))).all()
    # No start of many finds a clearly smaller determinant on the group's rows.
    gen = np.random.default_rng(1)
    tried = []
    for _ in range(200):
        drawn = distinct[gen.choice(len(distinct), 6, replace=False)]
        cov = np.cov(drawn.T, bias=True) + s.ridge
        tried.append(quality_rules.concentrated(distinct, m.astype(float), drawn.mean(0), cov, s, 100)[0])
    assert logdet <= min(tried) + 0.02


def test_determinants_fall(spark):
    gen = np.random.default_rng(2)
    x = np.vstack([gen.normal(size=(300, 5)) * 1000, gen.normal(size=(60, 5)) * 300 + 9000])
    s = quality_rules.Settings()
    mean, cov = x[:6].mean(0), np.cov(x[:6].T, bias=True) + s.ridge
    seen = []
    for steps in range(1, 12):
        seen.append(quality_rules.concentrated(x, np.ones(len(x)), mean, cov, s, steps)[0])
    assert all(b <= a for a, b in zip(seen, seen[1:])) and seen[-1] < seen[0]
    start = quality_rules.find_starts(x, np.ones(len(x)), s)[0]
    assert np.abs(start[0]).max() < 500  # not drawn towards the outliers


def test_chi_squared_quantiles():
    for share, want in ((0.5, 4.351460), (0.75, 6.625680), (0.975, 12.832502), (0.999, 20.515006)):
        assert quality_rules.chi2_quantile(share) == pytest.approx(want, abs=1e-5)
    draws = (np.random.default_rng(0).normal(size=(400_000, 7)) ** 2).sum(1)
    assert quality_rules.chi2_below(6.0, 7) == pytest.approx((draws <= 6).mean(), abs=3e-3)


def test_rules_pass_on_columns_of_any_name(spark):
    rng = random.Random(5)
    names = ["c0", "p00", "x0", "k_lang", "k_source", "g_lang", "row", "start", "level", "m", "n", "logdet", "distance2", "kept", "n_words"]
    rows = [(k, words(rng, 80), "en", "s", *[f"{name}{k}" for name in names]) for k in range(60)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    stats = quality_rules.statistics(docs)
    judged = quality_rules.judge(stats, quality_rules.fit(stats))
    for r in judged.collect():
        assert all(r[name] == f"{name}{r.doc_id}" for name in names[:-3])
        assert isinstance(r.kept, bool) and isinstance(r.distance2, float) and isinstance(r.n_words, int)


# -- near duplicates ----------------------------------------------------------------


def brute_jaccard(rows):
    sets = {}
    for k, text in rows:
        w = (text or "").split()
        sets.setdefault(k, frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    links = {k: {j for j in sets if j != k and sets[k] and 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j])} for k in sets}
    return links


@pytest.mark.parametrize("block", [4, 512])
def test_jaccard_join_matches_brute_force(spark, block):
    rng = random.Random(3)
    rows = []
    for k in range(25):
        base = words(rng, rng.randint(20, 80)).split()
        for j in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = shingle_join.Settings(bucket_block=block, verify_block=block)
    got = shingle_join.near_duplicates(docs, s=s).toPandas().set_index("doc_id")
    links = brute_jaccard(rows)
    for k, found in links.items():
        assert got.loc[k].n_links == len(found)
        reach, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        assert got.loc[k].component_id == min(reach) and got.loc[k].kept == (k == min(reach))


def test_jaccard_join_on_awkward_tables(spark, awkward):
    got = shingle_join.near_duplicates(awkward)
    assert ids(got) == ids(awkward)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[201].class_id == 200 and rows[200].n_links >= 2 and not rows[201].kept
    assert rows[304].class_id == 303 and rows[304].n_links == 1 and rows[301].class_id == 300 and rows[302].n_links == 0
    assert rows[None].n_links == 0 and rows[None].kept and rows[None].class_id is None
    assert shingle_join.near_duplicates(empty(awkward)).count() == 0


def test_bayesian_bounds_grow():
    bounds = shingle_join.fewest_matches(shingle_join.Settings())
    assert (np.diff(bounds) > 0).all() and 0 < bounds[-1] < 128 * 0.8


@pytest.mark.parametrize("block", [16, 768])
def test_vectors_match_brute_force(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = np.vstack([c + rng.normal(size=(int(n), 32)) * 0.1 for c, n in zip(centres, rng.choice([1, 2, 60], 40))])
    x = np.vstack([x, x[:3], -x[:1], x[:1] * 1e200])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    extra = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [None] + [1.0] * 31), (9004, [1.0, 2.0]), (9005, []), (None, rows[0][1])]
    table = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>")
    got = vectors.near_duplicates(table, s=vectors.Settings(pivots=128, block=block)).toPandas()
    assert len(got) == len(rows) + len(extra)
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    mine = got[got.vec_id < 9000].set_index("vec_id").sort_index()
    found = mine.n_links.to_numpy()
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    others = got[got.vec_id >= 9000]
    assert (others.n_links == 0).all() and (others.vec_id == others.component_id).all()
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(500, 499), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[k] == 0 for k in range(61)) and all(got[100 + k] == 100 for k in range(40)) and got[500] == got[499] == 499
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_units_are_never_split():
    import pyarrow as pa

    rng = random.Random(1)
    unit = sorted(rng.choice(range(40)) for _ in range(500))
    batches = pa.Table.from_pydict({"unit": unit, "at": list(range(500))}).to_batches(max_chunksize=37)
    for rows in (1, 10, 64, 1000):
        tables = list(blocks.whole_units(iter(batches), rows))
        assert [x for t in tables for x in t["at"].to_pylist()] == list(range(500))
        sets = [set(t["unit"].to_pylist()) for t in tables]
        assert sum(map(len, sets)) == len(set(unit))


# -- repeats ------------------------------------------------------------------------


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return data, out


@pytest.mark.parametrize("extra", [{}, {"per_task": 2}, {"per_task": 2, "merge_bytes": 150, "shard_bytes": 100}])
def test_repeats_match_brute_force(spark, extra):
    rng = random.Random(5)
    shared = ["".join(rng.choice("abcdé ") for _ in range(40)) for _ in range(4)]
    texts = []
    for _ in range(120):
        t = "".join(rng.choice("abcdefghij é\n") for _ in range(rng.randint(0, 90)))
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(t))
            t = t[:k] + rng.choice(shared) + t[k:]
        texts.append(t)
    texts += [None, "", "x" * 100, texts[5], texts[5], "xy" * 40]
    docs = spark.createDataFrame([(k if k != 7 else None, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = repeats.remove_repeats(docs, repeats.Settings(length=24, stride=6, gram=8, **extra))
    data, gone = brute_repeats(texts, 24)
    want = []
    for k, (t, g) in enumerate(zip(data, gone)):
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        want.append((k if k != 7 else None, np.frombuffer(t, np.uint8)[~g].tobytes(), len(t), int(g.sum()), spans))
    rows = [(r[0], bytes(r[1]), *r[2:]) for r in sorted_rows(got, "doc_id", "kept_bytes", "n_bytes", "n_removed", "n_spans")]
    assert rows == sorted(want, key=repr)


@pytest.mark.parametrize("stride", [2, 3, 4, 8, 24])
def test_merged_transforms_find_repeated_windows(stride):
    rng = random.Random(stride)
    base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(24, 60))) for _ in range(12)] + [b"a" * 50, b"ab" * 30]
    texts = list(dict.fromkeys(base))
    weights = np.array([1 + (k == 3) for k in range(len(texts))])
    s = repeats.Settings(length=24, stride=stride, gram=5, shard_bytes=150)
    found, _, bounds = repeats.repeated_windows(texts, weights, s)
    counts = Counter()
    for t, w in zip(texts, weights):
        for i in range(len(t) - 23):
            counts[t[i : i + 24]] += int(w)
    for k, t in enumerate(texts):
        want = [i + 24 <= len(t) and counts[t[i : i + 24]] > 1 for i in range(len(t))]
        assert found[bounds[k] : bounds[k] + len(t)].tolist() == want


def test_repeats_of_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op2_repeats"](spark, folder).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    data, gone = brute_repeats(docs.text, 400)
    for k, t, g in zip(docs.doc_id, data, gone):
        assert got.loc[k].n_removed == g.sum() and got.loc[k].kept_sha256 == hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest()


def test_repeats_on_awkward_tables(spark, awkward):
    got = repeats.remove_repeats(awkward, whole_characters=True)
    assert ids(got) == ids(awkward)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[200].n_removed == rows[200].n_bytes and rows[401].n_removed == 50_000 and rows[300].n_bytes == 0
    assert repeats.remove_repeats(empty(awkward)).count() == 0
    with pytest.raises(ValueError):
        repeats.repeats(awkward, repeats.Settings(stride=7))


# -- tokens and packing ---------------------------------------------------------------


def test_byte_bpe_on_awkward_tables(spark, awkward):
    public = pytest.importorskip("public_tokenizers")
    ranks = bytebpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    got = bytebpe.round_trip(awkward, ranks, public.PATTERN)
    texts = {r.doc_id: r.text for r in awkward.collect() if r.doc_id}
    for r in got.where("doc_id is not null").collect():
        if r.doc_id != 0:
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert ids(got) == ids(awkward) and bytebpe.encode(empty(awkward), ranks, public.PATTERN).count() == 0


def test_packing_awkward_tables(spark, awkward):
    got = queries.packed_pieces(awkward)
    rows = got.toPandas()
    assert set(rows.doc_id.dropna()) == {k for k in ids(awkward) if k is not None}
    totals = rows.groupby("sequence_id").length.sum()
    assert ((totals & (totals - 1)) == 0).all() and totals.max() <= 4096
    assert rows[rows.doc_id == 300].length.tolist() == [1]
    assert queries.packed_pieces(empty(awkward)).count() == 0


def test_packing_tokens_with_loss_masks(spark):
    rows = [(k, np.arange(k, dtype="<u4").tobytes(), bytes([i % 2 for i in range(k)]) if k % 2 else None) for k in range(40)] + [(99, None, None)]
    got = packing.pack_tokens(spark.createDataFrame(rows, "doc_id long, ids binary, loss_mask binary"), packing.Limits(32, 3, 20)).toPandas()
    by = got.groupby("sequence_id").agg(t=("length", "sum"), n=("length", "size"), loss=("loss_tokens", "sum"))
    assert by.t.max() <= 32 and by.n.max() <= 3 and by.loss.max() <= 20 and got.length.sum() == sum(range(40))


# -- conversations ----------------------------------------------------------------------


def test_preference_prefix_and_masks(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [
        (1, [("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")]),
        (2, [("user", "a")], [("user", "a")]),
        (3, None, [("assistant", None)]),
        (4, [("user", None), ("assistant", "x")], [("user", None)]),
        (5, [("user", "p")], [("user", "q")]),
    ]
    got = {r.conv_id: r for r in preference.format_pairs(spark.createDataFrame(rows, f"conv_id long, chosen {turn}, rejected {turn}")).collect()}
    assert got[1].n_common == 1 and got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert got[1].chosen_completion == "<|im_start|>assistant\nyes<|im_end|>\n"
    kept = "".join(c for c, m in zip(got[1].rejected_completion, got[1].rejected_mask) if m == "1")
    assert kept == "no<|im_end|>" and len(got[1].rejected_mask) == len(got[1].rejected_completion)
    assert got[2].n_common == 1 and got[2].chosen_completion == got[2].rejected_completion == ""
    assert got[3].n_common == 0 and got[3].rejected_completion == "<|im_start|>assistant\n<|im_end|>\n"
    assert got[4].n_common == 1 and got[4].rejected_completion == "" and got[5].n_common == 0


def test_pairs_chain_conversations_with_one_opening(spark):
    rows = [(k, 0, "user", "same") for k in (3, 1, 2)] + [(k, 1, "assistant", f"answer {k}") for k in (1, 2, 3)]
    rows += [(9, 0, "user", None), (9, 1, "assistant", "two words"), (8, 0, "system", "s"), (None, 0, "user", "same")]
    got = preference.pairs_by_opening(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    pairs = {r.conv_id: [t.text for t in r.rejected] for r in got.collect()}
    assert pairs == {1: ["same", "1 answer"], 2: ["same", "answer 1"], 3: ["same", "answer 2"], 9: [None, "words two"], 8: ["s"]}
    assert preference.format_pairs(preference.pairs_by_opening(got.sparkSession.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# -- archives ----------------------------------------------------------------------------


def test_archives_of_awkward_pages(spark, tmp_path):
    rows = [(1, "http://a/", "x\r\n\r\ny"), (2, None, None), (5, "http://b c", ""), (7, "http://a/", "x\r\n\r\ny"), (7, "http://a/", "x\r\n\r\ny"), (None, "u", "x\r\n\r\ny"), (-3, "é", "é" * 90_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    arcs = archives.pages_to_arc(pages, file_bytes=10)
    records = archives.arc_to_records(arcs)
    assert records.count() == len(rows) and {bytes(r.content).split(b"\n")[1][:1] for r in arcs.collect()} == {b"1", b"2"}
    path = str(tmp_path / "warc")
    archives.write_warc(archives.warc_records(archives.mark_revisits(records)), path, file_bytes=900)
    sizes = [len(archives.inflate(bytes(r.content))) for r in spark.read.format("binaryFile").load(path + "/*.gz").collect()]
    assert len(sizes) > 2 and sorted(sizes)[-2] <= 1_800 and max(sizes) > 180_000
    got = archives.read_warc(spark, path)
    kinds = sorted((r.page_key is None, r.page_key, r.warc_type, r.payload_bytes) for r in got.collect() if r.page_key is not None)
    assert kinds == [(False, -3, "response", 180_000), (False, 1, "revisit", 6), (False, 2, "revisit", 0), (False, 5, "response", 0), (False, 7, "response", 6), (False, 7, "response", 6)]
    [lost] = [r for r in got.collect() if r.page_key is None]
    assert lost.warc_type == "revisit" and lost.payload is None
    by_id = {r.record_id: r for r in got.collect()}
    assert all(by_id[r.refers_to_id].payload_digest == r.payload_digest for r in by_id.values() if r.warc_type == "revisit")
    assert archives.mark_revisits(archives.arc_to_records(archives.pages_to_arc(pages.limit(0)))).count() == 0


def test_arc_errors_name_the_file():
    good = archives.arc_file(1, "n", [("u", archives.EPOCH, b"body")])
    assert [c for _, _, c in archives.parse_arc("f", good)] == [b"body"]
    for bad in (b"nonsense\n", good[:-4], good.replace(b"1 0 wardlight", b"7 0 wardlight"), good[:-6] + b"q q\nbody\n"):
        with pytest.raises(ValueError, match="^f:"):
            list(archives.parse_arc("f", bad))


# -- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).toPandas(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() <= before
    kept = docs.toPandas().set_index("doc_id")
    assert 0.5 * before < len(kept) < before and kept.index.is_unique
    labels = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id")
    assert (labels.quality.reindex(kept.index).dropna() == 1).all()
    links = brute_jaccard(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where(f"doc_id in ({','.join(map(str, kept.index))})").collect())
    assert not any(links.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert set(pieces.doc_id) == set(kept.index) and (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_pipeline_on_awkward_documents(spark, awkward, labels, tmp_path):
    folder = str(tmp_path)
    awkward.select(*corpus_pipeline.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() >= 0
    for name, stage in corpus_pipeline.STAGES:
        docs = awkward.select(*corpus_pipeline.COLUMNS).limit(0)
        assert stage(spark, docs, folder).count() == 0


def test_pipeline_returns_the_token_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.createDataFrame([(1, "one two three", "en", "s", 13), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.packed(spark, docs, "").toPandas().sort_values(["doc_id", "start"])
    found = {k: np.frombuffer(b"".join(g.ids.map(bytes)), "<u4").tolist() for k, g in rows.groupby("doc_id")}
    plain = tokenizers.Tokenizer.from_str(queries.word_tokenizer()).encode("one two three", add_special_tokens=False).ids
    assert found == {1: [*plain, queries.END_ID], 2: [queries.END_ID]}
    assert (rows.loss_tokens == rows.length).all() and (rows.ids_crc32 == rows.ids.map(zlib.crc32)).all()


def test_pipeline_keeps_one_row_of_each_group(spark):
    rng = random.Random(11)
    text, other, lone = (words(rng, 150) for _ in range(3))
    near = text.replace(text.split()[70], "changed", 1)
    rows = [(5, near), (5, near), (5, near), (7, text), (None, text), (None, text), (None, other), (None, other), (9, lone), (9, words(rng, 150))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.jaccard_join(spark, docs, "")
    assert sorted_rows(kept, "doc_id", "text") == sorted([(5, near), (None, other), *rows[-2:]], key=repr)
    cut = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(kept.collect(), docs.schema), "")
    assert sorted_rows(cut, "doc_id", "text") == sorted_rows(kept, "doc_id", "text")


def test_jaccard_join_tells_texts_of_one_id_apart(spark):
    rng = random.Random(12)
    a, b = words(rng, 150), words(rng, 150)
    near = [a.replace(a.split()[k], "changed", 1) for k in (20, 70, 120)]
    rows = [(1, a), (1, b), (1, b), (4, near[0]), (5, near[1]), (6, near[2]), (7, b.replace(b.split()[70], "changed", 1))]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    want = [(k, sum(5 * len(x & y) >= 4 * len(x | y) for y in sets) - 1) for (k, _), x in zip(rows, sets)]
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted_rows(got, "doc_id", "n_links") == sorted(want)
    assert {r.component_id for r in got.collect()} == {1}


def test_vectors_of_rare_lengths_are_indexed(spark):
    rng = np.random.default_rng(6)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(2000, 16)))]
    for size in range(3, 9):
        v = rng.normal(size=size)
        rows += [(9000 + 10 * size, v.tolist()), (9001 + 10 * size, (v + 0.001).tolist()), (9002 + 10 * size, (-v).tolist())]
    s = vectors.Settings(sample=16)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.near_duplicates(table, s=s).where("vec_id >= 9000").toPandas()
    assert (got.n_links == (got.vec_id % 10 < 2)).all() and len(got) == 18
    pivots = pivots_of(vectors.choose_pivots(vectors.usable(table, "vec_id", "embedding"), s))
    assert set(pivots) == {16, *range(3, 9)} and 0 < len(pivots[16]) <= 16


def test_pivots_of_one_length_are_its_first_vectors_by_hash(spark):
    rows = vectors.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding")
    s = vectors.Settings(sample=50, pivots=50, apart=2.0)
    first = rows.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(50).toPandas()
    assert np.allclose(pivots_of(vectors.choose_pivots(rows, s))[64], vectors.unit_rows(np.array(first.v.tolist())))


def pivots_of(table):
    return {r["size"]: np.frombuffer(r["points"]).reshape(-1, r["size"]) for r in table.collect()}


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs that are barely alike, among vectors without any structure: at least 0.97 are found."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.99, (len(x), 1))
    y = cos * x + np.sqrt(1 - cos**2) * aside
    rows = [(2 * k + side, v.tolist()) for side, part in enumerate((x, y)) for k, v in enumerate(part)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert (got.n_links <= 1).all() and (got.component_id == got.vec_id - got.n_links * (got.vec_id % 2)).all()
    assert got.n_links.mean() >= 0.97


def test_weights_of_shared_pivots():
    rng = np.random.default_rng(3)
    s = vectors.Settings()
    near = np.array([rng.permutation(12)[:7] for _ in range(40)]).astype(np.int16)
    left, right = np.array([(a, b) for a in range(40) for b in range(40)]).T
    weight, place = vectors.shared_pivots(near, left, right, s)
    for a, b, w, p in zip(left, right, weight, place):
        common = [(list(near[a]).index(v), list(near[b]).index(v)) for v in set(near[a]) & set(near[b])]
        assert w == sum(7 - max(pair) for pair in common)
        assert {(r, int(q)) for r, q in enumerate(p) if q < 1000} == set(common)


def test_windows_whose_symbols_collide_are_still_met(monkeypatch):
    """All blocks share one symbol, so intervals mix windows of different content."""
    rng = random.Random(4)
    parts = ["".join(rng.choice("ab") for _ in range(8)) for _ in range(6)]
    texts = [(parts[rng.randrange(6)] + parts[rng.randrange(6)]).encode() for _ in range(30)]
    texts = sorted(set(texts))
    real = repeats.tb.Hasher.ranges

    def weak(self, starts, ends):
        found = real(self, starts, ends)
        short = (np.asarray(ends) - np.asarray(starts)) == 4
        return np.where(short, np.uint64(7 << 32), found)

    monkeypatch.setattr(repeats.tb.Hasher, "ranges", weak)
    s = repeats.Settings(length=8, stride=4, gram=4)
    flags, _, bounds = repeats.repeated_windows(texts, np.ones(len(texts)), s)
    windows = Counter(t[i : i + 8] for t in texts for i in range(len(t) - 7))
    want = [windows[t[i : i + 8]] > 1 and i + 8 <= len(t) for t in texts for i in range(len(t) + 1)]
    assert flags.tolist() == want


def test_worker_store_holds_one_value_at_a_time():
    from wardlight.llm import textbytes as tb

    tb.release()
    first = tb.per_worker("a", dict)
    assert tb.per_worker("a", dict) is first
    tb.release("a")
    assert tb.per_worker("a", dict) is first
    tb.per_worker("b", list)
    assert tb.per_worker("a", dict) is not first
    tb.release()
    assert not tb._store()


def test_caches_are_bounded_in_bytes():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokens = packing.WordTokens(file.read(), 2, limit=20_000)
    plain = [tokens.encode(f"word{k} other{k}".encode()).tolist() for k in range(500)]
    assert len(tokens) < 120 and plain == [tokens.encode(f"word{k} other{k}".encode()).tolist() for k in range(500)]


def test_transforms_are_sorted_as_deep_as_the_merge_looks(monkeypatch):
    from wardlight.llm import textbytes as tb

    # Two long equal strings (apart from their ends) must not take rounds beyond ``length``.
    symbol = np.array([1] * 40 + [0] + [1] * 40 + [0], np.uint32)
    begins = np.repeat(np.array([0, 41], np.int32), 41)
    sorts = []
    real = repeats.stable_order

    def counted(values):
        sorts.append(len(values))
        return real(values)

    monkeypatch.setattr(repeats, "stable_order", counted)
    found = repeats.build(symbol, 0, 82, begins, 1, 4)
    assert len(sorts) == 3  # the symbols, then two doublings
    text = [tuple(symbol[p : (41 if p < 41 else 82)][:4]) for p in found.position]
    assert text == sorted(text) and sorted(found.position.tolist()) == list(range(82))
    # Keys that order windows give the rightmost smallest hash, and running windows the hashes of their ranges.
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 9, 900).astype(np.uint64) << np.uint64(60)
    for width in (1, 7, 337):
        want = [max(range(i, i + width), key=lambda j: (-int(hashes[j]), j)) for i in range(900 - width + 1)]
        assert repeats.window_minima(hashes, width).tolist() == want
    hasher = tb.Hasher(rng.integers(0, 3, 500).astype(np.uint8))
    assert (hasher.windows(64) == hasher.ranges(np.arange(437), np.arange(437) + 64)).all() and not len(hasher.windows(501))


def test_pipeline_stages_hand_small_batches_to_python(spark):
    import corpus_pipeline
    import pyarrow as pa

    from wardlight.llm import tables

    docs = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 300) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    before = spark.conf.get(tables.BATCH_SETTING, None)
    try:
        for name, stage in corpus_pipeline.STAGES[-1:]:
            spark.conf.unset(tables.BATCH_SETTING)
            assert stage(spark, docs, "").count() >= 4000, name
            seen = [r.size for r in docs.mapInArrow(sizes, "size long").collect()]
            assert sum(seen) > 13_000_000 and max(seen) <= 2 * tables.BATCH_BYTES
        spark.conf.set(tables.BATCH_SETTING, "5000000")
        tables.small_batches(spark)
        assert spark.conf.get(tables.BATCH_SETTING) == "5000000"
    finally:
        spark.conf.unset(tables.BATCH_SETTING)
        if before is not None:
            spark.conf.set(tables.BATCH_SETTING, before)


def test_toxicity_learns_from_every_labelled_row(spark):
    # More rows of either label than the sample had, dealt into several shards.
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('text ', id % 50, if(id % 2 = 0, ' vile', ' mild')) as text", "'en' as lang")
    known = docs.selectExpr("doc_id", "int(doc_id % 2 = 0) as toxic")
    model = toxicity.learn(docs, known, toxicity.Settings(epochs=1, shard=1000))
    apart = docs.selectExpr("xxhash64(doc_id, text, 'place') as place").where("pmod(shiftrightunsigned(place, 32), 5) = 0").count()
    assert model.seen == 6000 - apart and 0.7 * 6000 < model.seen < 0.9 * 6000
    # Long texts count as well: here they are the only ones of their label.
    texts = [("calm words here " * 5, 0)] * 30 + [("vile words here " * 87_000, 1)] * 8
    docs = spark.createDataFrame([(k, t, "en", y) for k, (t, y) in enumerate(texts)], "doc_id long, text string, lang string, toxic int")
    model = toxicity.learn(docs, docs.select("doc_id", "toxic"), toxicity.Settings(epochs=2))
    found = toxicity.score(docs, model, ["doc_id"]).select("doc_id", "score").toPandas()
    assert found.score[found.doc_id >= 30].min() > found.score[found.doc_id < 30].max()


def test_toxicity_shuffles_little_besides_its_rows(spark):
    # The states of all passes over a shard, spread over its rows: about a row's text (3,400 bytes in check_l).
    s = toxicity.Settings()
    state = toxicity.start(np.zeros(s.buckets, np.float32), s).vector().nbytes
    assert (s.epochs + 1) * state / s.shard < 4_000
    # Few labels are broadcast, also where Spark would shuffle the texts to meet them; beyond the bound only likely texts are shuffled.
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id % 50, if(id % 2 = 0, ' vile', ' mild')) as text", "'en' as lang")
    known = docs.where("doc_id < 600").selectExpr("doc_id", "double(doc_id % 2) as y").unionByName(spark.createDataFrame([(None, 1.0)], "doc_id long, y double"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sent, met = (toxicity._labelled(docs, known, "doc_id", toxicity.Settings(sent=n)) for n in (1 << 20, 0))
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (sent, met)]
        assert "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1] and "bitmap" not in plans[0]
        assert sorted_rows(sent, "doc_id", "text", "y") == sorted_rows(met, "doc_id", "text", "y") and sent.count() == 600
        from wardlight.llm.tables import sifted

        assert sifted(docs, "doc_id", known).where("_maybe").count() < 700
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("extra", [{}, {"per_task": 2, "merge_bytes": 30, "shard_bytes": 20}])
def test_repeated_words_match_brute_force(spark, monkeypatch, extra):
    import re
    from dataclasses import replace

    real = repeats.word_settings
    monkeypatch.setattr(repeats, "word_settings", lambda n: replace(real(n), gram=2, **extra))
    rng = random.Random(8)
    some = [words(rng, 9).split(" ") for _ in range(3)]
    texts = []
    for _ in range(100):
        t = words(rng, rng.randint(1, 30)).split(" ")
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(t))
            t = t[:k] + rng.choice(some) + t[k:]
        texts.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\n\t", " é "]).join(t))
    texts += [None, "", " \n", "z " * 30, texts[5], "é" * 90, "é" * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.remove_repeats(docs, repeats.Settings(length=48, stride=12, gram=16), whole_characters=True, passage_words=6)
    data, gone = brute_repeats(texts, 48)
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in data]
    counts = Counter(tuple(t[a:b] for a, b in own[i : i + 6]) for t, own in zip(data, spans) for i in range(len(own) - 5))
    plain = [g.copy() for g in gone]
    for t, own, g in zip(data, spans, gone):
        hit = {i + d for i in range(len(own) - 5) if counts[tuple(t[a:b] for a, b in own[i : i + 6])] > 1 for d in range(6)}
        for i in hit:  # with the white space up to the next word, if that goes, too
            g[own[i][0] : own[i + 1][0] if i + 1 in hit else own[i][1]] = True
        for k in range(len(t)):  # characters go as a whole; they have two bytes at most here
            if t[k] & 0xC0 == 0x80:
                g[k - 1] = g[k] = g[k - 1] or g[k]
    assert sum(g.sum() for g in gone) > sum(g.sum() for g in plain) > 0
    rows = {r.doc_id: (bytes(r.kept_bytes), r.n_removed) for r in got.collect()}
    want = {k: (np.frombuffer(t, np.uint8)[~g].tobytes(), int(g.sum())) for k, (t, g) in enumerate(zip(data, gone))}
    assert {k: (rows[k], want[k], texts[k]) for k in want if rows[k] != want[k]} == {}


def test_pipeline_cuts_passages_of_over_fifty_words(spark):
    rng = random.Random(13)
    long_, short = words(rng, 51), words(rng, 50)
    assert len(long_) < 400
    own = [words(rng, 80) for _ in range(8)]
    texts = [f"{own[0]}\n{long_}\n{own[1]}", f"{own[2]} {long_} {own[3]}", f"{own[4]}\n{short}\n{own[5]}", f"{own[6]}\n{short}\n{own[7]}"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert cut == {0: f"{own[0]}\n\n{own[1]}", 1: f"{own[2]}  {own[3]}", 2: texts[2], 3: texts[3]}
