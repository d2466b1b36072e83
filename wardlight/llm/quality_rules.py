"""Quality rules: counting rules, then robust multivariate outliers.

Base rules refuse short texts and texts that repeat themselves.  For the rest
a vector of transformed statistics is compared with a minimum-covariance-
determinant estimate of its own (language, source) group: documents whose
squared Mahalanobis distance exceeds the quantile ``1 - tail`` of the
chi-squared distribution are refused.

The estimate of a group is the mean and covariance of the ``share`` of its rows
that give the smallest determinant.  Equal vectors are one row with a
multiplicity.

1. *Starts.*  A bounded sample of the group's distinct vectors gives a first
   start: covariances of many draws of six rows, each concentrated on the sample
   until its determinant no longer falls; the best one counts.  Medians and
   quartile distances of the sample give a second start.
2. *Concentration* covers every row of the group.  A step puts rows in classes of
   their distance (about one per cent wide); Spark adds up count, sums and
   products for each class, and the classes nearest the centre that hold ``share``
   of the rows, the last of them in part, give the next mean and covariance.  A
   start goes on while its determinant falls; the smallest determinant is kept.
   A group of any size is thus a few hundred partial sums, added map-side, and no
   task holds a group's rows.
3. *Reweighting.*  Rows within the usual 97.5 per cent bound give the final
   estimate.

Both covariances are scaled to be right for normal data, and ``floors`` squared is
added to their diagonals before the determinant is taken: without it the
determinant of a group that mostly agrees in one statistic is zero, and every other
row an outlier.  Statistics are whole thousandths, so sums are exact in any order.

Groups with fewer than ``least`` usable rows take their language's estimate,
languages with fewer take the common one, and if that has fewer too nothing is
refused by distance.  Null language or source are values like any other.  Null
and empty texts have no words and fail the base rules; very long texts are read
whole.  Repeated rows count as often as they occur and get the same verdict; ties
in distance share a class.  An empty table gives an empty result.  Input columns
may have any names: those of new columns give way, all others are passed on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm import textbytes as tb
from wardlight.llm.tables import written

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 3


def count_statistics(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """The five counts of every row of a slice."""
    word_byte = ~tb.IS_SPACE[data]
    starts, ends = tb.runs(word_byte, offsets)
    bounds = tb.per_row(starts, offsets)
    hasher = tb.Hasher(data)
    code_point = word_byte & ((data & 0xC0) != 0x80)
    return [
        pa.array(np.asarray(x, np.int64))
        for x in (
            np.diff(bounds),
            _row_sums(code_point, offsets),
            _row_sums(SYMBOL[data], offsets),
            _duplicate_lines(data, offsets, word_byte, hasher),
            _repeated_words(hasher.ranges(starts, ends), bounds),
        )
    ]


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _duplicate_lines(data, offsets, word_byte, hasher) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    starts.sort()
    ends.sort()
    rows = np.repeat(np.arange(len(offsets) - 1), np.bincount(row, minlength=len(offsets) - 1) + 1)
    words = np.concatenate([[0], np.cumsum(word_byte, dtype=np.int64)])
    real = words[ends] > words[starts]
    key = hasher.ranges(starts[real], ends[real]) ^ tb.mix(rows[real].astype(np.uint64) + np.uint64(1))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), np.int64)
    again[first] = 0
    return np.bincount(rows[real], again, len(offsets) - 1)


def _repeated_words(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words inside windows of three words that occur twice or more in their row."""
    row = tb.row_of(bounds)
    covered = np.zeros(len(words), bool)
    if len(words) >= WINDOW:
        whole = np.flatnonzero(row[WINDOW - 1 :] == row[: 1 - WINDOW])
        key = row[whole].astype(np.uint64)
        for k in range(WINDOW):
            key = tb.mix(key * tb.BASE + words[whole + k])
        _, group, counts = np.unique(key, return_inverse=True, return_counts=True)
        again = whole[counts[group] > 1]
        for k in range(WINDOW):
            covered[again + k] = True
    return np.bincount(row[covered], minlength=len(bounds) - 1)


@dataclass(frozen=True)
class Settings:
    min_words: int = 50
    max_repeated: int = 50  # per cent of the words
    share: float = 0.75  # of a group that must lie within the estimate
    steps: int = 12  # concentration steps at most
    falls: float = 1e-3  # by less than this the logarithm of a determinant no longer falls
    least: int = 50  # usable rows that a group needs for an estimate of its own
    sample: int = 512  # distinct vectors of a group, about, that starts are sought in
    draws: int = 40
    tail: float = 1e-9  # share of normal rows beyond the cut-off
    #: Spread of each statistic below which differences do not matter.
    floors: tuple = (0.8, 0.35, 0.4, 0.5, 0.12)

    @property
    def ridge(self) -> np.ndarray:
        return np.diag(np.square(1000 * np.array(self.floors)))


P = 5
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
X = [f"x{i}" for i in range(P)]
#: Distance classes in an octave, and in all.
OCTAVE, CLASSES = 64, 2048
NONE = "\x00"
ESTIMATE = ", ".join([f"c{i} double" for i in range(P)] + [f"p{i}{j} double" for i, j in PAIRS] + ["logdet double"])
MODEL = f"g_lang string, g_source string, start int, {ESTIMATE}"
NAMES = [c.split()[0] for c in MODEL.split(", ")]


def chi2_below(x: float, freedom: int) -> float:
    """Distribution function of chi-squared with an odd number of degrees of freedom."""
    term, total = math.sqrt(x), 0.0
    for k in range(1, freedom, 2):
        total += term
        term *= x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 / math.pi) * math.exp(-x / 2) * total


def chi2_quantile(share: float, freedom: int = P) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, freedom) < share else (low, middle)
    return high


def consistency(share: float) -> float:
    """What a covariance of the nearest ``share`` of normal rows must be multiplied by."""
    return share / chi2_below(chi2_quantile(share), P + 2) if share < 1 else 1.0


def estimate(n: float, sums: np.ndarray, products: np.ndarray, s: Settings, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and regularised covariance from weighted sums."""
    mean = sums / n
    return mean, consistency(share) * (products / n - np.outer(mean, mean)) + s.ridge


def values(mean: np.ndarray, cov: np.ndarray) -> tuple:
    precision = np.linalg.inv(cov)
    return (*mean.tolist(), *(float(precision[i, j]) for i, j in PAIRS), float(np.linalg.slogdet(cov)[1]))


def statistics(docs: DataFrame, s: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the five counts and ``base_failed``."""
    counted = tb.with_columns(docs, "text", count_statistics, COUNTS, keep)
    short = F.col("n_words") < s.min_words
    return counted.withColumn("base_failed", short | (100 * F.col("n_repeat_words") > s.max_repeated * F.col("n_words")))


def _vector() -> list:
    """Transformed statistics in whole thousandths."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    found = (
        F.log(words),
        F.col("word_chars") / words,
        F.log1p(1000 * F.col("n_symbols") / chars),
        100 * F.col("n_dup_lines") / words,
        F.col("n_repeat_words") / words,
    )
    return [F.round(1000 * x).alias(name) for name, x in zip(X, found)]


def _keyed(df: DataFrame) -> DataFrame:
    """(row, base_failed, k_lang, k_source, x0..): the caller's columns in one, null as a value of its own."""
    keys = [
        (F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in df.columns else F.lit(NONE)).alias(f"k_{c}") for c in ("lang", "source")
    ]
    return df.select(F.struct(*df.columns).alias("row"), "base_failed", *keys, *_vector())


def _distance():
    """Squared Mahalanobis distance of x0.. from the joined centre."""
    total = F.lit(0.0)
    for i, j in PAIRS:
        term = F.col(f"p{i}{j}") * (F.col(f"x{i}") - F.col(f"c{i}")) * (F.col(f"x{j}") - F.col(f"c{j}"))
        total = total + (term if i == j else 2 * term)
    return F.greatest(total, F.lit(0.0))


def _groups(rows: DataFrame, s: Settings) -> DataFrame:
    """(k_lang, k_source) -> the group whose estimate it takes; null for none."""
    pairs = rows.groupBy("k_lang", "k_source").agg(F.sum("m").alias("n"))
    small = pairs.where(F.col("n") < s.least)
    langs = small.groupBy("k_lang").agg(F.sum("n").alias("m"))
    rest = langs.where(F.col("m") < s.least).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("r"))
    own, of_lang, of_all = F.col("n") >= s.least, F.col("m") >= s.least, F.col("r") >= s.least
    return (
        pairs.join(langs, "k_lang", "left")
        .join(F.broadcast(rest))  # one row
        .select(
            "k_lang",
            "k_source",
            F.when(own | of_lang, F.col("k_lang")).when(of_all, F.lit("*")).alias("g_lang"),
            F.when(own, F.col("k_source")).when(of_lang | of_all, F.lit("*")).alias("g_source"),
        )
    )


# -- starts -------------------------------------------------------------------------


def nearest_sums(x: np.ndarray, m: np.ndarray, distance: np.ndarray, share: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted sums of the nearest ``share`` of rows with multiplicities, the last row in part."""
    order = np.argsort(distance, kind="stable")
    wanted = share * m.sum()
    weight = np.zeros(len(m))
    before = np.concatenate([[0], np.cumsum(m[order])[:-1]])
    weight[order] = np.clip(wanted - before, 0, m[order])
    return wanted, weight @ x, (x * weight[:, None]).T @ x


def concentrated(x: np.ndarray, m: np.ndarray, mean: np.ndarray, cov: np.ndarray, s: Settings, steps: int) -> tuple:
    """(log determinant, mean, covariance) after steps on rows held in memory, while it falls."""
    best = (np.inf, mean, cov)
    for _ in range(steps):
        d = x - mean
        mean, cov = estimate(*nearest_sums(x, m, np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d), s.share), s, s.share)
        value = float(np.linalg.slogdet(cov)[1])
        if value >= best[0] - 1e-12:
            break
        best = (value, mean, cov)
    return best


def find_starts(x: np.ndarray, m: np.ndarray, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two (mean, covariance) to concentrate from."""
    order = np.lexsort(x.T)
    x, m = x[order], m[order].astype(float)
    rng = np.random.default_rng(17)
    tried = []
    for _ in range(s.draws):
        drawn = x[rng.choice(len(x), min(P + 1, len(x)), replace=False)]
        start = drawn.mean(0), (drawn - drawn.mean(0)).T @ (drawn - drawn.mean(0)) / len(drawn) + s.ridge
        tried.append(concentrated(x, m, *start, s, 2))
    tried.sort(key=lambda t: t[0])
    best = min((concentrated(x, m, mean, cov, s, 50) for _, mean, cov in tried[:5]), key=lambda t: t[0])
    quartiles = []
    for column in x.T:
        rank = np.argsort(column, kind="stable")
        upto = np.cumsum(m[rank])
        quartiles.append(column[rank][np.searchsorted(upto, np.array([0.25, 0.5, 0.75]) * upto[-1]).clip(0, len(x) - 1)])
    low, middle, high = np.array(quartiles).T
    return [best[1:], (middle, np.diag(np.square((high - low) / 1.349)) + s.ridge)]


# -- the estimates of all groups ------------------------------------------------------


def fit(stats: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Estimates by (k_lang, k_source): centre c0.., precision p00..

    ``stats`` is the result of :func:`statistics`.
    """
    usable = _keyed(stats).where(~F.col("base_failed")).groupBy("k_lang", "k_source", *X).agg(F.count("*").alias("m"))
    rows = written(usable, "quality-statistics")
    groups = written(_groups(rows, s).where("g_lang is not null"), "quality-groups")
    keyed = rows.join(groups, ["k_lang", "k_source"]).groupBy("g_lang", "g_source", *X).agg(F.sum("m").alias("m"))
    keyed = written(keyed, "quality-vectors")
    model = written(_starts(keyed, s), "quality-starts")
    for _ in range(s.steps):
        parts = keyed.join(model.where("not done"), ["g_lang", "g_source"])
        level = F.least((OCTAVE * F.log2(1 + _distance())).cast("int"), F.lit(CLASSES - 1)).alias("level")
        # The estimate so far goes along, to be kept where the next one is no better.
        so_far = [F.first(c).alias(c) for c in NAMES[3:]]
        # Written, so that the sums are dealt out by class and only then met by group.
        parts = written(parts.groupBy("g_lang", "g_source", "start", level).agg(*_sums(), *so_far), "quality-classes")
        new = parts.groupBy("g_lang", "g_source", "start").applyInPandas(_concentrate(s), f"{MODEL}, done boolean")
        model = written(model.where("done").unionByName(new), "quality-model")
        if model.where("not done").isEmpty():
            break
    best = model.groupBy("g_lang", "g_source").agg(F.min_by(F.struct(*NAMES[3:]), F.struct("logdet", "start")).alias("best")).select("g_lang", "g_source", "best.*")
    near = keyed.join(best, ["g_lang", "g_source"]).where(_distance() <= chi2_quantile(0.975))
    parts = written(near.groupBy("g_lang", "g_source", F.pmod(F.xxhash64(*X), F.lit(64)).alias("level")).agg(*_sums()), "quality-near")
    final = parts.withColumn("start", F.lit(0)).groupBy("g_lang", "g_source", "start").applyInPandas(_concentrate(s, reweight=True), f"{MODEL}, done boolean")
    return written(groups.join(final, ["g_lang", "g_source"]).drop("g_lang", "g_source", "start", "logdet", "done"), "quality-model")


def _starts(keyed: DataFrame, s: Settings) -> DataFrame:
    """Two starts for each group, from a sample of its distinct vectors by hash."""
    sizes = keyed.groupBy("g_lang", "g_source").agg(F.count("*").alias("size"), F.min(F.xxhash64(*X)).alias("least"))
    hash_ = F.xxhash64(*X)
    drawn = keyed.join(sizes, ["g_lang", "g_source"]).where((hash_.cast("double") / 2.0**64 + 0.5 <= s.sample / F.col("size")) | (hash_ == F.col("least")))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        found = find_starts(group[X].to_numpy(float), group["m"].to_numpy(), s)
        out = [(group.g_lang.iloc[0], group.g_source.iloc[0], k, *values(mean, cov)[:-1], np.inf) for k, (mean, cov) in enumerate(found)]
        return pd.DataFrame(out, columns=NAMES)

    return drawn.groupBy("g_lang", "g_source").applyInPandas(work, MODEL).withColumn("done", F.lit(False))


def _sums() -> list:
    m = F.col("m")
    return [
        F.sum(m).cast("double").alias("n"),
        *[F.sum(m * F.col(f"x{i}")).alias(f"s{i}") for i in range(P)],
        *[F.sum(m * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS],
    ]


def _concentrate(s: Settings, reweight: bool = False):
    """Next estimate of one group and start from the sums of its distance classes.

    A group has at most ``CLASSES`` rows here, whatever its size.  With
    ``reweight`` all rows count: they are those within the 97.5 per cent bound.
    """

    def work(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("level")
        n = parts["n"].to_numpy()
        weight = np.ones(len(n))
        if not reweight:
            before = np.cumsum(n) - n
            weight = np.clip((s.share * n.sum() - before) / n, 0, 1)
        sums = weight @ parts[[f"s{i}" for i in range(P)]].to_numpy()
        products = np.zeros((P, P))
        for i, j in PAIRS:
            products[i, j] = products[j, i] = weight @ parts[f"s{i}{j}"].to_numpy()
        mean, cov = estimate(float(weight @ n), sums, products, s, 0.975 if reweight else s.share)
        first = parts.iloc[0]
        found = values(mean, cov)
        done = not reweight and not found[-1] < first["logdet"] - s.falls
        if done and found[-1] >= first["logdet"]:
            found = tuple(float(first[c]) for c in NAMES[3:])
        return pd.DataFrame([(first.g_lang, first.g_source, int(first.start), *found, done)], columns=[*NAMES, "done"])

    return work


def judge(stats: DataFrame, model: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``stats`` with ``distance2`` (null: no estimate) and ``kept``."""
    names = [c for c in stats.columns if c not in ("distance2", "kept")]
    joined = _keyed(stats.select(*names)).join(model, ["k_lang", "k_source"], "left").withColumn("distance2", _distance())
    far = F.coalesce(F.col("distance2") > chi2_quantile(1 - s.tail), F.lit(False))
    return joined.select("row.*", F.when(F.col("c0").isNotNull(), F.col("distance2")).alias("distance2"), (~F.col("base_failed") & ~far).alias("kept"))
