"""Quality rules: an isolation forest on rule statistics.

Each document's rule statistics are counted over its whole text and taken as rates, without tolerances.  Trees of random
splits are grown on samples of documents labelled good.  A split falls anywhere in the part of the feature space that a node covers, not
only between the sample's values, so regions without good documents are cut off after few splits; the mean path length gives
the anomaly score, and labelled rows that no tree has seen set the score above which documents go.  Only the trees' own samples are bounded: the
part of the space comes from all documents that pass the base rules, the limit from all labelled ones of its part.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
SPACE = bytes([9, 10, 11, 12, 13, 32])
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
WINDOW = 8
#: Trees, documents a tree is grown on, and levels; the driver reads about as many documents as all trees together draw.
TREES, SUBSAMPLE, HEIGHT = 64, 256, 16
#: Parts of the labelled rows by a hash of the id: one grows the trees, one sets the threshold, and one is left for measuring what the verdict costs.
PARTS = 3
#: Bins in which an order statistic is sought.
BINS = 4_096
#: Share of the calibration's good documents that may go.
MOST_LOST = 0.004
SEED = 20240229

_mix = np.random.default_rng(SEED).integers(1, 1 << 63, 1 << 12, np.uint64) | np.uint64(1)


def repeat_words(words: list) -> int:
    """Words inside windows of eight that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) > len(words) - WINDOW:
        return 0  # two equal windows need eight words that are not new
    u = ids.astype(np.uint64)
    u = (u * np.uint64(0x9E3779B97F4A7C15)) ^ (u >> np.uint64(7)) ^ _mix[ids & 4095]
    with np.errstate(over="ignore"):
        h = sum((u[j : j + n] * _mix[j] for j in range(WINDOW)), np.zeros(n, np.uint64))
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return 0
    hit = np.zeros(n, bool)
    first, second = order[same], order[same + 1]
    if all((ids[first + j] == ids[second + j]).all() for j in range(WINDOW)):
        hit[first] = hit[second] = True
    else:  # equal hashes of different windows: compare the windows
        seen: dict = {}
        for i in range(n):
            k = tuple(ids[i : i + WINDOW].tolist())
            if k in seen:
                hit[[i, seen[k]]] = True
            else:
                seen[k] = i
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_digits, n_marks, n_stutter): the last counts words equal to the one before."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), len(text) - less(SPACE), less(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), less(UPPER), less(DIGITS), less(b"!?;:=_~^{}[]\\/"), sum(map(eq, words, words[1:]))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_stutter")


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics, base_failed) of every row.  Null texts count as empty; bytes.isspace and bytes.split know ASCII white space only, as words do."""

    def make():
        def step(x):
            columns = list(zip(*map(statistics, x["t"]), strict=True))
            return {"doc_id": x["i"]} | dict(zip(NAMES, columns, strict=True))

        return step

    got = common.arrow_pass(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES))
    return got.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """Logarithms of word length, and of the rates of symbols, marks, repeats, stutters and duplicate lines by word, of capitals and digits by character."""
    words = np.maximum(x["n_words"], 1).astype(float)
    chars = np.maximum(x["word_chars"], 1).astype(float)
    rates = [x[n] / (chars if n in ("n_upper", "n_digits") else words) for n in NAMES[2:]]
    return np.log1p(20 * np.column_stack([chars / words, *rates]))


class Forest:
    """Isolation trees over the box ``low`` to ``high`` (of ``x`` unless given), as arrays of nodes."""

    def __init__(self, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, trees: int = TREES, subsample: int = SUBSAMPLE, height: int = HEIGHT, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.height = height
        self.trees = []
        for _ in range(trees):
            nodes: list[list] = []  # feature (-1: leaf), split, left, right, path
            if len(x):
                of = x[rng.choice(len(x), min(subsample, len(x)), replace=False)]
                self._grow(nodes, of, np.array(x.min(0) if low is None else low, float), np.array(x.max(0) if high is None else high, float), 0, rng)
            else:
                nodes.append([-1, 0.0, 0, 0, 0.0])
            feature, split, left, right, path = zip(*nodes, strict=True)
            self.trees.append((np.array(feature, np.int16), np.array(split), np.array([left, right], np.int32), np.array(path)))

    @staticmethod
    def mean_path(n: int) -> float:
        """Mean path length of an unsuccessful search among n."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, nodes: list, x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, depth + self.mean_path(len(x))])
        wide = np.flatnonzero(high > low)
        if depth < self.height and len(x) > 1 and len(wide):
            f = int(rng.choice(wide))
            split = rng.uniform(low[f], high[f])
            inside, up, down = x[:, f] <= split, high.copy(), low.copy()
            up[f] = down[f] = split
            left = self._grow(nodes, x[inside], low, up, depth + 1, rng)
            nodes[at] = [f, split, left, self._grow(nodes, x[~inside], down, high, depth + 1, rng), 0.0]
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / height): towards 1 for what few splits isolate."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, child, path in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.height):
                f = feature[node]
                node = np.where(f >= 0, child[(x[rows, f] > split[node]).astype(np.int8), node], node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / self.height)


def threshold(good: np.ndarray, bad: np.ndarray, most_lost: float = MOST_LOST) -> float:
    """The score above which the most bad rows go, among those at which at most ``most_lost`` of the good ones do; the middle of the gap it lies in."""
    if not len(good) or not len(bad):
        return np.inf
    floor = np.sort(good)[::-1][int(len(good) * most_lost)]
    above = np.sort(np.concatenate([good, bad]))
    nxt = above[above > floor]
    return float((floor + nxt[0]) / 2) if len(nxt) else float(floor)


def _bounded(df: DataFrame, most: int, total: int) -> DataFrame:
    """About ``most`` rows, chosen by a hash of the id; all of them where there are fewer."""
    share = min(1.0, most / max(total, 1))
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def largest(values: DataFrame, k: int) -> float:
    """The ``k``-th largest (from 0) of the column ``anomaly``; the driver sees counts of at most ``BINS`` + 1 ranges at a time."""
    value = F.col("anomaly")
    low, high = values.agg(F.min(value), F.max(value)).first()
    while low < high:
        # Rounding keeps the order, so a bin holds all values between its least and its greatest.
        place = F.floor((value - low) / (high - low) * BINS)
        bins = values.where(value.between(low, high)).groupBy(place.alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min(value).alias("_l"), F.max(value).alias("_h"))
        for _, count, low, high in sorted(bins.collect(), reverse=True):  # noqa: B007
            if k < count:
                break
            k -= count
    return low


def spread_threshold(scores: DataFrame, most_lost: float = MOST_LOST) -> float:
    """:func:`threshold` of all rows of ``scores`` (anomaly, quality), none of which the driver holds."""
    good, bad = scores.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
    if not good or not bad:
        return np.inf
    floor = largest(scores.where("quality = 1"), int(good * most_lost))
    nxt = scores.where((F.col("anomaly") > floor) & F.col("quality").isin(0, 1)).agg(F.min("anomaly")).first()[0]
    return floor if nxt is None else (floor + nxt) / 2


def box(passing: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and greatest features of all rows of ``passing``; None where there are none."""

    def ends(batches):
        for batch in batches:
            if batch.num_rows:
                x = features({n: batch.column(n).to_numpy() for n in NAMES})
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*x.min(0).tolist(), *x.max(0).tolist())], names=names)

    wide = len(NAMES) - 1
    names = [f"{side}{k}" for side in ("low", "high") for k in range(wide)]
    found = passing.select(*NAMES).mapInArrow(ends, ", ".join(f"{n} double" for n in names))
    row = found.agg(*(F.min(n) for n in names[:wide]), *(F.max(n) for n in names[wide:])).first()
    return None if row[0] is None else (np.array(row[:wide]), np.array(row[wide:]))


def calibrated(known: dict[str, np.ndarray], quality: np.ndarray, part: np.ndarray, passing: dict[str, np.ndarray]) -> tuple[Forest, float]:
    """A forest and its threshold from labelled rows in memory: ``part`` 0 grows trees of the good ones, part 1 sets the threshold.

    ``passing`` are rows that set the box, and of which trees are grown where no row of part 0 is good.
    """
    x, everything = features(known), features(passing)
    good = x[(part == 0) & (quality == 1)]
    both = np.vstack([x, everything])
    forest = Forest(good if len(good) else everything, *((both.min(0), both.max(0)) if len(both) else ()))
    scores, at = forest.score(x), part == 1
    return forest, threshold(scores[at & (quality == 1)], scores[at & (quality == 0)])


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, ``anomaly`` and ``kept`` of every row of ``docs``; ``labels`` is (doc_id, quality).

    ``kept`` is false where the base rules fail or the anomaly score exceeds the calibrated threshold; without labels of both
    kinds there is no threshold and the base rules decide.  Null and empty texts fail them.  Repeated rows are judged alike,
    null ids stay null, other columns are not looked at, and an empty table gives no rows.
    """
    stats = common.materialize(rule_statistics(docs, id_col, text_col), "rule_statistics")
    passed = stats.where(~F.col("base_failed"))
    marked = labels.select(F.col("doc_id").cast("long"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = common.materialize(marked.withColumn("part", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(PARTS))), "marked")
    good = passed.join(marked.where("part = 0 and quality = 1"), "doc_id")
    grown = good if (total := good.count()) else passed
    # What the trees draw their samples from: so many rows as all of them draw.
    drawn = _bounded(grown, TREES * SUBSAMPLE, total or passed.count()).select(*NAMES).orderBy(*NAMES).toPandas()
    forest = Forest(features({n: drawn[n].to_numpy() for n in NAMES}), *(box(passed) or ()))

    def scored(batches):
        for batch in batches:
            anomaly = forest.score(features({n: batch.column(n).to_numpy() for n in NAMES}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly)], names=[*batch.schema.names, "anomaly"])

    got = stats.mapInArrow(scored, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + ", base_failed boolean, anomaly double")
    got = common.materialize(got, "rule_scores")
    common.release(stats)
    tested = common.materialize(got.where(~F.col("base_failed")).join(marked.where("part = 1"), "doc_id").select("anomaly", "quality"), "calibration")
    limit = spread_threshold(tested)
    common.release(marked, tested)
    return got.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(float(limit))))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the verdict on every document."""
    return judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
