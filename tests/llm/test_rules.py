import random

import numpy as np

from evograph.llm import rules


def brute(text):
    text = text or ""
    space = "\t\n\x0b\x0c\r "
    words, word = [], ""
    for c in text + " ":
        if c in space:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(space):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_statistics_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "\x1f \x85 \xa0", "a " * 9, "a " * 8, "a b " * 9, "x\n\nx\n x\nx", "# <b> é|é $$"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "é ", "#", "  "]) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for t in texts:
        assert rules.statistics(t)[:5] == brute(t), t


def brute_path(nodes, x, at=0, depth=0):
    feature, split, child, path = nodes
    if feature[at] < 0:
        return path[at]
    return brute_path(nodes, x, child[int(x[feature[at]] > split[at]), at])


def test_forest_isolates_what_is_rare():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (2000, 3)), rng.normal(9, 1, (20, 3))])
    forest = rules.Forest(x[:2000], x.min(0), x.max(0))
    s = forest.score(x)
    assert s[2000:].min() > np.quantile(s[:2000], 0.97)
    want = [2.0 ** -(np.mean([brute_path(t, v) for t in forest.trees]) / rules.HEIGHT) for v in x[::40]]
    assert np.allclose(s[::40], want)
    assert rules.Forest(np.zeros((0, 3))).score(np.zeros((2, 3))).shape == (2,)
    assert (rules.Forest(np.zeros((50, 3))).score(np.zeros((2, 3))) > 0).all()


def test_trees_hold_their_sample():
    """Leaves part the box, and a leaf's path is its depth and the mean path of what it holds."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (100, 2))
    feature, split, child, path = rules.Forest(x, trees=1, subsample=100, height=6).trees[0]

    def walk(at, held, depth):
        if feature[at] < 0:
            assert abs(path[at] - depth - rules.Forest.mean_path(len(held))) < 1e-12 and (depth == 6 or len(held) < 2)
            return len(held)
        right = held[:, feature[at]] > split[at]
        return walk(child[0, at], held[~right], depth + 1) + walk(child[1, at], held[right], depth + 1)

    assert walk(0, x, 0) == 100


def test_verdict_on_labelled_rows_that_were_not_used():
    """No tolerance is given; documents of an unusual kind are found, and few good ones go."""
    rng = np.random.default_rng(4)
    n = 6_000
    bad = rng.random(n) < 0.1
    words = rng.integers(20, 800, n)
    x = {"n_words": words, "word_chars": (words * rng.normal(5, 0.3, n)).astype(int), "n_symbols": np.where(bad, words * rng.uniform(0.4, 2, n), rng.binomial(words, 0.002)).astype(int)}
    x |= {name: rng.binomial(words, rate) for name, rate in zip(rules.NAMES[3:], (0.001, 0.001, 0.08, 0.02, 0.003, 0.01), strict=True)}
    part = rng.integers(0, 3, n)
    forest, limit = rules.calibrated(x, 1 - bad.astype(int), part, x)
    out = (forest.score(rules.features(x)) > limit) & (part == 2)
    assert out[bad & (part == 2)].sum() > 0.95 * (bad & (part == 2)).sum()
    assert out[~bad].sum() < 0.015 * (~bad & (part == 2)).sum()


def test_threshold_spares_good_rows():
    good, bad = np.linspace(0, 0.4, 1000), np.linspace(0.5, 0.9, 50)
    t = rules.threshold(good, bad)
    assert (good > t).mean() <= rules.MOST_LOST and (bad > t).all()
    assert rules.threshold(good, bad[:0]) == np.inf


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, marks = [], []
    for i in range(800):
        bad = i % 8 == 0
        words = [word() + ("%%%" if bad else "") for _ in range(rng.randint(25, 120))]
        rows.append((i, " ".join(words), "x"))
        marks.append((i, 0 if bad else 1))
    return rows, marks


def test_verdicts(spark):
    rows, marks = corpus()
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "too short", "x"), (None, rows[1][1], "x"), (1003, "a b c d e f g h i j " * 9, "x"), (1, rows[1][1], "x"), (1004, "fine words here " + rows[2][1] * 300, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anomaly string")
    labels = spark.createDataFrame(marks + [(None, 1), (3, None)], "doc_id long, quality int")
    got = rules.judged(docs, labels).collect()
    assert len(got) == len(rows)
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id < 800 and r.kept != (r.doc_id % 8 != 0)]
    assert len(wrong) <= 8 and not [i for i in wrong if i % 8 == 0], wrong
    byid = {r.doc_id: r for r in got}
    assert not byid[1000].kept and not byid[1002].kept and byid[1003].base_failed and byid[None].kept
    assert rules.judged(docs, labels.limit(0)).where("kept").count() > 700
    assert rules.judged(docs.limit(0), labels).count() == 0


def test_spread_threshold_equals_the_one_in_memory(spark, monkeypatch):
    rng = np.random.default_rng(6)
    for bins, n in ((4, 700), (64, 5_000), (4_096, 300)):
        monkeypatch.setattr(rules, "BINS", bins)
        good, bad = np.round(rng.random(n), 3) ** 6, np.round(0.3 + 0.7 * rng.random(n // 9), 3)
        rows = spark.createDataFrame([(float(v), 1) for v in good] + [(float(v), 0) for v in bad], "anomaly double, quality int")
        for lost in (0.004, 0.2):
            assert rules.spread_threshold(rows, lost) == rules.threshold(good, bad, lost)
    assert rules.spread_threshold(rows.where("quality = 1")) == np.inf == rules.spread_threshold(rows.limit(0))


def test_every_labelled_row_sets_the_limit(spark, monkeypatch):
    """The limit is that of all labelled rows of its part, and the trees' box that of all rows, however few are sampled."""
    monkeypatch.setattr(rules, "LABELLED", 30, raising=False)
    monkeypatch.setattr(rules, "SUBSAMPLE", 4)
    made = []
    forest = rules.Forest
    monkeypatch.setattr(rules, "Forest", lambda x, low=None, high=None, **k: made.append((low, high)) or forest(x, low, high, **k))
    rows, marks = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rules.judged(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    parts = {r[0]: r[1] for r in docs.selectExpr("doc_id", f"pmod(xxhash64({rules.SEED + 1}, doc_id), 3)").collect()}
    got = [r for r in got.collect() if not r.base_failed]
    good, bad = (np.array([r.anomaly for r in got if parts[r.doc_id] == 1 and dict(marks)[r.doc_id] == q]) for q in (1, 0))
    limit = rules.threshold(good, bad)
    assert all(r.kept == (r.anomaly <= limit) for r in got)
    x = rules.features({n: np.array([r[n] for r in got]) for n in rules.NAMES})
    assert (made[0][0] == x.min(0)).all() and (made[0][1] == x.max(0)).all()
