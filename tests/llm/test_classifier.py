import random
import zlib

import numpy as np

from evograph.llm import classifier


def corpus(n=500):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, marks = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = [word() for _ in range(rng.randint(10, 150))]
        text = " ".join(w + "%%%" for w in words) if bad and i % 2 else " ".join(w for w in words[:12] for _ in range(6)) if bad else " ".join(words)
        rows.append((i, text))
        marks.append((i, 0 if bad else 1))
    return rows, marks


def test_chunks_cover_whole_texts():
    rng = np.random.default_rng(1)
    texts = [None, "", "a", "b" * 256, "c" * 257, *("".join(map(chr, rng.integers(32, 300, n))) for n in (30, 224, 480, 481, 5000))]
    chunks, flags, counts = classifier.chunked(texts)
    at = 0
    for t, n in zip(texts, counts):
        raw = (t or "").encode()
        for k in range(n):
            part = raw[k * classifier.STEP : k * classifier.STEP + classifier.CHUNK]
            assert chunks[at + k].tobytes() == part.ljust(classifier.CHUNK, b"\0")
        assert (n - 1) * classifier.STEP + classifier.CHUNK >= len(raw)
        at += n
    alone = classifier.chunked(texts[-1:])
    assert (alone[1] == flags[-counts[-1] :]).all()


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    net = classifier.Network(3)
    chunks = rng.integers(1, 256, (9, classifier.CHUNK)).astype(np.uint8)
    flags = rng.random((9, classifier.CHUNK)) < 0.1
    counts, y = np.array([2, 3, 4]), np.array([1.0, 0.0, 1.0])
    g, _ = net.gradients(chunks, flags, counts, y)
    for name in ("now", "next", "bias", "out", "shift", "embed"):
        spots = np.argsort(-np.abs(g[name]).ravel())[:5]
        for s in spots:
            k = np.unravel_index(s, g[name].shape)
            old = net.p[name][k]
            losses = []
            for step in (1e-3, -1e-3):
                net.p[name][k] = old + step
                losses.append(net.gradients(chunks, flags, counts, y)[1])
            net.p[name][k] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - g[name][k]) < 0.02 * abs(g[name][k]) + 2e-3, (name, k)


def test_held_out_accuracy(spark):
    rows, marks = corpus()
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows] + [(None, None, 0.5, "x"), (900, "", 0.5, "x"), (1, rows[1][1], 0.5, "x"), (901, rows[1][1] + " " + "word " * 30000, 0.5, "x")], "doc_id long, text string, score double, lang string")
    labels = spark.createDataFrame(marks + [(None, 1), (7, None)], "doc_id long, quality int")
    net = classifier.train(docs, labels)
    got = classifier.scored(docs, net).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= classifier.CUT) == (dict(marks)[r.doc_id] == 1) for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(right) > 60 and np.mean(right) > 0.95
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    kept = classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert classifier.keep_good(docs.limit(0), labels).count() == 0
    assert classifier.keep_good(docs, labels.limit(0)).count() == len(got)
