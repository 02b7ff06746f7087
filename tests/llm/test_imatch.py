import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from evograph.llm import imatch


def brute_fingerprint(text, lexicon):
    """By the definition, a sub-lexicon at a time, in Python's integers."""
    M = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
        x = (x ^ x >> 27) * 0x94D049BB133111EB & M
        return x ^ x >> 31

    words = sorted({xxhash.xxh64_intdigest(w) for w in text.lower().encode().split()})
    mine = [w for w in words if w in lexicon]
    if not mine:
        return "out" + xxhash.xxh64_hexdigest(np.array(words, np.uint64).tobytes(), imatch.SEED)
    level = 1
    while len(mine) / 2 ** (level + 1) >= imatch.TERMS:
        level += 1
    parts = []
    for at in (level, level + 1):
        for salt in imatch._salt.tolist():
            kept = [w for w in mine if mixed(w ^ salt) < 1 << 64 - at]
            total = sum(mixed((w + (k + 1) * 0x9E3779B97F4A7C15) & M) for k, w in enumerate(kept)) & M
            parts.append(f"{mixed(total):016x}" if kept else "-" * 16)
    return f"{level:02d}" + "".join(parts)


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if "out" in (a[:3], b[:3]):
        return 0.0
    x, y = ({(int(s[:2]) + k // imatch.SUBSETS, k % imatch.SUBSETS): s[2 + 16 * k : 18 + 16 * k] for k in range(2 * imatch.SUBSETS)} for s in (a, b))
    both = [(x[k], y[k]) for k in x.keys() & y.keys() if "-" * 16 not in (x[k],) or "-" * 16 not in (y[k],)]
    return sum(p == q for p, q in both) / len(both) if both else 0.0


def corpus():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows = [(i * 3, " ".join(rng.choices(vocabulary, k=rng.choice([5, 30, 200, 900])))) for i in range(150)]
    rng.shuffle(rows)
    return rows + [(1, None), (4, ""), (7, " \n "), (9, "twice"), (9, "twice"), (9, "other"), (None, "no id at all"), (451, rows[0][1]), (460, "long " + rows[1][1] * 200)]


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    lex = imatch.lexicon(docs, 0.01, 0.2)
    df = Counter(x for _, t in rows for x in imatch.terms(t or "").tolist())
    assert lex.tolist() == sorted(x for x, n in df.items() if max(2, 0.01 * len(rows)) <= n <= 0.2 * len(rows))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode()) >> 1))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        n = len(t) // 4
        e = t[: len(t) - n] + u[:n]
        a, b, c = (brute_fingerprint(x, set(lex.tolist())) for x in (t, e, u))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, brute_likeness(a, b), brute_likeness(a, c)))
    for parts in (1, 4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [tuple(r) for r in imatch.fingerprints(docs, 0.01, 0.2).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    long = [w for w in want if w[1] > 150]
    assert np.mean([w[5] for w in long]) > 0.12 and np.mean([w[6] for w in long]) < 0.02
    assert np.mean([w[5] > w[6] for w in long]) > 0.95
    assert imatch.fingerprints(docs.limit(0)).count() == 0
    assert imatch.fingerprints(docs.where("doc_id = 4")).first().near_next == 1.0


def test_order_and_repeats_of_words_do_not_matter():
    lex = imatch.terms(" ".join(f"w{i}" for i in range(100)))
    words = [f"w{i}" for i in range(20)]
    a, b = imatch.fingerprints_of([" ".join([*words, "unknown"]), "\n".join(["Elsewhere", *reversed(words), "W3 w3"])], lex)
    assert a == b and imatch.likeness(a, b) == 1
    one, none, other, blank, empty = imatch.fingerprints_of(["w1", "x", "y", " ", ""], lex)
    assert len(one) == len(a) and none != other and blank == empty
    assert imatch.likeness(none, other) == 0 and imatch.likeness(one, none) == 0 and imatch.likeness(blank, empty) == 1


def test_terms_hashed_together_and_neighbouring_levels():
    """At the first level 3 to 6 terms on average, whatever the length; counts within a factor of two share a level."""
    n = np.array([1, 6, 11, 12, 47, 48, 95, 96, 1000, 10**6])
    level = imatch.level_of(n)
    assert level.tolist() == [1, 1, 1, 2, 3, 4, 4, 5, 8, 18]
    assert ((n / 2.0**level)[1:] >= 3).all() and ((n / 2.0**level) < 6).all()
    lex = imatch.terms(" ".join(f"w{i}" for i in range(5000)))
    a, b = imatch.fingerprints_of([" ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(44))], lex)
    assert a[:2] == "04" and b[:2] == "03" and imatch.likeness(a, b) == brute_likeness(a, b) == imatch.likeness(b, a) > 0.1
