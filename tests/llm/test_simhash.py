import os
import random

import numpy as np
import xxhash

from evograph.llm import simhash


def brute(rows, shingle=3):
    prints = []
    for i, text in rows:
        words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
        n = len(words)
        grams = [b" ".join(words[k : k + shingle]) for k in range(n - shingle + 1)] if n >= shingle else [b" ".join(words)] if n else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fp = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0
        prints.append((i, fp))
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                label[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(prints):
        r = root(k)
        if i is not None:
            ids[r] = min(i, ids.get(r, i))
    return sorted(((i, fp if fp < 1 << 63 else fp - (1 << 64), ids.get(root(k))) for k, (i, fp) in enumerate(prints)), key=str)


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(40, 300)))))
    for i in range(150, 260):
        base = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, " ".join(base).upper() if i % 3 else "\n".join(base)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "One"), (305, "two words"), (7, "one"), (7, rows[7][1]), (None, "one"), (None, "never seen before anywhere at all"), (306, "é À " * 30)]
    return rows


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_routing_loses_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 32, 300, np.uint64).astype(np.uint32)
    near = base ^ (np.uint32(1) << rng.integers(0, 32, 300).astype(np.uint32))
    values = np.concatenate([base, near, base[:20]])
    tree = simhash.Tree(base, 6)
    rows, leaves = tree.route(values)
    homes = {}
    for r, leaf in zip(rows.tolist(), leaves.tolist()):
        homes.setdefault(r, set()).add(leaf)
    assert tree.leaves > 30
    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 1):
            assert homes[a] & homes[int(b)]


def test_star_steps_join_long_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)]
    got = dict(simhash.components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[150] == got[100] == 100


def test_one_per_group_keeps_the_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(5, text, "a"), (3, text, "b"), (9, "other " * 9 + "end", "c"), (None, text, "d")], "doc_id long, text string, component_id string")
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r[0] for r in kept.collect()))) == ["3", "9", "None"]


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def edited_corpus():
    """Groups of a text and copies with words replaced, and texts alone."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(150, 500)))) for i in range(120)]
    near = []
    for i in range(60):
        words = rows[i][1].split()
        for k in rng.sample(range(len(words)), max(1, len(words) // (60 if i % 2 else 200))):
            words[k] = word()
        near.append((1000 + i, " ".join(words)))
    far = []
    for i in range(60, 80):
        words = rows[i][1].split()
        for k in rng.sample(range(len(words)), len(words) // 10):
            words[k] = word()
        far.append((2000 + i, " ".join(words)))
    return rows, near, far


def test_edited_copies_go_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_SHARD", 8)
    rows, near, far = edited_corpus()
    texts = dict(rows)
    assert all(jaccard(t, texts[i - 1000]) >= 0.8 for i, t in near) and all(jaccard(t, texts[i - 2000]) < 0.6 for i, t in far)
    kept = {r[0] for r in simhash.one_per_group(spark.createDataFrame(rows + near + far, "doc_id long, text string")).collect()}
    assert kept == set(texts) | {i for i, _ in far}
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wide_forest_has_the_components_of_all_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (40, 8), np.uint64)
    fp = np.concatenate([base] + [base[:20] ^ (rng.random((20, 8, 64)) < 0.1).dot(np.uint64(1) << np.arange(64, dtype=np.uint64)) for _ in range(4)])
    limit = simhash.most_differing(0.8)
    label = list(range(len(fp)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(fp)):
        for b in range(a):
            words = np.bitwise_count(fp[a] ^ fp[b])
            if words[0] <= simhash.FIRST_WORD and words.sum() <= limit:
                label[root(a)] = root(b)
    for whole in (10, 1000):
        a, b = simhash.wide_forest(fp, limit, whole)
        assert len(a) == len(fp) - len({root(k) for k in range(len(fp))})
        assert all(root(x) == root(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def groups_by_brute_force(rows):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, least[root(k)]) for k, (i, _) in enumerate(rows))


def borderline_corpus():
    """Pairs around a Jaccard similarity of 0.8, of long and very short texts, in front of a common opening."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(4, 9)))
    opening = " ".join(word() for _ in range(12))
    rows = []
    for i in range(150):
        n = rng.choice([3, 6, 9, 12, 40, 120, 300])
        words = [word() for _ in range(n)]
        rows.append((10 * i, (opening + " " if i % 2 and n > 30 else "") + " ".join(words)))
        for k in (1, 2):
            other = list(words)
            for at in rng.sample(range(n), max(1, n // rng.choice([40, 45, 50, 60])) if n > 30 else 0):
                other[at] = word()
            rows.append((10 * i + k, (opening + " " if i % 2 and n > 30 else "") + " ".join([*other, *(word() for _ in range(k if n < 30 else 0))])))
    return [*rows, (9000, ""), (9001, " "), (9002, "four words are here"), (9003, "four words are here now")]


def test_only_links_of_enough_exact_similarity_group(spark):
    rows = borderline_corpus()
    got = sorted(map(tuple, simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = dict(groups_by_brute_force(rows))
    assert not [(i, c) for i, c in got if c < want[i]]
    assert sum(i != c for i, c in want.items()) > 50 and sum(i == c for i, c in want.items() if i % 10) > 50


def test_no_pair_of_enough_similarity_is_missed(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_SHARD", 8)
    rows = borderline_corpus()
    got = sorted(map(tuple, simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == groups_by_brute_force(rows)


def written_rows(monkeypatch):
    """Names and DataFrames of what is written from now on."""
    seen, write = {}, simhash.common.materialize
    monkeypatch.setattr(simhash.common, "materialize", lambda df, name: seen.setdefault(name, []).append(out := write(df, name)) or out)
    return seen


def test_texts_and_shingles_do_not_stay_on_disk(spark, monkeypatch):
    seen = written_rows(monkeypatch)
    rows, near, far = edited_corpus()
    found = simhash.similar_documents(spark.createDataFrame(rows + near + far, "doc_id long, text string"))
    left = {name for name, dfs in seen.items() for df in dfs if os.path.exists(df.inputFiles()[0].removeprefix("file://") if df.inputFiles() else "")}
    assert not left & {"shingle_sets", "set_nodes", "prefixes", "shared", "shared_prefixes", "placed", "mixed", "pairs"}
    assert found.count() == len(rows + near + far)


def test_pairs_with_one_rare_shingle_in_common_are_not_compared(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8)))
    passage = " ".join(word() for _ in range(7))
    rows = [(i, " ".join([*(word() for _ in range(100)), passage, *(word() for _ in range(100))])) for i in range(40)]
    rows += [(100, rows[7][1] + " end"), (101, rows[8][1] + " other end")]
    monkeypatch.setattr(simhash, "RANKED", 0)  # no sample sets the passage last, as where it is rare on the whole
    compared, run = [], simhash.common.arrow_pass
    monkeypatch.setattr(simhash.common, "arrow_pass", lambda df, make, schema, *a: (compared.append(df.count()) if schema == "u long, v long" else None) or run(df, make, schema, *a))
    got = dict(simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: {100: 7, 101: 8}.get(i, i) for i, _ in rows}
    assert sum(compared) <= 4


def test_the_stage_links_by_fingerprints_and_trees(spark, monkeypatch):
    """The stage's trees find most pairs by their fingerprints, and pairs that they propose are checked on the sets."""
    monkeypatch.setattr(simhash, "WIDE_SHARD", 8)
    rows, near, far = edited_corpus()
    names = {i: simhash.set_name(simhash.shingle_set(t)) for i, t in rows + near + far}
    tried, write = set(), simhash.common.materialize

    def noted(df, name):
        out = write(df, name)
        if name == "sketched":
            tried.update(frozenset(r) for r in out.collect())
        return out

    monkeypatch.setattr(simhash.common, "materialize", noted)
    monkeypatch.setattr(simhash, "SLACK", 60)  # so wide that pairs are proposed which are not similar
    kept = {r[0] for r in simhash.one_per_group(spark.createDataFrame(rows + near + far, "doc_id long, text string")).collect()}
    assert sum(frozenset((names[i], names[i - 1000])) in tried for i, _ in near) >= 0.9 * len(near)
    assert any(frozenset((names[i], names[i - 2000])) in tried for i, _ in far)
    assert kept == {i for i, _ in rows + far}


def test_wide_fingerprint_is_a_majority():
    rng = np.random.default_rng(9)
    of = rng.integers(0, 1 << 63, 700, np.uint64)
    bits = np.zeros(512, int)
    for h in of.tolist():
        for k, odd in enumerate(simhash._ODD[0].tolist()):
            x = h * odd % (1 << 64)
            x ^= x >> 32
            x = x * 0xD6E8FEB86659FD93 % (1 << 64)
            x ^= x >> 32
            bits[64 * k : 64 * k + 64] += [x >> b & 1 for b in range(64)]
    assert simhash.wide_fingerprint(of) == np.packbits(bits * 2 > 700, bitorder="little").tobytes()
    assert simhash.wide_fingerprint(of[:0]) == bytes(64)
