import operator
import random
import time

from evograph.llm import linededup


def brute_runs(rows, words_of, gram, least):
    """Of each row, the words in runs of ``least`` or more, all of them in ``gram`` words that occur earlier: in a row before or in this one."""
    seen, out = set(), {}
    for key in sorted({(i is None, i or 0, t) for i, t in rows if t}, key=lambda r: r[:2]):
        words = words_of(key[2])
        hit = [False] * len(words)
        mine = set()
        for k in range(len(words) - gram + 1):
            g = tuple(words[k : k + gram])
            if g in seen or g in mine:
                hit[k : k + gram] = [True] * gram
            mine.add(g)
        seen |= mine
        runs, at = [], 0
        for k, h in enumerate([*hit, False]):
            if not h:
                if k - at >= least:
                    runs.append((at, k))
                at = k + 1
        out[key] = runs
    return out


def word(rng, lo=9, hi=12):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(lo, hi)))


def corpus():
    rng = random.Random(4)
    words = lambda n: [word(rng) for _ in range(n)]
    rows, last = [], 0
    for _ in range(80):
        width, total = rng.choice([(200, 51), (9, 54), (15, 60), (10, 120), (200, 80), (30, 400)])
        passage = words(total)
        body = "\n".join(" ".join(passage[k : k + width]) for k in range(0, total, width))
        for _ in range(2):
            rows.append((last, " ".join(words(rng.randint(5, 90))) + rng.choice([" ", "\n"]) + body + rng.choice([" ", "\n"]) + " ".join(words(rng.randint(5, 90))) + "\nend"))
            last += 1
    return rng, words, rows


def test_cuts_lie_between_brute_force_bounds(spark):
    rng, words, rows = corpus()
    n = len(rows)
    rows += [(300 + i, rows[i][1]) for i in range(0, 20, 2)] + [(330 + i, rows[i][1].replace(" ", "\n", 5).replace(" ", " changed ", 1)) for i in range(0, 20, 2)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (3, rows[5][1]), (None, None), (None, rows[3][1]), (401, ""), (402, " \n\n"), (403, "\n".join([" ".join(words(45))] * 3)), (404, " ".join(words(30000)))]
    docs = spark.createDataFrame([(i, t, "l", "c", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _lines string, at string, n_chars long")
    split = lambda t: t.split()
    must, may = brute_runs(rows, split, 50, 50), brute_runs(rows, split, 2, linededup.PASSAGE)
    got = linededup.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    changed = 0
    for r in got:
        i, t = rows[r.n_chars]
        assert r.doc_id == i and r._lines == "l" and r.at == "c"
        if not t:
            assert r.text == t
            continue
        before, kept = t.split(), r.text.split()
        assert len(before) - len(kept) == r._removed_words
        key = (i is None, i or 0, t)
        left, out = [], 0
        allowed, needed = ({k for a, z in runs[key] for k in range(a, z)} for runs in (may, must))
        # Words are nearly all distinct, so what stays tells which places went.
        at = 0
        for k, w in enumerate(before):
            if at < len(kept) and w == kept[at]:
                at += 1
                left.append(k)
            else:
                out += 1
                assert k in allowed, (i, k)
        assert at == len(kept)
        assert len(needed & set(left)) <= 0 or i == 403, (i, len(needed & set(left)))
        changed += out > 0
        if not allowed:
            assert r.text == t
    assert changed > n // 2 + 20
    assert linededup.deduplicated(docs.limit(0)).columns == docs.columns
    assert linededup.deduplicated(docs.limit(0)).count() == 0


def test_passages_go_and_first_occurrences_stay(spark):
    _, words, rows = corpus()
    n = len(rows)
    p = words(70)
    rows += [(n, " ".join(words(9) + p[20:50] + words(9))), (n + 1, " ".join(words(9) + p + words(9))), (n + 2, " ".join(words(7) + p + words(7)))]
    rows += [(n + 3, " ".join(["again"] * 100)), (n + 4, None), (n + 5, "short")]
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in rows], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in linededup.deduplicated(docs).collect()}
    assert len(got) == len(rows) and got[n + 4].text is None and got[n + 5].text == "short"
    for k in range(0, n, 2):
        assert got[k].text == rows[k][1] and got[k].n_chars == -1
        shared = set(rows[k][1].split()) - {"end"}
        assert got[k + 1].text.split() == [w for w in rows[k + 1][1].split() if w not in shared] and got[k + 1].n_chars == len(got[k + 1].text)
        assert got[k + 1].text.endswith("\nend")
    assert got[n + 1].text == rows[n + 1][1] and len(got[n + 2].text.split()) == 14
    assert got[n + 3].text.split() == ["again"] * linededup.PASSAGE


def test_recall_of_short_passages_and_size_of_chunks():
    rng = random.Random(7)
    vocabulary = [word(rng, 2, 8) for _ in range(2000)]
    some = lambda n: rng.choices(vocabulary, k=n)
    texts = []
    for _ in range(400):
        p = some(51)
        texts += [(" ".join(some(rng.randint(10, 80))) + rng.choice([" ", "\n"]) + " ".join(p) + " " + " ".join(some(rng.randint(10, 80)))).encode() for _ in range(2)]
    of, at, n, c, n_words = linededup.chunks(texts)
    assert n_words.tolist() == [len(t.split()) for t in texts]
    found = [set() for _ in texts]
    for t, a, k, h in zip(of.tolist(), at.tolist(), n.tolist(), c.tolist(), strict=True):
        found[t].add((h, b" ".join(texts[t].split()[a : a + k])))
    assert len({h for f in found for h, _ in f}) == len({w for f in found for _, w in f})
    assert sum(bool(a & b) for a, b in zip(found[::2], found[1::2], strict=True)) >= 0.99 * 400
    assert 8 < n.mean() < 14 and 12 < n_words.sum() / len(n) < 18


def test_words_hash_alike_wherever_they_stand():
    rng = random.Random(5)
    texts = [b"", b" \n", b"a", b" a\tb\x0bc ", "é ü\x85x\xa0y".encode(), b"x" * 200_000 + b" a", (b"ab " * 70_000)]
    texts += [b"".join(rng.choice([b"a", b"bc", b" ", b"\n", b"  "]) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    known: dict[bytes, int] = {}
    for t in texts:
        starts, h = linededup.word_hashes(t)
        words = t.split()
        assert len(starts) == len(words)
        for a, w, x in zip(starts.tolist(), words, h.tolist(), strict=True):
            assert t[a : a + len(w)] == w and known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_chunks_do_not_depend_on_neighbouring_texts():
    rng = random.Random(3)
    texts = [" ".join(word(rng, 1, 6) + rng.choice(["", "", "\n"]) for _ in range(rng.choice([0, 1, 5, 60, 400]))).encode() for _ in range(60)]
    of, at, n, c, _ = linededup.chunks(texts)
    for k, t in enumerate(texts):
        alone = linededup.chunks([t])
        assert all((x[of == k] == y).all() for x, y in zip((at, n, c), alone[1:4], strict=True))


def test_boundaries_resist_shifts():
    rng = random.Random(3)
    text = "\n".join(" ".join(word(rng, 2, 6) for _ in range(rng.randint(1, 40))) for _ in range(80))
    cut = lambda t: set(linededup.chunks([t.encode()])[3].tolist())
    assert len(cut(text)) > 60 and len(cut(text) - cut("some new words\nat the front " + text)) <= 3


def test_pieces_are_compared_at_the_pace_of_plain_lists():
    """A piece costs a few times what comparing its words one by one costs."""
    words = [f"w{i}".encode() for i in range(4_000)]
    there = [b"x" if i % 50 == 0 else w for i, w in enumerate(words)]
    pieces = [(0, at, 20, at, False) for at in range(100, 3_900, 4)]

    def plain():
        for _, at, n, fat, _ in pieces:
            list(map(operator.eq, words[at - 40 : at + n + 40], there[fat - 40 : fat + n + 40]))

    def least(f):
        times = []
        for _ in range(7):
            began = time.process_time()
            f()
            times.append(time.process_time() - began)
        return min(times)

    assert linededup.covered(words, pieces, lambda f, a, z: there[a:z])
    assert least(lambda: linededup.covered(words, pieces, lambda f, a, z: there[a:z])) < 4 * least(plain)
