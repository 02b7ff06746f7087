import hashlib

from evograph.llm import mixing


def brute(rows):
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n or 0 for _, t, n in rows if t == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, open_, target = float(sum(size.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        open_ -= over
    out = []
    for s in names:
        mine = sorted((hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, n or 0) for i, t, n in rows if t == s)
        budget, before = int(target[s] + 0.5), 0
        epochs = budget // size[s] if size[s] else 0
        rest = budget - epochs * size[s]
        for _, known, i, n in mine:
            out.append((i if known else None, n, size[s], round(target[s], 6), epochs * n + max(0, min(n, rest - before))))
            before += n
    return sorted(out, key=str)


def corpus():
    return [(i, ["a", "b", None, "Z", "é"][i * i % 5], (i * 37) % 90) for i in range(150)] + [(None, "a", 7), (3, "b", None), (3, "b", 5), (200, "tiny", 1), (201, "empty", 0)]


def test_equals_brute_force(spark):
    rows = corpus()
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute(rows)
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[r.source] - r.target) <= 0.5 for r in got)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0


def test_documents_repeat_whole(spark):
    rows = [(i, " ".join(["w"] * (i % 30 + 1)), "en", "s" + str(i % 4 if i % 7 else 0), i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    count, sizes = {}, {}
    for r in got.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    assert max(count.values()) <= 3
    targets = {r.source: r.target for r in mixing.mix(docs.selectExpr("doc_id", "source", "size(split(text, ' ')) as size")).collect()}
    assert all(abs(sizes[s] - t) <= 30 for s, t in targets.items())


def test_the_budget_cuts_the_boundary_text_exactly(spark):
    rows = [(i, "  " + " \n".join(f"w{k}" for k in range(700 if i % 3 else 5)), "s" + str(i % 4), -1) for i in range(24)] + [(100, " ".join(f"w{k}" for k in range(20_000)), "z", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    texts, sizes, cut = {i: t for i, t, _, _ in rows}, {}, 0
    for r in mixing.mixed_documents(docs).collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
        assert texts[r.doc_id].startswith(r.text)
        if r.text != texts[r.doc_id]:
            cut += 1
            assert r.n_chars == len(r.text)
        else:
            assert r.n_chars == -1
    targets = {r.source: r.target for r in mixing.mix(docs.selectExpr("doc_id", "source", "size(split(trim(text), '[ \\n]+')) as size")).collect()}
    assert cut and set(sizes) == set(targets)
    assert all(abs(sizes[s] - t) <= 0.5 for s, t in targets.items())
