import random
import zlib

import numpy as np
import pytest

from evograph.llm import packing

ODD = ["", " ", "  a", "a  b", "a \n b", "a\tb c", "a\xa0b c", "it's  we'll", "x\r y", "a\n\nb c", " lead", "trail ", "\x1c x", "<|endoftext|> x", "x<|endoftext|>y", "a <|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b c <|endoftext|>", "<|endoftext", "<|endof<|endoftext|>text|>", "é  b", "1 23 4.5", "don 't", "\n", "a \r b", "   \n\n  x", "　 x"]


@pytest.fixture(scope="module")
def path():
    return packing.tokenizer_path()


def reference(path, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_the_library(path):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é\n\t .'s1 ") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    encode = packing.Encoder(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == reference(path, texts)


def test_flags_of_added_tokens(path, tmp_path):
    import json

    from tokenizers import Tokenizer

    model = json.load(open(path, encoding="utf-8"))
    n = len(model["model"]["vocab"]) + 1
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    model["added_tokens"] += [{"id": n, "content": "<a>"} | flags | {"lstrip": True}, {"id": n + 1, "content": "<ab"} | flags | {"rstrip": True}]
    (tmp_path / "t.json").write_text(json.dumps(model))
    rng = random.Random(3)
    texts = ["".join(rng.choice(["<a>", "<ab", "word", " ", "x", "\n", "  ", "é", "<|endoftext|>"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    tok = Tokenizer.from_file(f"{tmp_path}/t.json")
    got = packing.Encoder(f"{tmp_path}/t.json")(texts)
    for t, x in zip(texts, got, strict=True):
        assert np.frombuffer(x, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_windows_fill_exactly():
    rng = random.Random(2)
    for last in (True, False):
        pieces = [(i, 0, rng.choice([1, 2, 5, 100, 130, 700, 1023, 1024, 5000])) for i in range(300)]
        windows, left = packing.Packer().pack(pieces, last)
        seen = {}
        for w in windows:
            size = sum(p[2] for p in w)
            assert size <= 1024 and size & (size - 1) == 0
            for doc, start, n in w:
                seen.setdefault(doc, []).append((start, n))
        for doc, start, n in left:
            seen.setdefault(doc, []).append((start, n))
        for doc, _, total in pieces:
            at = 0
            for start, n in sorted(seen[doc]):
                assert start == at and n > 0
                at += n
            assert at == total
        assert not (last and left)


def test_gaps_of_long_windows_take_short_pieces_whole():
    windows, _ = packing.Packer().pack([(0, 0, 900), (1, 0, 100), (2, 0, 24), (3, 0, 300)], True)
    assert sorted(windows[0]) == [(0, 0, 900), (1, 0, 100), (2, 0, 24)]


def test_step_groups_are_even():
    lengths = [1024] * 40 + [512] * 30 + [128] * 50
    groups = packing.step_groups(lengths)
    sums = [sum(n for n, g in zip(lengths, groups) if g == k) for k in range(max(groups) + 1)]
    assert len(sums) == 4 and max(sums) - min(sums) <= 1024


def test_every_id_once(spark, path):
    rng = random.Random(4)
    texts = [None, "", "a", "a", *ODD, *(" ".join(rng.choices(["the", "of", "xyzzy", "Ünï"], k=rng.randint(1, 4000))) for _ in range(30))]
    rows = [(i, t, i, 0) for i, t in enumerate(texts)] + [(None, "no id", 1, 1), (2, "same id", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, tier int")
    got = packing.pack_documents(docs, path, with_ids=True).toPandas()
    want = [ids + [0] for ids in reference(path, [r[1] for r in rows])]
    assert got["length"].sum() == sum(map(len, want))
    for (doc, n), part in got[got.doc_id.notna() & (got.doc_id != 2)].groupby(["doc_id", "doc_tokens"]):
        part = part.sort_values("start")
        ids = [x for p in part["ids"] for x in p]
        assert ids == want[int(doc)] and n == len(ids)
        for _, r in part.iterrows():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() == part.tier.iloc[0] <= 1024
    assert packing.pack_documents(docs.limit(0), path).count() == 0
