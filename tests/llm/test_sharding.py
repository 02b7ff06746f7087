import zlib
from collections import Counter

from pyspark.sql import functions as F

from evograph.llm import sharding


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 5, 17, 100, 1023, 4001):
        for seed in (1, 2):
            assert sorted(sharding.permute_number(x, n, seed) for x in range(n)) == list(range(n))
    assert [sharding.permute_number(x, 500, 1) for x in range(9)] != [sharding.permute_number(x, 500, 2) for x in range(9)]


def test_columns_equal_plain_python(spark):
    for n in (1, 7, 1000):
        got = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 5).alias("p")).collect()
        assert all(r.p == sharding.permute_number(r.id, n, 5) for r in got)


def test_shards(spark):
    rows = [(k // 2 if k % 3 else None, "same" if k < 60 else str(k), 9) for k in range(203)]
    df = spark.createDataFrame(rows, "doc_id long, t string, shard int")
    got = sharding.feistel_shards(df, ["doc_id", "t"], 16).collect()
    assert len(got) == 203 and sorted(r.row_number for r in got) == list(range(203))
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    again = sharding.feistel_shards(df.repartition(7), ["doc_id", "t"], 16).collect()
    assert Counter((r.doc_id, r.t, r.shard, r.slot) for r in got) == Counter((r.doc_id, r.t, r.shard, r.slot) for r in again)
    assert sharding.feistel_shards(df.limit(0), ["doc_id"], 16).count() == 0


def applications(x, n, seed):
    """Times the network is applied before ``x`` lands below ``n``."""
    a, b = sharding.sides(n)
    times, at = 0, x
    while not times or at >= n:
        left, right = divmod(at, b)
        for k, (p, q, c) in enumerate(sharding.round_keys(seed)):
            t = (right + p) % sharding.PRIME * q % sharding.PRIME
            left, right = right, (left + (t * t + c) % sharding.PRIME) % (b if k % 2 else a)
        times, at = times + 1, left * b + right
    return times


def test_long_walks_are_finished_exactly(spark, monkeypatch):
    """Rows whose walk is longer than the two steps that all rows take here."""
    monkeypatch.setattr(sharding, "WALK", 1)
    long = [(n, seed) for n in (7, 13, 21, 31, 43) for seed in range(40) if max(applications(x, n, seed) for x in range(n)) > 2]
    assert len(long) > 2
    for n, seed in long[:: len(long) // 3]:
        got = spark.range(n).select("id", sharding.permuted(F.col("id"), n, seed).alias("p")).collect()
        assert all(r.p == sharding.permute_number(r.id, n, seed) for r in got)


def test_query_equals_brute_force(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, against a sorted list."""
    rows = [(k, f"text {k} \u00e9" * (k % 7)) for k in range(150)] + [(None, None), (None, ""), (None, "x"), (3, None), (7, "same"), (7, "same"), (200, "word " * 200_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    of = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    at = [sharding.permute_number(k, len(of), 20240917) for k in range(len(of))]
    want = Counter((*r, "rows", p % 16, p // 16, None) for r, p in zip(of, at, strict=True))
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert Counter(map(tuple, sharding.query(spark, str(tmp_path)).select(names).collect())) == want
