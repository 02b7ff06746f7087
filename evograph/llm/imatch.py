"""Document fingerprints by I-Match over randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band: neither so common that they say
nothing nor so rare that any edit changes them.  Sub-lexicons are random subsets of it: at level k each term stays with odds
2^-k.  A document's distinct terms in a sub-lexicon are sorted and hashed together, once for each of ``SUBSETS`` sub-lexicons of two
neighbouring levels.  The levels follow from the number n of its lexicon terms by one rule, so that about ``TERMS`` to 2 ``TERMS`` of them, and at
the second level half as many, are hashed at a time: a hash survives an edit only if none of its terms came or went.
Likeness is the share of sub-lexicons, of those that hold a term of either, whose hashes agree.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The band, as shares of all documents.  At most (mean distinct terms a document) / LOW terms reach the lower end,
#: whatever the number of documents; so the lexicon's size is bounded, and it may be broadcast.
LOW, HIGH = 0.0005, 0.2
#: Sub-lexicons of a level, and the least number of terms that the first level's leave of a document on average.
SUBSETS, TERMS = 24, 3
SEED = 20240501
#: Terms that a task counts before it passes its counts on.
COUNTED = 300_000

_salt = np.random.default_rng(SEED).integers(1, 1 << 63, SUBSETS, np.uint64)


def terms(text: str) -> np.ndarray:
    """Sorted hashes of the distinct words, lower-cased."""
    words = set(text.lower().encode("utf-8", "surrogatepass").split())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def level_of(n: np.ndarray) -> np.ndarray:
    """The first of two levels for documents of n lexicon terms: n / 2^level is ``TERMS`` to 2 ``TERMS``, but for short ones, which use level 1."""
    return np.maximum(1, np.frexp(np.maximum(n, 1) / TERMS)[1] - 1)


def fingerprints_of(texts: list[str], lexicon: np.ndarray) -> list[str]:
    """The level in two digits, then the hashes of both levels' sub-lexicons in 16 digits each, dashes for empty ones.

    A text without lexicon terms, one without words too, has "out" and a hash of all its terms.
    """
    found = [terms(t) for t in texts]
    sizes = np.array([len(f) for f in found])
    every = np.concatenate([*found, np.empty(0, np.uint64)])
    at = np.minimum(np.searchsorted(lexicon, every), max(len(lexicon) - 1, 0))
    inside = lexicon[at] == every if len(lexicon) else np.zeros(len(every), bool)
    mine, doc = every[inside], np.repeat(np.arange(len(texts)), sizes)[inside]
    n = np.bincount(doc, minlength=len(texts))
    level = level_of(n)
    shift = (64 - level[doc]).astype(np.uint64)
    hashes, some = np.zeros((len(texts), 2 * SUBSETS), np.uint64), np.zeros((len(texts), 2 * SUBSETS), bool)
    for k in range(SUBSETS):
        draw = _mixed(mine ^ _salt[k])
        kept = np.flatnonzero(draw >> shift == 0)
        for second in (0, 1):
            if second:
                kept = kept[draw[kept] >> (shift[kept] - np.uint64(1)) == 0]
            if len(kept):
                of = doc[kept]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                place = (np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of)))).astype(np.uint64)
                with np.errstate(over="ignore"):
                    sums = np.add.reduceat(_mixed(mine[kept] + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), first)
                hashes[of[first], second * SUBSETS + k] = _mixed(sums)
                some[of[first], second * SUBSETS + k] = True
    out = []
    for k, raw in enumerate(hashes.astype(">u8").view(np.uint8).reshape(len(texts), -1)):
        if not n[k]:
            out.append(f"out{xxhash.xxh64_intdigest(found[k].tobytes(), SEED):016x}")
            continue
        text = raw.tobytes().hex()
        if not some[k].all():
            text = "".join(text[16 * j : 16 * j + 16] if s else "-" * 16 for j, s in enumerate(some[k].tolist()))
        out.append(f"{level[k]:02d}{text}")
    return out


def likeness(a: str, b: str) -> float:
    """0 to 1: agreeing hashes over sub-lexicons that hold a term of either, at levels both use; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if a.startswith("out") or b.startswith("out") or abs(int(a[:2]) - int(b[:2])) > 1:
        return 0.0
    skew, width = (int(b[:2]) - int(a[:2])) * SUBSETS * 16, SUBSETS * 16
    x, y = (a[2 + max(0, skew) :], b[2 + max(0, -skew) :])
    same = either = 0
    for k in range(0, min(len(x), len(y)) if skew else 2 * width, 16):
        p, q = x[k : k + 16], y[k : k + 16]
        if p[0] != "-" or q[0] != "-":
            either += 1
            same += p == q
    return same / either if either else 0.0


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all documents; of bounded size (see ``LOW``)."""

    def counted(batches):
        seen: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(seen.keys(), np.uint64, len(seen)).view(np.int64)), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], names=["term", "n"])
            seen.clear()

        for batch in batches:
            for part in common.slices(batch, 256):
                for t in part.column(0).to_pylist():
                    seen.update(terms(t or "").tolist())
                if len(seen) > COUNTED:
                    yield from out()
        if seen:
            yield from out()

    n = docs.count()
    df = docs.select(text_col).mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = df.where((F.col("n") >= max(2, low * n)) & (F.col("n") <= max(2, high * n))).select("term").toPandas()["term"].to_numpy(np.int64)
    return np.sort(band.view(np.uint64))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, guest, i, null, h, z): compressed texts by ranges of the id, the first of each range also as a guest of the range before it.

    One shuffle brings each document and the one after it together: ranges are split at approximate quantiles of the id,
    and the smallest id of each range, one value a range, says which documents are guests.  The first document is a guest of the last range.
    """
    spark = docs.sparkSession
    parts = common.shuffle_partitions(spark)
    found = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts).alias("q")).first().q or []
    bounds = np.unique(np.array(found, np.int64))

    def place(ids: pa.Array) -> np.ndarray:
        values = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        return np.searchsorted(bounds, values, side="left")

    def smallest(batches):
        for batch in batches:
            ids = batch.column(0)
            at, values = place(ids), ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            for b in np.unique(at).tolist():
                yield pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int32()), "first": pa.array([values[at == b].min()], pa.int64())})

    firsts = docs.select("doc_id").mapInArrow(smallest, "b int, first long").groupBy("b").agg(F.min("first").alias("first")).orderBy("b").collect()
    guest_of = {r.first: firsts[k - 1].b for k, r in enumerate(firsts)}

    def spread(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in common.slices(batch, 256):
                ids, texts = part.column(0), part.column(1).to_pylist()
                at, values = place(ids).tolist(), ids.to_pylist()
                rows = []
                for b, i, t in zip(at, values, texts, strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    row = (-(1 << 63) if i is None else i, i is None, xxhash.xxh64_intdigest(raw) >> 1, squeeze.compress(raw))
                    rows.append((b, False, *row))
                    if row[0] in guest_of:
                        rows.append((guest_of[row[0]], True, *row))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "guest", "i", "absent", "h", "z"])

    placed = docs.select("doc_id", "text").mapInArrow(spread, "bucket int, guest boolean, i long, absent boolean, h long, z binary")
    return placed.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "guest", "i", "h")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of ``text`` replaced by as many first characters of ``following``, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text, and their likeness.

    The next document is that of the next id, null ids first; rows of one id are ordered by a hash of the text, and after the last comes the
    first.  Null texts count as empty, repeated rows each give one, a lone document is followed by itself, and an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, low, high))

    names, types = [f.split()[0] for f in SCHEMA.split(", ")], (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def paired(batches):
        inflate, lex = zstandard.ZstdDecompressor(), words.value
        held = None  # (id, text, fingerprint) of the last document, which waits for its next
        for batch in batches:
            for part in common.slices(batch, 256, 1 << 20):
                x, here, pairs = part.to_pydict(), [], []
                for guest, i, absent, z in zip(x["guest"], x["i"], x["absent"], x["z"], strict=True):
                    if guest and held is None:
                        continue  # a further guest, of the same id
                    now = [None if absent else i, inflate.decompress(z).decode("utf-8", "surrogatepass") if z else "", None]
                    here.append(now)
                    if held:
                        pairs.append((held, now, edited(held[1], now[1])))
                    held = None if guest else now
                marks = fingerprints_of([d[1] for d in here] + [p[2] for p in pairs], lex)
                for d, mark in zip(here, marks, strict=False):
                    d[2] = mark
                rows = [
                    (was[0], len(was[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), was[2], mark, likeness(was[2], mark), likeness(was[2], now[2]))
                    for (was, now, new), mark in zip(pairs, marks[len(here) :], strict=True)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        if held:
            raise ValueError("a document's next one is missing")

    return with_next(docs).mapInArrow(paired, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: fingerprints of all documents."""
    return fingerprints(common.table(spark, sf_dir, "documents"))
