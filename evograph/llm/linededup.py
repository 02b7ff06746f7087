"""Removal of repeated passages by content-defined chunks of lines.

Long lines are wrapped: a line ends at a line end, or after a pair of words whose hash says so, which depends on
these two words only.  A rolling hash over the last ``ROLL`` lines is taken at every line, and where it is the least of
``NEAR`` neighbouring ones the line is a boundary, with the lines that were rolled over as its chunk.  So boundaries and chunks
depend on nearby words only and shift with them, and ``NEAR`` lines hold at least one.

Chunks that occur more than once anywhere are laid against their first occurrence (by doc_id, then position).  Chunks at the same distance from
it are one piece, which is compared with the first occurrence byte by byte, to ``REACH`` words beyond its ends.  Runs of
words so covered that are long enough to be a passage go.
"""

from __future__ import annotations

import re
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A line is wrapped after one pair of words in so many.
WRAP = 3
#: Lines of a chunk, and neighbours among which the least hash makes a boundary.
ROLL, NEAR = 4, 9
#: Words from which a run of repeated words is a passage and goes.  Passages of 50 words are meant: where one has
#: several first occurrences, a few words at its ends may stay uncovered.
PASSAGE = 40
#: Words from which a run that equals the first occurrence counts.
RUN = 8
#: Words that are compared beyond a piece's ends, over twice the usual way from a passage's end to its first chunk; pieces at
#: most so far apart are compared as one.
REACH = 40
#: Words of a block, in which first occurrences are handed out.
BLOCK = 64
#: Bytes of texts that are hashed together.
HASHED = 1 << 20
_EQUAL = re.compile(b"\x01{%d,}" % RUN)
_KEY = ["_n", "_i", "_h"]
_FIRST = ["fn", "fi", "fh"]
_KEY_SCHEMA = "_n boolean, _i long, _h long"

_PART = 1 << 16
_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.where(_SPACE, np.uint64(0), np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64))


def _powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_STEP, _PART + 1), _powers(_BACK, _PART + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words, which ASCII white space parts.

    A hash is a polynomial over the word's bytes, taken from running sums over the text, so no word is cut out.
    """
    buffer = np.frombuffer(raw, np.uint8)
    starts, low, back, high = [], [], [], []
    so_far, up, down, space_before = np.zeros(1, np.uint64), _UP[:1], _DOWN[:1], True
    for at in range(0, len(buffer), _PART):
        part = buffer[at : at + _PART]
        space = _SPACE[part]
        before = np.concatenate([[space_before], space[:-1]])
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _UP[: len(part)], out=sums[1:])
        begin, end = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        starts.append(begin + at)
        low.append(so_far + up * sums[begin])
        back.append(down * _DOWN[begin])
        high.append(so_far + up * sums[end])
        so_far, up, down, space_before = so_far + up * sums[-1:], up * _UP[_PART :], down * _DOWN[_PART :], space[-1]
    if not space_before:
        high.append(so_far)
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), _mixed((np.concatenate(high) - np.concatenate(low)) * np.concatenate(back))


def _slid(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every ``width`` neighbours."""
    k = 1
    while 2 * k <= width:
        x, k = op(x[:-k], x[k:]), 2 * k
    return op(x[: len(x) - (width - k)], x[width - k :])


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, first word, words, hash) of all chunks, and the words of each text."""
    raw = b"\n".join(texts)
    starts, h = word_hashes(raw)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))  # word numbers, by text
    n_words = np.diff(first)
    if not len(h):
        return (*(np.empty(0, np.int64),) * 3, np.empty(0, np.uint64), n_words)
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    before[first[:-1][n_words > 0]] = 0
    last = _mixed(h * _STEP + before) % np.uint64(WRAP) == 0
    ends = np.searchsorted(starts, np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)) - 1
    last[ends[ends >= 0]] = last[-1] = True
    line_end = np.flatnonzero(last) + 1
    line = np.concatenate([[0], line_end[:-1]])
    of = np.searchsorted(first, line, side="right") - 1
    of_first = np.searchsorted(line, first)  # line numbers, by text
    begin = line[np.maximum(np.arange(len(line)) - ROLL + 1, of_first[of])]
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_STEP, len(h)), out=sums[1:])
    rolled = _mixed((sums[line_end] - sums[begin]) * _powers(_BACK, len(h))[begin])
    chosen = np.zeros(len(line), bool)
    if len(line) >= NEAR:
        least = _slid(rolled, NEAR, np.minimum)
        least[of[: len(least)] != of[NEAR - 1 :]] = 0
        none = np.zeros(NEAR - 1, np.uint64)
        chosen = _slid(np.concatenate([none, least, none]), NEAR, np.maximum) == rolled
    few = np.flatnonzero((np.diff(of_first) < NEAR) & (n_words > 0))  # texts of fewer lines have one chunk
    for t in few.tolist():
        chosen[of_first[t] + int(rolled[of_first[t] : of_first[t + 1]].argmin())] = True
    at = np.flatnonzero(chosen)
    return of[at], begin[at] - first[of[at]], line_end[at] - begin[at], rolled[at], n_words


def _without(text: str, cuts: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` without the words of ``cuts`` (from, to), and their number.  Of the white space around a cut one side stays, a line end first."""
    raw = text.encode("utf-8", "surrogatepass")
    space = np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8)], [True]])
    bounds = np.flatnonzero(space[1:] != space[:-1]).reshape(-1, 2)
    n = len(bounds)
    gone = np.zeros(n + 1, np.int8)
    for a, z in cuts:
        gone[a:z] = 1
    gone[-1] = 0
    if gone[:-1].all():
        return "", n
    edges = np.flatnonzero(np.diff(gone, prepend=0, append=0)).tolist()
    spans = {w: bounds[w].tolist() for e in edges for w in (e - 1, e) if 0 <= w < n}
    out, at = [], 0
    for a, z in zip(edges[::2], edges[1::2], strict=True):
        start, left = spans[a][0], spans[a - 1][1] if a else 0
        end, right = spans[z - 1][1], spans[z][0] if z < n else len(raw)
        if z < n and (a == 0 or b"\n" in raw[left:start]):
            out.append(raw[at:start])
            at = right
        else:
            out.append(raw[at:left])
            at = end
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass"), int(gone.sum())


def _hashed():
    """Chunks of texts that are long enough to hold a passage."""

    def step(x):
        of, at, n, c, n_words = chunks([(t or "").encode("utf-8", "surrogatepass") for t in x["_text"]])
        long = n_words[of] >= PASSAGE
        of = of[long]
        return {k: np.array(x[k])[of] for k in _KEY} | {"at": at[long], "n": n[long], "c": c[long].view(np.int64)}

    return step


_PIECES = f"{_KEY_SCHEMA}, fn array<boolean>, fi array<long>, fh array<long>, pf array<int>, at array<int>, n array<int>, fat array<int>, bf array<int>, block array<int>"


def _joined():
    """Of each text, its first occurrences elsewhere (fn, fi, fh), its pieces (number of the first occurrence, at, n, place there), and the blocks wanted."""

    def step(x):
        out: dict[str, list] = {f.split()[0]: [] for f in _PIECES.split(", ")}
        for row in zip(*(x[k] for k in _KEY), x["_all"], strict=True):
            firsts: dict[tuple, int] = {}
            pieces: list[list[int]] = []
            placed = sorted((w["fn"], w["fi"], w["fh"], w["at"] - w["fat"], w["at"], w["n"]) for w in row[-1])
            for (*key, shift), same in groupby(placed, key=lambda w: w[:4]):
                f, end = firsts.setdefault(tuple(key), len(firsts)), None
                for *_, at, n in same:
                    if end is not None and at <= end + REACH:
                        end = max(end, at + n)
                        pieces[-1][2] = end - pieces[-1][1]
                    else:
                        end = at + n
                        pieces.append([f, at, n, at - shift])
            wanted = sorted({(f, b) for f, _, n, fat in pieces for b in range(max(0, fat - REACH) // BLOCK, (fat + n + REACH - 1) // BLOCK + 1)})
            for name, v in zip(out, (*row[:-1], *zip(*firsts, strict=True), *zip(*pieces, strict=True), *zip(*wanted, strict=True)), strict=True):
                out[name].append(v)
        return out

    return step


def _cut_out():
    """The wanted blocks of first occurrences."""

    def step(x):
        out: dict[str, list] = {k: [] for k in (*_FIRST, "block", "body")}
        seen = set()
        for row in zip(*(x[k] for k in _KEY), x["_text"], x["_wanted"], strict=True):
            if row[:3] not in seen:
                seen.add(row[:3])
                words = row[3].encode("utf-8", "surrogatepass").split()
                for b in row[4]:
                    if b * BLOCK < len(words):
                        for name, v in zip(out, (*row[:3], b, b" ".join(words[b * BLOCK : (b + 1) * BLOCK])), strict=True):
                            out[name].append(v)
        return out

    return step


def covered(words: list[bytes], pieces: list[tuple], other, passage: int = PASSAGE) -> list[tuple[int, int]]:
    """Runs (from, to) of ``passage`` words or more that lie in runs of ``RUN`` words or more which equal a first occurrence.

    A piece is (first occurrence, at, n, place there, whether it is this text itself); ``other(first, a, z)`` gives the words a to z there as
    far as there are any.
    """
    gone = np.zeros(len(words) + 2, np.int8)
    for f, at, n, fat, own in pieces:
        back = min(REACH, at, fat)
        a, low = at - back, fat - back
        there = other(f, low, fat + n + REACH)
        for run in _EQUAL.finditer(bytes(map(eq, words[a : at + n + REACH], there))):
            x, z = run.span()
            # Where both occurrences overlap, the first keeps the length of a passage.
            start = max(a + x, low + x + passage) if own else a + x
            gone[start + 1 : max(start, a + z) + 1] = 1
    edges = np.flatnonzero(np.diff(gone)).tolist()
    return [(a, z) for a, z in zip(edges[::2], edges[1::2], strict=True) if z - a >= passage]


def remove_repeats(docs: DataFrame, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``_removed_lines``, ``_removed_words``, ``_lines`` added.

    The first occurrence stays: that of the smallest id (null last), among equal ids of the text with the smallest
    hash, then the earliest.  White space between words does not count.  Texts in which nothing repeats come back unchanged, null
    ones too; a text may become empty, but no row goes.  Rows that share id and text are one document.  Columns of ``docs`` keep their
    names and types (the added ones step back for columns of the same name); an empty table stays empty.
    """
    if passage < PASSAGE:
        raise ValueError(f"chunks find passages of {PASSAGE} words or more")
    columns = docs.columns
    others = [c for c in columns if c != text_col]
    keyed = docs.select(
        F.coalesce(F.col(id_col).isNull(), F.lit(True)).alias("_n"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_i"), F.xxhash64(text_col).alias("_h"),
        F.col(text_col).alias("_text"), F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others))).alias("_row"),
    )
    found = common.materialize(common.arrow_pass(keyed.select(*_KEY, "_text"), _hashed, f"{_KEY_SCHEMA}, at int, n int, c long", most=HASHED), "chunks")
    often = found.groupBy("c").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("c")
    # Written, as below, so that the joins on hot chunks stand alone, where their partitions can be split.
    often = common.materialize(often, "often")
    near = common.materialize(found.join(often, "c"), "repeated_chunks")
    common.release(found, often)
    here = F.struct(*_KEY, "at")
    first = common.materialize(near.groupBy("c").agg(F.min(here).alias("_f")), "first")
    of_first = [F.col("_f._n").alias("fn"), F.col("_f._i").alias("fi"), F.col("_f._h").alias("fh"), F.col("_f.at").alias("fat")]
    again = common.materialize(near.join(first, "c").where(here != F.col("_f")).select(*_KEY, "at", "n", *of_first), "again")
    common.release(near, first)
    # A text's own chunks only, each once: the list is as long as the text.
    listed = again.groupBy(*_KEY).agg(F.collect_set(F.struct("at", "n", *_FIRST, "fat")).alias("_all"))
    pieces = common.materialize(common.arrow_pass(listed, _joined, _PIECES), "pieces")
    common.release(again)
    need = pieces.select(*_KEY, *_FIRST, F.explode(F.arrays_zip("bf", "block")).alias("_b"))
    need = need.select(*_KEY, *(F.element_at(c, F.col("_b.bf") + 1).alias(c) for c in _FIRST), F.col("_b.block").alias("block"))
    wanted = need.groupBy(*(F.col(f).alias(k) for f, k in zip(_FIRST, _KEY, strict=True))).agg(F.collect_set("block").alias("_wanted"))
    bodies = common.arrow_pass(keyed.select(*_KEY, "_text").join(wanted, _KEY), _cut_out, "fn boolean, fi long, fh long, block int, body binary")
    bodies = common.materialize(bodies.groupBy(*_FIRST, "block").agg(F.first("body").alias("body")), "bodies")
    checks = need.join(bodies, [*_FIRST, "block"]).groupBy(*_KEY).agg(F.collect_set(F.struct(*_FIRST, "block", "body")).alias("_blocks"))

    schema = T.StructType([T.StructField("_row", keyed.schema["_row"].dataType), T.StructField("_new", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("_lines", "_removed_lines", "_removed_words"))])
    out = common._arrow_schema(schema)
    parts = ("pf", "at", "n", "fat")

    def edited(batches):
        for whole in batches:
            for batch in common.slices(whole):
                x = batch.select([*_KEY, "_text", *_FIRST, *parts, "_blocks"]).to_pydict()
                rows = [[], [], [], []]
                for k, text in enumerate(x["_text"]):
                    new, lines, count = text, 0, 0
                    if x["_blocks"][k]:
                        me, firsts = tuple(x[c][k] for c in _KEY), list(zip(*(x[c][k] for c in _FIRST), strict=True))
                        numbers = {key: f for f, key in enumerate(firsts)}
                        held = {(numbers[b["fn"], b["fi"], b["fh"]], b["block"]): b["body"].split() for b in x["_blocks"][k]}

                        def other(f: int, a: int, z: int, held=held) -> list[bytes]:
                            got: list[bytes] = []
                            for b in range(a // BLOCK, (z - 1) // BLOCK + 1):
                                got += held.get((f, b), ())
                            return got[a % BLOCK : a % BLOCK + z - a]

                        pieces = [(*p, firsts[p[0]] == me) for p in zip(*(x[c][k] for c in parts), strict=True)]
                        if cuts := covered(text.encode("utf-8", "surrogatepass").split(), pieces, other, passage):
                            new, count = _without(text, cuts)
                            lines = text.count("\n") - new.count("\n") + (not new)
                    for column, v in zip(rows, (new, 0 if text is None else text.count("\n") + 1, lines, count), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([batch.column("_row").cast(out[0].type), *(pa.array(c, type=f.type) for c, f in zip(rows, list(out)[1:], strict=True))], schema=out)

    done = keyed.join(pieces.select(*_KEY, *_FIRST, *parts), _KEY, "left").join(checks, _KEY, "left").mapInArrow(edited, schema)
    place = {c: k for k, c in enumerate(others)}
    back = [F.col("_new").alias(c) if c == text_col else F.col(f"_row.c{place[c]}").alias(c) for c in columns]
    return done.select(*back, *(c for c in ("_lines", "_removed_lines", "_removed_words") if c not in columns))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages; ``n_chars`` follows the text."""
    columns = docs.columns
    got = remove_repeats(docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in columns if c != "text")).alias("_doc"), F.col("doc_id"), F.col("text")))
    kept = {c: F.col(f"_doc.`{c}`").alias(c) for c in columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        size = F.when(F.col("_removed_words") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        kept["n_chars"] = size.otherwise(F.col("_doc.n_chars")).alias("n_chars")
    return got.select(*kept.values())


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document without the passages that an earlier one has."""
    got = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed_lines").alias("n_removed_lines"), F.col("_removed_words").alias("n_removed_words"), "text")
