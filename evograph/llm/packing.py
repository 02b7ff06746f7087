"""Hierarchical packing of documents into context windows of several lengths.

Documents are tokenised where they lie and packed by task, so nothing is shuffled.  Whole windows of
the longest tier are cut from long documents; what remains is routed to the shortest tier that holds
it.  Each tier is packed best-fit, longest pieces first.  Gaps of long windows are filled from shorter
tiers: the longest piece that fits goes in whole, and the last gap takes the head of a piece.  So windows fill
exactly, and lengths are powers of two that need no padding; what is left at a task's end is
cut into ever smaller powers of two.  Sequences are dealt to step groups of even attention cost.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TIERS = (1024, 512, 256, 128)
#: Tokens packed together; bounds a task's memory.
CHUNK = 2_000_000
#: Tokens of a step group.
STEP = 16 * 1024
#: Words whose ids a task remembers.
REMEMBERED = 400_000


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library as packed little-endian unsigned 32-bit bytes.

    Text before a space that a non-space follows never merges with what comes after, so ids of space-led
    words are remembered, and unknown words are encoded many at a time, parted by carriage returns.
    Texts whose white space isn't of that kind are encoded whole.  Added tokens are cut out of a text first, as the library
    does: the leftmost, of those the longest, with the white space that their flags ask for.
    """

    def __init__(self, path: str):
        import tiktoken

        model = json.load(open(path, encoding="utf-8"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        added = {t["content"]: t for t in model.get("added_tokens", [])}
        special = set(added)
        if any(t.get("single_word") or t.get("normalized") for t in added.values()):
            raise ValueError("added tokens that match whole words or normalised text are not supported")
        forms = [r"\s*" * t.get("lstrip", False) + f"({re.escape(c)})" + r"\s*" * t.get("rstrip", False) for c, t in sorted(added.items(), key=lambda x: -len(x[0]))]
        self.added = re.compile("|".join(forms)) if forms else None
        self.added_ids = {c: np.array([t["id"]], "<u4").tobytes() for c, t in added.items()}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
        # The pre-tokenizer of byte-level BPE (a fixed value).
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.bpe = tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes | None] = {}
        self.mark = np.uint32(ranks[b"\r"])

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        plain = [w for w in words if w and w == w.strip() and "\r" not in w]
        if len(plain) < len(words):
            self.known.update(dict.fromkeys(set(words).difference(plain)))
        if plain:
            ids = np.array(self.bpe.encode_ordinary(" " + "\r ".join(plain)), "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            raw, starts, ends = ids.tobytes(), [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            if len(starts) != len(plain):
                raise ValueError("parted words came back joined")
            for w, a, z in zip(plain, starts, ends, strict=True):
                self.known[w] = raw[4 * a : 4 * z]

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def with_added(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [self.whole(text[at : m.start()]), self.added_ids[m[m.lastindex]]]
            at = m.end()
        return b"".join([*out, self.whole(text[at:])])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 64):
            split = [(t or "").split(" ") for t in texts[at : at + 64]]
            missing = set().union(*(p[1:] for p in split)).difference(self.known)
            if missing:
                self._learn(list(missing))
                if not missing <= self.known.keys():
                    self._learn([w for p in split for w in p[1:] if w not in self.known])
            known = self.known
            for t, p in zip(texts[at : at + 64], split, strict=True):
                if self.added and t and self.added.search(t):
                    out.append(self.with_added(t))
                    continue
                try:
                    out.append(self.whole(p[0]) + b"".join([known[w] for w in p[1:]]))
                except (TypeError, KeyError):
                    out.append(self.whole(t or ""))
        return out


class Packer:
    """Packs pieces (document, start, length) of one task; windows leave as they fill."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(a <= b or a & (a - 1) for a, b in zip(tiers, (*tiers[1:], 0), strict=True)):
            raise ValueError("tiers must be falling powers of two")
        self.tiers = tiers

    def pack(self, pieces: list[tuple[int, int, int]], last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
        """(windows, pieces left over).  A window is a list of pieces whose lengths sum to a power of two; ``last`` leaves none over."""
        top, done = self.tiers[0], []
        # Rest pieces by length, ascending: the shorter tiers are the front of the list.
        rest: list[tuple[int, int, int]] = []
        for doc, start, n in pieces:
            while n >= top:
                done.append([(doc, start, top)])
                start, n = start + top, n - top
            if n:
                rest.append((n, doc, start))
        rest.sort()
        floor = self.tiers[-1] if last else top
        total = sum(p[0] for p in rest)
        for tier, shorter in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            # A window of this tier is opened by a piece that routes to it; below, the remainder opens windows of any tier it fills.
            while rest and total >= tier and (rest[-1][0] > shorter or tier == floor):
                window, gap = [], tier
                while gap:
                    k = bisect_right(rest, (gap, float("inf"), 0)) - 1
                    if k >= 0:
                        n, doc, start = rest.pop(k)
                        window.append((doc, start, n))
                    else:
                        n, doc, start = rest.pop(0)
                        window.append((doc, start, gap))
                        insort(rest, (n - gap, doc, start + gap))
                        n = gap
                    gap -= n
                total -= tier
                done.append(window)
        left = [(doc, start, n) for n, doc, start in rest]
        if not last:
            return done, left
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                doc, start, n = left.pop()
                cut = min(n, gap)
                window.append((doc, start, cut))
                if n > cut:
                    left.append((doc, start + cut, n - cut))
                gap -= cut
            total -= size
            done.append(window)
        return done, []


def step_groups(lengths: list[int], step: int = STEP) -> list[int]:
    """A group for each sequence: groups of about ``step`` tokens, each sequence to the group of least attention cost so far."""
    groups = max(1, -(-sum(lengths) // step))
    load, group = [(0, g) for g in range(groups)], [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        cost, g = heapq.heappop(load)
        group[k] = g
        heapq.heappush(load, (cost + lengths[k] ** 2 + 4096 * lengths[k], g))
    return group


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place and crc32, and the sequence, offset, tier and step group it goes to.

    Every document, null and empty texts included, is its ids and ``end_id``; each id lies in exactly one
    piece.  Sequences are exactly filled and their lengths (``tier``) are powers of two, so none is padded; the shortest end a
    task.  Ids of sequences and step groups hold the task's number in their upper bits.  Repeated rows are packed as often as they
    occur, null ids stay null, other columns are not looked at, and an empty table gives no rows.  ``with_ids`` adds the ids
    themselves (``ids``, array of int).
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids
    schema = SCHEMA + ", ids array<int>" * with_ids
    out = common._arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, tail = Encoder(tokenizer), Packer(tiers), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        at = {"sequence": 0, "group": 0, "doc": 0}
        held: dict[int, tuple[int | None, bytes]] = {}
        pieces: list[tuple[int, int, int]] = []
        waiting = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pieces, waiting
            windows, pieces = packer.pack(pieces, last)
            waiting = sum(p[2] for p in pieces)
            lengths = [sum(p[2] for p in w) for w in windows]
            groups = step_groups(lengths) if windows else []
            rows: dict[str, list] = {n: [] for n in names}
            for window, length, group in zip(windows, lengths, groups, strict=True):
                offset = 0
                for doc, start, n in window:
                    doc_id, raw = held[doc]
                    part = raw[4 * start : 4 * (start + n)]
                    values = (doc_id, start, n, zlib.crc32(part), len(raw) // 4, base + at["sequence"], offset, length, base + at["group"] + group)
                    for name, v in zip(names, (*values, np.frombuffer(part, "<i4")) if with_ids else values, strict=True):
                        rows[name].append(v)
                    offset += n
                at["sequence"] += 1
            at["group"] += max(groups, default=-1) + 1
            keep = {p[0] for p in pieces}
            for doc in [d for d in held if d not in keep]:
                del held[doc]
            for k in range(0, len(rows["doc_id"]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name][k : k + 50_000], type=f.type) for f in out], schema=out)

        for batch in batches:
            for part in map(pa.RecordBatch.to_pydict, common.slices(batch, 256)):
                for doc_id, raw in zip(part["i"], encode(part["t"]), strict=True):
                    held[at["doc"]] = doc_id, raw + tail
                    pieces.append((at["doc"], 0, len(raw) // 4 + 1))
                    waiting += len(raw) // 4 + 1
                    at["doc"] += 1
                if waiting > CHUNK:
                    yield from flush(False)
        yield from flush(True)

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: pieces of all documents in sequences of at most 1024 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"), tokenizer_path())
