"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Each byte is embedded, with a
flag for bytes that repeat the eight bytes at a short distance before; learned filters slide over a
chunk and are max-pooled.  The chunks' pooled vectors are combined by mean and maximum into one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CHUNK, OVERLAP = 256, 32
STEP = CHUNK - OVERLAP
EMBEDDED, FILTERS, HOP = 8, 32, 4
#: Distances at which a repeat of eight bytes raises the flag.
LAGS = range(2, 33)
#: Training reads at most about this many labelled texts, of each at most so many chunks, in so many steps.
SAMPLE, SAMPLE_CHUNKS, STEPS, BATCH = 4_000, 8, 350, 48
CUT = 0.3
SEED = 20240815


def chunk_count(n: int) -> int:
    return max(1, -(-(n - OVERLAP) // STEP))


def chunked(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, flags, number of chunks) of all texts; shorter last chunks end in zero bytes."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([chunk_count(len(r)) for r in raws])
    room = counts * STEP + OVERLAP + 64  # zeros between texts, so none sees another
    starts = np.concatenate([[0], np.cumsum(room)])
    buffer = np.zeros(starts[-1] + 8, np.uint8)
    for at, raw in zip(starts.tolist(), raws, strict=False):
        buffer[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
    eight = np.zeros(len(buffer), np.uint64)
    for j in range(8):
        eight[: len(buffer) - 8] |= buffer[j : len(buffer) - 8 + j].astype(np.uint64) << np.uint64(8 * j)
    same = np.zeros(len(buffer), bool)
    for lag in LAGS:
        same[lag:] |= eight[lag:] == eight[:-lag]
    same &= buffer != 0
    first = np.repeat(starts[:-1], counts) + STEP * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    view = np.lib.stride_tricks.sliding_window_view
    return view(buffer, CHUNK)[first], view(same, CHUNK)[first], counts


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        width = HOP * (EMBEDDED + 1)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32),
            "now": rng.normal(0, 1 / np.sqrt(2 * width), (width, FILTERS)).astype(np.float32),
            "next": rng.normal(0, 1 / np.sqrt(2 * width), (width, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }

    def blocks(self, chunks: np.ndarray, flags: np.ndarray) -> np.ndarray:
        x = np.empty((*chunks.shape, EMBEDDED + 1), np.float32)
        x[..., :EMBEDDED] = self.p["embed"][chunks]
        x[..., EMBEDDED] = flags
        return x.reshape(len(chunks), CHUNK // HOP, HOP * (EMBEDDED + 1))

    def pooled(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maxima before the rectifier, where they are); a filter spans two neighbouring blocks."""
        flat = blocks.reshape(-1, blocks.shape[2])
        shape = (*blocks.shape[:2], FILTERS)
        conv = (flat @ self.p["now"]).reshape(shape)[:, :-1] + (flat @ self.p["next"]).reshape(shape)[:, 1:]
        at = conv.argmax(1)
        return np.take_along_axis(conv, at[:, None], 1)[:, 0] + self.p["bias"], at

    def combine(self, top: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text vectors (mean, maximum of the chunks) and their probabilities."""
        cuts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        both = np.hstack([np.add.reduceat(top, cuts) / counts[:, None], np.maximum.reduceat(top, cuts)])
        z = both @ self.p["out"] + self.p["shift"]
        return both, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, texts: list[str | None], block: int = 512) -> np.ndarray:
        chunks, flags, counts = chunked(texts)
        top = np.concatenate([np.maximum(self.pooled(self.blocks(chunks[k : k + block], flags[k : k + block]))[0], 0) for k in range(0, len(chunks), block)])
        return np.round(self.combine(top, counts)[1].astype(float), 6)

    def gradients(self, chunks: np.ndarray, flags: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        blocks = self.blocks(chunks, flags)
        raw, at = self.pooled(blocks)
        top = np.maximum(raw, 0)
        both, prob = self.combine(top, counts)
        d = ((prob - y) / len(y)).astype(np.float32)
        g = {"out": both.T @ d, "shift": d.sum(keepdims=True)}
        dboth = d[:, None] * self.p["out"]
        text = np.repeat(np.arange(len(counts)), counts)
        dtop = dboth[text, :FILTERS] / counts[text, None].astype(np.float32)
        ties = top == both[text, FILTERS:]
        dtop += dboth[text, FILTERS:] * ties
        dtop *= raw > 0
        g["bias"] = dtop.sum(0)
        rows = np.arange(len(chunks))[:, None]
        g["now"] = np.einsum("cfw,cf->wf", blocks[rows, at], dtop)
        g["next"] = np.einsum("cfw,cf->wf", blocks[rows, at + 1], dtop)
        g["embed"] = np.zeros_like(self.p["embed"])
        byte = chunks.reshape(len(chunks), -1, HOP)
        for name, k in (("now", 0), ("next", 1)):
            back = (dtop[:, :, None] * self.p[name].T[None]).reshape(len(chunks), FILTERS, HOP, EMBEDDED + 1)[..., :EMBEDDED]
            np.add.at(g["embed"], byte[rows, at + k], back)
        loss = -np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))
        return g, float(loss)

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        """Adam over batches drawn evenly from both labels, with the output shifted back to the labels' odds."""
        rng = np.random.default_rng(seed)
        kinds = [np.flatnonzero(y == k) for k in (0, 1)]
        if not all(map(len, kinds)):
            self.p["out"][:] = 0
            self.p["shift"][:] = 3.0 if len(kinds[1]) or not len(y) else -3.0
            return
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            who = np.concatenate([rng.choice(k, BATCH // 2) for k in kinds])
            counts = np.array([len(texts[i][0]) for i in who])
            g, _ = self.gradients(np.concatenate([texts[i][0] for i in who]), np.concatenate([texts[i][1] for i in who]), counts, y[who])
            rate = 0.01 * min(1, t / 30) * (1 - 0.9 * t / steps)
            for k, value in self.p.items():
                g[k] = g[k] + 1e-4 * value * (k in ("now", "next", "out"))
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
                value -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        self.p["shift"] += np.float32(min(np.log(len(kinds[1]) / len(kinds[0])), 2.0))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network fitted on a bounded sample of the labelled texts whose fold isn't 0.

    The sample is by a hash of the id; conflicting labels of one id count as 0.  Of a text, at most ``SAMPLE_CHUNKS``
    chunks, evenly spread, are read.  Where a label is missing from the sample, the score is constant.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(common.crc_fold(F.col("doc_id")) != 0)
    share = min(1.0, sample / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def picked():
        def step(x):
            rows = []
            for i, q, t in zip(x["doc_id"], x["quality"], x["t"], strict=True):
                chunks, flags, n = chunked([t])
                keep = np.unique(np.linspace(0, n[0] - 1, min(n[0], SAMPLE_CHUNKS)).astype(int))
                rows.append((i, q, chunks[keep].tobytes(), flags[keep].tobytes()))
            return dict(zip(("doc_id", "quality", "chunks", "flags"), zip(*rows, strict=True) if rows else ([], [], [], []), strict=True))

        return step

    # At most about ``sample`` rows of two numbers are broadcast.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).join(F.broadcast(chosen), "doc_id")
    rows = common.arrow_pass(joined, picked, "doc_id long, quality long, chunks binary, flags binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.chunks)))
    texts = [(np.frombuffer(r.chunks, np.uint8).reshape(-1, CHUNK), np.frombuffer(r.flags, bool).reshape(-1, CHUNK)) for r in rows]
    net = Network()
    net.fit(texts, np.array([r.quality for r in rows], np.float32))
    return net


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``score`` (0 to 1; null and empty texts too).  Equal texts score alike to about six digits; a column of that name is replaced."""
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    out = common._arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 256, 4 << 20):
                got = net.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, out, strict=False)] + [pa.array(got)], schema=out)

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that score ``cut`` or more; columns of ``docs``, one named ``score`` too, as they were."""
    packed = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("text"))
    return scored(packed, train(docs, labels)).where(F.col("score") >= cut).select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the score of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, common.table(spark, sf_dir, "labels"))
    got = scored(docs.withColumn("held_out", common.crc_fold(F.col("doc_id")) == 0), net)
    return got.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
