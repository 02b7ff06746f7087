"""Personal data: base rules, and a character-level bidirectional LSTM with CRF transitions.

The network, trained in numpy from labelled spans, reads every text whole in overlapping windows of characters, and the best
tag path of each window is decoded.  A decoded span counts if the path's log-odds over the same path without it reach a
limit, set on labelled lines that training has not seen.  Spans of all windows of a text are reconciled: those cut by a window's
edge go, as do those that overlap a better one or a base span.  Of the kinds' forms only the limits on numbers are checked afterwards.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Spans of up to WINDOW - STRIDE - 2 = 254 characters, which no address exceeds, lie inside a window, clear of its edges.
WINDOW, STRIDE = 1024, 768
#: Windows of training, which are shorter since made-up lines are.
LEARN_WINDOW, LEARN_STRIDE = 96, 48
HIDDEN, STEPS, BATCH = 12, 600, 48
#: Training reads at most about this many windows, drawn by a hash from all windows of all texts.
SAMPLE = 6_000
#: Made-up lines, of which one in four only sets the limit, and the share of spans that must be right there.
LINES, PRECISION = 4_000, 0.97
SEED = 20240704

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match starts where its run of digits does, so looking no further back keeps long runs linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: What may be personal data though no base rule matches; windows with it are not learned from, since no one says what it is.
_UNSURE = re.compile(r"(?:[0-9][^0-9\n]{0,3}){7}|@|[(\[]at[)\]]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p) < 4 or int(p[-3:]) == int(p[-18:]) and not p[:-3].strip("0") for p in m.groups()) and all(int(p[-3:]) <= 255 for p in m.groups()):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0])) if m.end() - m.start() < 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by the base rules, sorted."""
    found = []
    for kind, (rule, sign) in enumerate(((_emails, "@"), (_ips, "."), (_cards, ""), (_phones, "+"))):
        if sign in text:
            found += [(a, kind, z) for a, z in rule(text)]
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


# Character classes: padding 0, digits, lower and upper case, other letters, white space, and signs by themselves.
_SIGNS = "@.-+()_%/:,;=\"'#*&|<>[]{}!?"
_CLASSES = 7 + len(_SIGNS)
_table = np.full(128, 6, np.uint8)
for _c in range(128):
    _s = chr(_c)
    _table[_c] = 1 if _s.isdigit() else 2 if _s.islower() else 3 if _s.isupper() else 5 if _s in "\t\n\x0b\x0c\r " else 7 + _SIGNS.index(_s) if _s in _SIGNS else 6


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _table[np.minimum(points, 127)], 4).astype(np.uint8)


def windows(text: str, window: int = WINDOW, stride: int = STRIDE) -> list[tuple[int, np.ndarray]]:
    """(start, character classes) of windows that cover the text; the last one ends with it."""
    c = classes(text)
    n = max(1, -(-(len(c) - (window - stride)) // stride))
    return [(at, c[at : at + window]) for at in range(0, n * stride, stride)]


TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def tags_of(spans: list[tuple[int, int, int]], start: int, window: int = LEARN_WINDOW) -> np.ndarray:
    tags = np.zeros(window, np.int64)
    for a, kind, z in spans:
        a, z = a - start, z - start
        if a < window and z > 0:
            tags[max(a, 0) : z] = 2 + 2 * kind
            if a >= 0:
                tags[a] = 1 + 2 * kind
    return tags


def _gate(x: np.ndarray) -> np.ndarray:
    """The hard sigmoid, which costs one pass."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _soft(x: np.ndarray) -> np.ndarray:
    """Softsign, several times as fast as the hyperbolic tangent; its slope is (1 - |y|)^2."""
    return x / (1 + np.abs(x))


_rooms: dict[str, np.ndarray] = {}


def _room(name: str, *shape: int) -> np.ndarray:
    """An array that keeps its memory from one call to the next; fresh pages cost as much as what is written to them."""
    size = int(np.prod(shape))
    if name not in _rooms or len(_rooms[name]) < size:
        _rooms[name] = np.empty(size, np.float32)
    return _rooms[name][:size].reshape(shape)


class Tagger:
    """The network: class embeddings folded into the gates, two LSTMs, a linear layer and CRF transitions."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.limit = 0.0
        self.p = {}
        for d in ("f", "b"):
            self.p[f"x{d}"] = rng.normal(0, 0.3, (_CLASSES, 4 * hidden)).astype(np.float32)
            self.p[f"x{d}"][:, hidden : 2 * hidden] += 1.0  # forget gates start open
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
        self.p["w"] = rng.normal(0, 0.1, (2 * hidden, TAGS)).astype(np.float32)
        self.p["c"] = np.zeros(TAGS, np.float32)
        self.p["t"] = np.zeros((TAGS, TAGS), np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, t, h = len(x), x.shape[1], self.h
        out = np.empty((t, n, h), np.float32)
        state, cell, trace = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = self.p[f"x{d}"][x[:, k]] + state @ self.p[f"u{d}"]
            gates = _gate(z[:, : 3 * h])  # input, forget, output
            new = _soft(z[:, 3 * h :])
            before, cell_before = state, cell
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            squashed = _soft(cell)
            state = gates[:, 2 * h :] * squashed
            out[k] = state
            if keep:
                trace.append((k, gates, new, squashed, before, cell_before))
        return out, trace

    def _back(self, x: np.ndarray, d: str, trace: list, dout: np.ndarray, g: dict) -> None:
        h, n = self.h, len(x)
        dstate, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        gx, gu, u = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"u{d}"]), self.p[f"u{d}"]
        for k, gates, new, squashed, before, cell_before in reversed(trace):
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            dh = dstate + dout[k]
            dc = dcell + dh * o * (1 - np.abs(squashed)) ** 2
            dz = np.hstack([np.hstack([dc * new, dc * cell_before, dh * squashed]) * (0.25 * ((gates > 0) & (gates < 1))), dc * i * (1 - np.abs(new)) ** 2])
            np.add.at(gx, x[:, k], dz)
            gu += before.T @ dz
            dstate, dcell = dz @ u.T, dc * f
        g[f"x{d}"], g[f"u{d}"] = gx, gu

    def emissions(self, x: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """(step, tag, window) scores.  Both directions run side by side, gates by rows; from a window's length on nothing is read.

        The gates' slope and shift are folded into the weights.
        """
        n, t, h = len(x), x.shape[1], self.h
        lengths = np.full(n, t) if lengths is None else lengths
        slope = np.concatenate([np.full(3 * h, 0.25, np.float32), np.ones(h, np.float32)])[:, None]
        shift = np.concatenate([np.full(3 * h, 0.5, np.float32), np.zeros(h, np.float32)])[:, None]
        table = [np.ascontiguousarray(self.p[f"x{d}"].T * slope + shift, np.float32) for d in "fb"]
        u = np.stack([np.ascontiguousarray(self.p[f"u{d}"].T * slope, np.float32) for d in "fb"])
        steps, whole = np.ascontiguousarray(x.T).astype(np.intp), int(lengths.min(initial=t))
        both, z, own, size = _room("both", t, 2 * h, n), _room("z", 2, 4 * h, n), _room("own", 2, 4 * h, n), _room("size", 2, h, n)
        state, cell = np.zeros((2, h, n), np.float32), np.zeros((2, h, n), np.float32)
        gates, new = z[:, : 3 * h], z[:, 3 * h :]
        for k in range(t):
            back = t - 1 - k
            np.take(table[0], steps[k], axis=1, out=own[0], mode="clip")
            np.take(table[1], steps[back], axis=1, out=own[1], mode="clip")
            np.matmul(u, state, out=z)
            z += own
            np.clip(gates, 0, 1, out=gates)
            np.abs(new, out=size)
            size += 1
            new /= size
            new *= gates[:, :h]
            cell *= gates[:, h : 2 * h]
            cell += new
            if back >= whole:  # the backward direction begins at each window's own end
                cell[1] *= lengths > back
            np.abs(cell, out=size)
            size += 1
            np.divide(cell, size, out=state)
            state *= gates[:, 2 * h :]
            both[k, :h], both[back, h:] = state
        scores = np.matmul(np.ascontiguousarray(self.p["w"].T), both, out=_room("scores", t, TAGS, n))
        scores += self.p["c"][:, None]
        return scores

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Of the mean negative log-likelihood of the tag paths ``y`` (window, step)."""
        n, t = x.shape
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        e = (both @ self.p["w"] + self.p["c"]).astype(np.float64)
        a = self.p["t"].astype(np.float64)

        def fold(v: np.ndarray, axis: int) -> np.ndarray:
            top = v.max(axis, keepdims=True)
            return np.log(np.exp(v - top).sum(axis)) + top.squeeze(axis)

        forward, backward = np.empty_like(e), np.zeros_like(e)
        forward[0] = e[0]
        for k in range(1, t):
            forward[k] = fold(forward[k - 1][:, :, None] + a, 1) + e[k]
        for k in range(t - 2, -1, -1):
            backward[k] = fold(a + (e[k + 1] + backward[k + 1])[:, None, :], 2)
        total = fold(forward[-1], 1)
        de = np.exp(forward + backward - total[:, None])
        steps, who = np.arange(t)[:, None], np.arange(n)
        de[steps, who, y.T] -= 1
        pair = np.exp(forward[:-1, :, :, None] + a + (e[1:] + backward[1:])[:, :, None, :] - total[:, None, None]).sum((0, 1))
        np.add.at(pair, (y[:, :-1], y[:, 1:]), -1)
        gold = e[steps, who, y.T].sum(0) + a[y[:, :-1], y[:, 1:]].sum(1)
        de = (de / n).astype(np.float32)
        g = {"t": pair / n, "c": de.sum((0, 1)), "w": np.einsum("tnh,tnk->hk", both, de)}
        dboth = de @ self.p["w"].T
        for k, d in enumerate("fb"):
            self._back(x, d, runs[d][1], dboth[..., k * self.h : (k + 1) * self.h], g)
        return g, float((total - gold).mean())

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> float:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v, np.float64) for k, v in self.p.items()}
        s = {k: np.zeros_like(v, np.float64) for k, v in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            who = rng.integers(0, len(x), BATCH)
            g, now = self.gradients(x[who], y[who])
            loss = now if step == 1 else 0.95 * loss + 0.05 * now
            norm = np.sqrt(sum(float((v.astype(np.float64) ** 2).sum()) for v in g.values()))
            rate = 0.02 * min(1, step / 20) * (1 - 0.95 * step / steps)
            for k, v in self.p.items():
                grad = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.99 * s[k] + 0.01 * grad**2
                v -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def decode(self, x: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
        """(start, kind, end, log-odds) of the spans in the best tag path of each window."""
        lengths = np.array([len(c) for c in x])
        padded = np.zeros((len(x), int(lengths.max(initial=0)) + 1), np.uint8)
        for row, c in zip(padded, x, strict=True):
            row[: len(c)] = c
        e, a = self.emissions(padded, lengths), self.p["t"]
        found: list[list] = [[] for _ in x]
        # No stretch of inside tags gains more than the best tag of each step with the best transitions; where no stretch gains
        # anything by that bound, staying outside is the best path.
        step, over = e[:, 1:].max(1) - e[:, 0], a - a[0, 0]
        step[np.arange(len(step))[:, None] >= lengths] = -1e4
        enter, stay, leave = np.float32(over[0, 1:].max()), np.float32(over[1:, 1:].max()), np.float32(over[1:, 0].max())
        stretch = np.full(len(x), -1e4, np.float32)
        most = stretch.copy()
        for now in step:
            stretch += stay
            np.maximum(stretch, enter, out=stretch)
            stretch += now
            np.maximum(most, stretch, out=most)
        some = np.flatnonzero(most + leave > -1e-3)
        if not len(some):
            return found
        e = np.ascontiguousarray(e[:, :, some].transpose(0, 2, 1))
        e[np.arange(len(e))[:, None] >= lengths[some]] = np.where(np.arange(TAGS) == 0, 0, -1e4)
        best, back = e[0], np.empty(e.shape, np.int8)
        for k in range(1, len(e)):
            through = best[:, :, None] + a
            back[k] = through.argmax(1)
            best = through.max(1) + e[k]
        path = np.empty((len(some), len(e)), np.int8)
        path[:, -1] = best.argmax(1)
        for k in range(len(e) - 1, 0, -1):
            path[:, k - 1] = back[k][np.arange(len(some)), path[:, k]]
        for w, i in enumerate(some.tolist()):
            tags = path[w, : lengths[i]]
            for start, kind, end in path_spans(tags) if tags.any() else ():
                steps = np.arange(start, end)
                odds = float((e[steps, w, tags[start:end]] - e[steps, w, 0]).sum())
                around = path[w, max(start - 1, 0) : end + 1].astype(int)
                without = around.copy()
                without[start - max(start - 1, 0) : start - max(start - 1, 0) + end - start] = 0
                odds += float(a[around[:-1], around[1:]].sum() - a[without[:-1], without[1:]].sum())
                found[i].append((start, kind, end, odds))
        return found


def path_spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs of one kind's tags in a path; a begin tag starts a new one."""
    found, open_at, kind = [], -1, -1
    for k, tag in enumerate([*path.tolist(), 0]):
        now = (tag - 1) // 2 if tag else -1
        if open_at >= 0 and (now != kind or tag % 2):
            found.append((open_at, kind, k))
            open_at = -1
        if tag and open_at < 0:
            open_at, kind = k, now
    return found


def within_limits(kind: int, span: str) -> bool:
    """The kinds' limits on numbers: four parts up to 255, 12 to 19 digits that pass Luhn, 9 to 15 digits."""
    digits = _DIGITS.findall(span)
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn("".join(digits))
    return kind != 3 or 9 <= len(digits) <= 15


def reconcile(text: str, found: list[tuple[int, int, list]], base: list[tuple[int, int, int]], limit: float) -> list[tuple[int, int, int]]:
    """Base spans and those of all windows (start, length, spans), sorted.  Of overlapping spans the one further from its window's edges stays, then the earlier."""
    n, offers = len(text), {}
    for at, length, spans in found:
        for a, kind, z, odds in spans:
            if odds < limit or (a == 0 and at > 0) or (z == length and at + z < n):
                continue  # unlikely, or cut by the edge, where the neighbouring window has it whole
            margin = min(a if at else WINDOW, length - z if at + length < n else WINDOW)
            a, z = at + a, at + z
            while a < z and text[z - 1] in " .,;:\n\t-":
                z -= 1
            while a < z and text[a] in " .,;:\n\t-":
                a += 1
            offers[a, kind, z] = max(margin, offers.get((a, kind, z), -1))
    taken = sorted((a, z, kind) for a, kind, z in base)  # they don't overlap the offers taken; base spans of several kinds may overlap each other
    reach = max((z - a for a, z, _ in taken), default=0)
    for a, kind, z in sorted(offers, key=lambda s: (-offers[s], s)):
        if a < z and within_limits(kind, text[a:z]):
            k = bisect_left(taken, (z,))
            while k and taken[k - 1][0] > a - reach and taken[k - 1][1] <= a:
                k -= 1
            if not k or taken[k - 1][1] <= a:
                taken.insert(bisect_left(taken, (a, z, kind)), (a, z, kind))
                reach = max(reach, z - a)
    return sorted((a, kind, z) for a, z, kind in taken)


def find(texts: list[str | None], tagger: Tagger, block: int = 512) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    found: list[list] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []

    def run(last: bool) -> None:
        """Windows of like length together, as they are padded."""
        held.sort(key=lambda w: len(w[2]))
        for at in range(0, len(held) if last else len(held) - len(held) % block, block):
            part = held[at : at + block]
            for (k, start, c), spans in zip(part, tagger.decode([w[2] for w in part]), strict=True):
                if spans:
                    found[k].append((start, len(c), spans))
        held.clear()

    for k, t in enumerate(texts):
        for start, c in windows(t) if t else ():
            held.append((k, start, c))
            if len(held) == 8 * block:
                run(False)
    run(True)
    return [(b, reconcile(t, f, b, tagger.limit) if f else b) for t, f, b in zip(texts, found, base, strict=True)]


def _made_up(rng: random.Random, context: list[str], word) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of context words with made-up spans of each kind, in forms that the base rules know and others, and look-alikes."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = rng.choice("3456") + digits(rng.choice([12, 14, 14, 14, 14]))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", "", " ", "-", ".", "/"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+{rng.choice(['1', '44', '49', '33'])} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0049 {a} {b}{c}", f"{a} {b} {c}"])

    def email() -> str:
        name, host = word(), word()
        if rng.random() < 0.35:  # spelled out, most without a digit
            at, dot = rng.choice([" (at) ", " [at] ", "(at)", "[at]", " @ "]), rng.choice([" (dot) ", " [dot] ", "(dot)", "[dot]", "."])
            return f"{name}{rng.choice(['', '.' + word(), '_' + word(), digits(2)])}{at}{host}{rng.choice(['', dot + word()])}{dot}{rng.choice(['com', 'org', 'net', 'example'])}"
        return rng.choice([f"{name}.{digits(2)}@{host}.example.com", f"{name}@{host}.org", f"{name}_{word()}@mail{digits(1)}.{host}.net", f"{name} @ {host}.com", f"{name}{digits(2)} (at) {host}.com", f"{name}@{host} .org"])

    def address() -> str:
        parts = [str(rng.randrange(256)) for _ in range(4)]
        return rng.choice([".", ".", ".", " . "]).join(parts)

    def none() -> str:
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        return rng.choice([f'token = "{hexes}"', "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16)), str(rng.randrange(1900, 2030)), digits(rng.randint(1, 8)), f"{digits(1)}.{digits(1)}", f"version {digits(1)}.{digits(1)}.{digits(1)}", f"@{word()}", f"{digits(2)}%", f"{digits(4)}-{digits(2)}-{digits(2)}", f"CC BY-NC {digits(1)}.{digits(1)}.", digits(rng.randint(20, 30)), f"{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}:{digits(2)}", f"{digits(2)}, {digits(2)}, {digits(3)}", f"({digits(4)})", f"({word()})", f"at {word()} dot"])

    line, spans = "", []
    for _ in range(rng.randint(1, 3)):
        line += " ".join(rng.choices(context, k=rng.randint(2, 7))) + rng.choice([" ", " ", ", ", "\n", ": "])
        kind = rng.randrange(6)
        made = (email, address, card, phone, none, none)[kind]()
        if kind < 4:
            spans.append((len(line), kind, len(line) + len(made)))
        line += made + rng.choice([" ", " ", ". ", ", ", "\n"])
    return line + " ".join(rng.choices(context, k=6)), spans


def limit_for(right: list[bool], odds: list[float], precision: float) -> float:
    """The least limit at which the share ``precision`` of the spans at or above it is right; infinite if there is none."""
    order = np.argsort(-np.array(odds, float), kind="stable")
    good = np.cumsum(np.array(right, bool)[order]) >= precision * np.arange(1, len(order) + 1)
    return float(odds[order[np.flatnonzero(good)[-1]]]) if good.any() else np.inf


def train(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Tagger:
    """A tagger fitted on labelled windows: made-up spans in the corpus's own words, and windows of the corpus labelled by the base rules.

    Every window of every text has the same chance, by a hash of the text and its place, and the driver reads about ``sample`` windows at
    most.  One line in four, made-up or not, is not trained on and sets the limit of the log-odds.
    """
    texts = docs.select(F.col("text").alias("t")).where("length(text) > 0")
    share = min(1.0, sample * LEARN_STRIDE / max(texts.agg(F.sum(F.length("t") + LEARN_STRIDE)).first()[0] or 0, 1))

    def picked():
        def step(x):
            out: dict[str, list] = {"part": [], "y": []}
            for t in x["t"]:
                salt = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                starts = np.arange(max(1, -(-(len(t) - LEARN_STRIDE) // LEARN_STRIDE)))
                h = np.random.default_rng(salt ^ SEED).random(len(starts))
                if (h < share).any():
                    base = base_spans(t)
                    unsure = [m.span() for m in _UNSURE.finditer(t) if all(m.end() <= a or z <= m.start() for a, _, z in base)]
                    for at in (np.flatnonzero(h < share) * LEARN_STRIDE).tolist():
                        if any(a < at + LEARN_WINDOW and at < z for a, z in unsure):
                            continue
                        out["part"].append(t[at : at + LEARN_WINDOW])
                        out["y"].append(tags_of(base, at).astype(np.int8).tobytes())
            return out

        return step

    rows = sorted({(r.part, bytes(r.y)) for r in common.arrow_pass(texts, picked, "part string, y binary").collect()}, key=lambda r: hashlib.md5(r[0].encode("utf-8", "surrogatepass") + r[1]).digest())
    rng = random.Random(SEED)
    context = sorted({w for part, _ in rows for w in part.split()[1:-1] if len(w) < 20 and not re.search("[0-9@]", w)}) or ["a", "word", "Text."]
    plain = sorted({w.lower() for w in context if w.isascii() and w.isalpha()})
    word = lambda: rng.choice(plain) if plain and rng.random() < 0.5 else "".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(3, 9)))
    x, y, unseen = [], [], []
    for k in range(LINES):
        line, spans = _made_up(rng, context, word)
        if k % 4 == 0:
            unseen.append((line, spans))
            continue
        for at, c in windows(line, LEARN_WINDOW, LEARN_STRIDE):
            x.append(np.pad(c, (0, LEARN_WINDOW - len(c))))
            y.append(tags_of(spans, at))
    for k, (part, tags) in enumerate(rows):
        got = np.frombuffer(tags, np.int8).astype(np.int64)
        if k % 4 == 0:
            if got[0] == got[len(part) - 1] == 0:
                unseen.append((part, path_spans(got)))
        else:
            x.append(np.pad(classes(part), (0, LEARN_WINDOW - len(part))))
            y.append(got)
    tagger = Tagger()
    tagger.fit(np.array(x), np.array(y), steps)
    right, odds = [], []
    for at in range(0, len(unseen), 256):
        part = unseen[at : at + 256]
        for (line, spans), got in zip(part, tagger.decode([classes(line) for line, _ in part]), strict=True):
            right += [g[:3] in spans for g in got if within_limits(g[1], line[g[0] : g[2]])]
            odds += [g[3] for g in got if within_limits(g[1], line[g[0] : g[2]])]
    tagger.limit = limit_for(right, odds, PRECISION)
    return tagger


def detect(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): the n_ columns count base spans, ``spans`` holds all.

    Null and empty texts have no spans; repeated rows are searched alike, null ids stay null, other columns are not looked at.
    """

    def make():
        def step(x):
            got = find(x["t"], tagger)
            counts = [[sum(s[1] == k for s in base) for base, _ in got] for k in range(len(KINDS))]
            digests = [hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in got]
            return {"doc_id": x["i"], **dict(zip((f"n_{k}" for k in KINDS), counts, strict=True)), "base_sha256": digests, "spans": [shown(s) for _, s in got], "n_added": [len(s) - len(b) for b, s in got]}

        return step

    return common.arrow_pass(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", 2_048)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: personal data in every document."""
    docs = common.table(spark, sf_dir, "documents")
    return detect(docs, train(docs))
