"""A character-level bidirectional LSTM with CRF transitions, in numpy: decoding and training.

A character is an index into ``ALPHABET``; digits share one symbol, letters lose their marks and everything else that
isn't listed shares one symbol, so that texts of the same shape are the same input. The table of each direction maps a
character straight to the four gates (an embedding and its input weights multiplied out). Spans are runs of one tag.
"""

from __future__ import annotations

import io
import unicodedata
from importlib.resources import files
from pathlib import Path

import numpy as np

TAGS = ("O", "email", "phone", "id_number", "address", "name")
K = len(TAGS)
ALPHABET = "\0\1" + "0abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + " .,;:!?-_/()[]{}<>@&#%+*=~|'\"$^º·\n"
OTHER = 1
MODEL = Path(__file__).with_name("pii_model.npz")


class _Symbols(dict):
    """Code point to code point of its symbol, filled on demand."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        if c.isdigit():
            out = "0"
        elif c in ALPHABET:
            out = c
        else:
            base = unicodedata.normalize("NFKD", c)[0]
            out = base if base in ALPHABET and base.isalpha() else " " if c.isspace() else "a" if c.islower() else "A" if c.isalpha() else "\1"
        self[point] = ord(out)
        return self[point]


SYMBOLS = _Symbols()
INDEX = np.full(256, OTHER, np.int16)
for _i, _c in enumerate(ALPHABET):
    INDEX[ord(_c)] = _i


def shape(text: str) -> str:
    """The text in symbols, of the same length."""
    return text.translate(SYMBOLS)


def codes(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows, already in symbols, as indices filled up with 0, and their lengths."""
    lengths = np.array([len(w) for w in windows])
    x = np.zeros((len(windows), lengths.max()), np.int16)
    flat = INDEX[np.frombuffer("".join(windows).encode("latin-1"), np.uint8)]
    x[np.arange(x.shape[1])[None, :] < lengths[:, None]] = flat
    return x, lengths


def turn(lengths: np.ndarray, width: int) -> np.ndarray:
    """For each row the positions in reverse order, those of the filling in place."""
    at = np.arange(width)[None, :]
    return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)


def new_model(hidden: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    m = {}
    for d in "fb":
        m[f"T{d}"] = (rng.normal(size=(len(ALPHABET), 4 * hidden)) * 0.3).astype(np.float32)
        m[f"T{d}"][:, hidden : 2 * hidden] += 0.5  # gates that remember, at first
        m[f"U{d}"] = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
    m["W"] = (rng.normal(size=(2 * hidden, K)) / np.sqrt(2 * hidden)).astype(np.float32)
    m["c"] = np.zeros(K, np.float32)
    m["A"] = (np.eye(K) * 1.0).astype(np.float32)
    m["s"] = np.zeros(K, np.float32)
    m["e"] = np.zeros(K, np.float32)
    return m


def load() -> dict[str, np.ndarray]:
    """The trained network; the package may be an archive on a worker."""
    with np.load(io.BytesIO(files(__package__).joinpath(MODEL.name).read_bytes())) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def _direction(table: np.ndarray, u: np.ndarray, x: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states, time first. The first three gates go through tanh of half, so one call does for all four."""
    n, width = x.shape
    hidden = u.shape[0]
    half = np.ones(4 * hidden, np.float32)
    half[: 3 * hidden] = 0.5
    table, u = table * half, u * half
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    out = np.empty((width, n, hidden), np.float32)
    for t in range(width):
        z = table[x[:, t]]
        z += h @ u
        np.tanh(z, out=z)
        gates = z[:, : 3 * hidden]
        gates *= 0.5
        gates += 0.5
        before = c
        c = z[:, hidden : 2 * hidden] * c
        c += z[:, :hidden] * z[:, 3 * hidden :]
        q = np.tanh(c)
        h = z[:, 2 * hidden : 3 * hidden] * q
        out[t] = h
        if keep is not None:
            keep.append((z, before, q))
    return out


def emissions(m: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """(row, position, tag)."""
    n, width = x.shape
    back = turn(lengths, width)
    f, b = [], []
    hf = _direction(m["Tf"], m["Uf"], x, f if keep is not None else None).transpose(1, 0, 2)
    hb = _direction(m["Tb"], m["Ub"], np.take_along_axis(x, back, 1), b if keep is not None else None).transpose(1, 0, 2)
    hb = hb[np.arange(n)[:, None], back]
    h = np.concatenate([hf, hb], 2)
    if keep is not None:
        keep.update(h=h, f=f, b=b, back=back)
    return h @ m["W"] + m["c"]


class Decoder:
    """The network laid out for decoding: gates apart, so that every step works on whole blocks of memory."""

    def __init__(self, m: dict[str, np.ndarray]) -> None:
        self.m, hidden = m, m["Uf"].shape[0]
        half = np.array([0.5, 0.5, 0.5, 1], np.float32)[:, None, None]
        apart = lambda v: np.ascontiguousarray(v.reshape(len(v), 4, hidden).transpose(1, 0, 2) * half)
        self.tables, self.hidden = {d: (apart(m[f"T{d}"]), apart(m[f"U{d}"])) for d in "fb"}, hidden
        slack = max(m["A"].max() - m["A"][0, 0], m["s"].max() - m["s"][0], m["e"].max() - m["e"][0], 0)
        self.margin = 3 * float(slack)

    def states(self, d: str, x: np.ndarray) -> np.ndarray:
        (table, u), (n, width), hidden = self.tables[d], x.shape, self.hidden
        h, c, q = (np.zeros((n, hidden), np.float32) for _ in range(3))
        z, out, columns = np.empty((4, n, hidden), np.float32), np.empty((width, n, hidden), np.float32), np.ascontiguousarray(x.T)
        for t in range(width):
            np.matmul(h, u, out=z)
            z += table.take(columns[t], 1)
            np.tanh(z, out=z)
            gates = z[:3]
            gates += 1
            gates *= 0.5
            c *= z[1]
            np.multiply(z[0], z[3], out=q)
            c += q
            np.tanh(c, out=q)
            h = np.multiply(z[2], q, out=out[t])
        return out

    def emissions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """As ``emissions`` of the module: (row, position, tag)."""
        n, width = x.shape
        back = turn(lengths, width)
        w = self.m["W"]
        ef = (self.states("f", x).reshape(-1, self.hidden) @ w[: self.hidden]).reshape(width, n, K).transpose(1, 0, 2)
        eb = (self.states("b", np.take_along_axis(x, back, 1)).reshape(-1, self.hidden) @ w[self.hidden :]).reshape(width, n, K).transpose(1, 0, 2)
        return ef + eb[np.arange(n)[:, None], back] + self.m["c"]

    def tags(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags. Where O leads by ``margin`` at every character no other path can win: a run of r other tags
        gains at most the slack of r + 2 transitions, which is no more than 3 r times it."""
        e = self.emissions(x, lengths)
        lead = e[:, :, 0] - e[:, :, 1:].max(2)
        lead[np.arange(x.shape[1])[None, :] >= lengths[:, None]] = np.inf
        open_rows = np.flatnonzero(lead.min(1) <= self.margin)
        out = np.zeros(x.shape, np.int8)
        if len(open_rows):
            out[open_rows] = viterbi(self.m, e[open_rows], lengths[open_rows])
        return out


def viterbi(m: dict[str, np.ndarray], e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best tag of each position of each row."""
    n, width, _ = e.shape
    best = m["s"] + e[:, 0]
    came = np.zeros((width, n, K), np.int8)
    at = np.arange(n)
    for t in range(1, width):
        paths = best[:, :, None] + m["A"]
        k = paths.argmax(1)
        came[t] = k
        new = np.take_along_axis(paths, k[:, None, :], 1)[:, 0] + e[:, t]
        best = np.where((t < lengths)[:, None], new, best)
    tags = np.zeros((n, width), np.int8)
    now = (best + m["e"]).argmax(1)
    for t in range(width - 1, -1, -1):
        inside = t < lengths
        tags[inside, t] = now[inside]
        if t:
            now = np.where(inside, came[t, at, now], now)
    return tags


def spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of the runs of tags, counted from 0, the end not included."""
    cuts = np.flatnonzero(np.diff(tags)) + 1
    edges = [0, *cuts.tolist(), len(tags)]
    return [(a, b, TAGS[tags[a]]) for a, b in zip(edges, edges[1:]) if tags[a]]


def gradients(m: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean negative log-likelihood of the gold tags and its gradients."""
    keep: dict = {}
    e = emissions(m, x, lengths, keep).astype(np.float64)
    n, width, _ = e.shape
    inside = np.arange(width)[None, :] < lengths[:, None]
    a, rows, last = m["A"].astype(np.float64), np.arange(n), lengths - 1
    lse = lambda v, axis: (top := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - top).sum(axis))
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[:, 0] = m["s"] + e[:, 0]
    for t in range(1, width):
        alpha[:, t] = np.where(inside[:, t, None], lse(alpha[:, t - 1, :, None] + a, 1) + e[:, t], alpha[:, t - 1])
    beta[:, -1] = m["e"]
    for t in range(width - 2, -1, -1):
        beta[:, t] = np.where(inside[:, t + 1, None], lse(a[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), m["e"])
    z = lse(alpha[:, -1] + m["e"], 1)
    marginal = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
    onehot = np.eye(K)[gold] * inside[..., None]
    step = inside[:, 1:]
    score = (e * onehot).sum((1, 2)) + (a[gold[:, :-1], gold[:, 1:]] * step).sum(1) + m["s"][gold[:, 0]] + m["e"][gold[rows, last]]
    pair = np.exp(np.clip(alpha[:, :-1, :, None] + a + (e + beta)[:, 1:, None, :] - z[:, None, None, None], -60, 0)) * step[..., None, None]
    seen = np.zeros((K, K))
    np.add.at(seen, (gold[:, :-1][step], gold[:, 1:][step]), 1)
    de = ((marginal - onehot) / n).astype(np.float32)
    g = {"A": (pair.sum((0, 1)) - seen) / n, "s": (marginal[:, 0] - onehot[:, 0]).sum(0) / n, "e": (marginal[rows, last] - onehot[rows, last]).sum(0) / n}
    g["W"], g["c"] = np.einsum("nth,ntk->hk", keep["h"], de), de.sum((0, 1))
    dh = de @ m["W"].T
    hidden = m["Uf"].shape[0]
    for d, part in (("f", dh[..., :hidden]), ("b", dh[..., hidden:][np.arange(n)[:, None], keep["back"]])):
        xs = x if d == "f" else np.take_along_axis(x, keep["back"], 1)
        u, gt, gu = m[f"U{d}"], np.zeros_like(m[f"T{d}"]), np.zeros_like(m[f"U{d}"])
        hn, cn = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        steps = keep[d]
        for t in range(width - 1, -1, -1):
            zt, before, q = steps[t]
            i, f, o, c = (zt[:, k * hidden : (k + 1) * hidden] for k in range(4))
            hn = hn + part[:, t]
            cn = cn + hn * o * (1 - q * q)
            dz = np.concatenate([cn * c * i * (1 - i), cn * before * f * (1 - f), hn * q * o * (1 - o), cn * i * (1 - c * c)], 1)
            dz *= inside[:, t, None]
            cn = np.where(inside[:, t, None], cn * f, cn)
            np.add.at(gt, xs[:, t], dz)
            if t:
                gu += (steps[t - 1][0][:, 2 * hidden : 3 * hidden] * steps[t - 1][2]).T @ dz
            hn = np.where(inside[:, t, None], dz @ u.T, 0).astype(np.float32)
        g[f"T{d}"], g[f"U{d}"] = gt, gu
    return float((z - score).mean()), g


def train(windows: list[str], tags: list[np.ndarray], hidden: int = 32, epochs: int = 8, batch: int = 192, rate: float = 0.012, seed: int = 0, say=print) -> dict[str, np.ndarray]:
    """Adam over batches of windows of like length."""
    rng = np.random.default_rng(seed)
    m = new_model(hidden, seed)
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    order = np.argsort([len(w) for w in windows], kind="stable")
    batches = [order[k : k + batch] for k in range(0, len(order), batch)]
    total = epochs * len(batches)
    for epoch in range(epochs):
        loss = []
        for k in rng.permutation(len(batches)):
            x, lengths = codes([windows[i] for i in batches[k]])
            gold = np.zeros(x.shape, np.int64)
            for r, i in enumerate(batches[k]):
                gold[r, : lengths[r]] = tags[i]
            value, g = gradients(m, x, lengths, gold)
            loss.append(value)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            lr = rate * min(1, step / 50) * (0.05 + 0.95 * (1 - step / total))
            for p, v in g.items():
                v = np.asarray(v, np.float32) * min(1.0, 5.0 / (norm + 1e-9))
                first[p] = 0.9 * first[p] + 0.1 * v
                second[p] = 0.999 * second[p] + 0.001 * v * v
                m[p] -= lr * (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.999**step)) + 1e-8)
        say(f"epoch {epoch + 1}: loss {np.mean(loss):.4f}")
    return m
