"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds spans.

The network is trained in numpy from labelled spans: those the patterns find in a bounded sample of
the corpus, disguised forms of them, and values set after words such as "token" (a fifth kind, secret,
which has no pattern among the fixed ones). It reads overlapping windows; the scores of windows that
overlap are averaged, and one Viterbi pass decodes each whole stretch of adjoining windows. Windows are
read where a digit, an ``@`` or a spelled-out "at" or "dot" stands, as every kind has one of these.
"""

from __future__ import annotations

import hashlib
import io
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, in_parts, text_or_empty

#: The kinds of the fixed patterns, and one that only the network finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STEP = 64, 32
EMBED, HIDDEN = 12, 20
#: The fit draws this many rows, the first by a hash of their id, and learns from those of them that hold a trigger.
FIT_ROWS = 4800
#: Triggers of a drawn text that the fit learns from, at most.
FIT_PIECES = 8
FIT_WINDOWS = 2400
#: Passes over the fitted texts at most, until there are so many windows.
FIT_PASSES = 60
#: Least mean probability of the decoded tags over a span that the network adds.
SURE = 0.9

#: An address in two parts: a run of these characters up to an at sign, and what follows the run.
_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match that starts inside a run of digits would start at its first digit too, so only these are tried.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|key)["']?\s*[:=]\s*["']?([A-Za-z0-9+/_.-]{16,})""")
#: A digit, an at sign, or "at" or "dot" in brackets or "dot" between spaces.
TRIGGER = r"[0-9@]|[\[({]\s*(?:at|dot)\s*[\])}]|\sdot\s"
_TRIGGER = re.compile(TRIGGER)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def addresses(text: str) -> list[tuple[int, int]]:
    """(start, end) of the leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in a time that grows with the text.

    What comes before an at sign is a whole run of its characters, or what an address before it left of the run.
    """
    out, free = [], 0
    for run in _RUN.finditer(text):
        start, at = max(run.start(), free), run.end()
        if start < at and text.startswith("@", at) and (domain := _DOMAIN.match(text, at)):
            free = domain.end()
            out.append((start, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start then kind; matches that fail their check are dropped."""
    if not _TRIGGER.search(text):
        return []
    out = [(s, 0, e) for s, e in addresses(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(g := x.lstrip("0")) <= 3 and int(g or 0) <= 255 for x in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def labelled_spans(text: str) -> list[tuple[int, int, int]]:
    """The patterns' spans and, apart from these, values set after words for secrets."""
    base = base_spans(text)
    more = [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)] if _TRIGGER.search(text) else []
    return sorted([x for x in base if not any(s < x[2] and x[0] < e for s, _, e in more)] + more)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- the network ---------------------------------------------------------------------------------

def codes(text: str) -> np.ndarray:
    """Characters as 0-127; others by a class: letters 128, anything else 129. 130 is padding."""
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(at < 128, at, np.where(at < 0x2000, 128, 129)).astype(np.int64)


PAD = 130


#: Multiplications of a matrix product up to which numpy's library starts no threads. Tasks share a machine's cores,
#: and threads that wait for each other made the fit ten times slower there.
ALONE = 1 << 18


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in blocks of rows that start no threads."""
    step = max(1, ALONE // max(1, b.size))
    if len(a) <= step:
        return a @ b
    return np.concatenate([a[i : i + step] @ b for i in range(0, len(a), step)])


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, summed over blocks of rows that start no threads."""
    step = max(1, ALONE // max(1, a.shape[1] * b.shape[1]))
    return sum(a[i : i + step].T @ b[i : i + step] for i in range(0, len(a), step))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(x, w, u, b):
    """x: (T, B, E) → hidden states (T, B, H) and what the backward pass needs."""
    steps, rows, hidden = len(x), x.shape[1], u.shape[0]
    h, c = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
    given = (_times(x.reshape(steps * rows, -1), w) + b).reshape(steps, rows, 4 * hidden)
    hs, gates, cells = np.empty((steps, rows, hidden), np.float32), np.empty((steps, rows, 4 * hidden), np.float32), np.empty((steps, rows, hidden), np.float32)
    for t in range(steps):
        z = given[t] + _times(h, u)
        g = gates[t]
        g[:, : 3 * hidden] = _sigmoid(z[:, : 3 * hidden])
        g[:, 3 * hidden :] = np.tanh(z[:, 3 * hidden :])
        c = g[:, hidden : 2 * hidden] * c + g[:, :hidden] * g[:, 3 * hidden :]
        h = g[:, 2 * hidden : 3 * hidden] * np.tanh(c)
        hs[t], cells[t] = h, c
    return hs, gates, cells


def _lstm_back(d_hs, x, hs, gates, cells, w, u):
    steps, rows, hidden = hs.shape
    dz = np.empty_like(gates)
    dh, dc = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[t][:, k * hidden : (k + 1) * hidden] for k in range(4))
        tc = np.tanh(cells[t])
        dh = dh + d_hs[t]
        dc = dc + dh * o * (1 - tc * tc)
        before = cells[t - 1] if t else np.zeros_like(dc)
        z = dz[t]
        z[:, :hidden] = dc * g * i * (1 - i)
        z[:, hidden : 2 * hidden] = dc * before * f * (1 - f)
        z[:, 2 * hidden : 3 * hidden] = dh * tc * o * (1 - o)
        z[:, 3 * hidden :] = dc * i * (1 - g * g)
        dc = dc * f
        dh = _times(z, u.T)
    flat = dz.reshape(steps * rows, -1)
    shifted = np.concatenate([np.zeros((1, rows, hidden), np.float32), hs[:-1]]).reshape(steps * rows, -1)
    return _times(flat, w.T).reshape(x.shape), _inner(x.reshape(steps * rows, -1), flat), _inner(shifted, flat), flat.sum(0)


def emissions(p: dict, chars: np.ndarray, keep: bool = False):
    """(B, T) characters → (T, B, TAGS) scores."""
    x = p["embed"][chars.T]
    fwd = _lstm(x, p["wf"], p["uf"], p["bf"])
    bwd = _lstm(x[::-1], p["wb"], p["ub"], p["bb"])
    both = np.concatenate([fwd[0], bwd[0][::-1]], axis=2)
    scores = (_times(both.reshape(-1, 2 * HIDDEN), p["out"]) + p["out_b"]).reshape(*both.shape[:2], TAGS)
    return (scores, x, fwd, bwd, both) if keep else scores


def _logsumexp(x, axis):
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf_gradient(scores: np.ndarray, tags: np.ndarray, trans: np.ndarray):
    """Negative log-likelihood of the tag paths and its gradients, by forward and backward sums."""
    steps, rows, n = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans[None], 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsumexp(trans[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _logsumexp(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - total[None, :, None])
    pair = np.zeros_like(trans)
    for t in range(1, steps):
        pair += np.exp(alpha[t - 1][:, :, None] + trans[None] + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
    at = np.arange(rows)
    gold = scores[0, at, tags[:, 0]].copy()
    d_scores[0, at, tags[:, 0]] -= 1
    for t in range(1, steps):
        gold += scores[t, at, tags[:, t]] + trans[tags[:, t - 1], tags[:, t]]
        d_scores[t, at, tags[:, t]] -= 1
        np.add.at(pair, (tags[:, t - 1], tags[:, t]), -1)
    return float((total - gold).mean()), d_scores / rows, pair / rows


def fit(chars: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 24, seed: int = 3) -> dict:
    """Adam over windows of characters with a tag each."""
    rng, f32 = np.random.default_rng(seed), np.float32
    init = lambda *shape: rng.normal(0, 1 / shape[0] ** 0.5, shape).astype(f32)
    bias = np.zeros(4 * HIDDEN, f32)
    bias[HIDDEN : 2 * HIDDEN] = 1
    p = {"embed": rng.normal(0, 0.4, (PAD + 1, EMBED)).astype(f32), "wf": init(EMBED, 4 * HIDDEN), "uf": init(HIDDEN, 4 * HIDDEN), "bf": bias.copy(), "wb": init(EMBED, 4 * HIDDEN), "ub": init(HIDDEN, 4 * HIDDEN), "bb": bias.copy(), "out": init(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, f32), "trans": np.zeros((TAGS, TAGS), f32)}
    p["out_b"][0] = 2
    for tag in range(1, TAGS):  # an inside follows its own begin or inside only
        if tag % 2 == 0:
            p["trans"][[k for k in range(TAGS) if k not in (tag, tag - 1)], tag] = -6
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs if len(chars) else 0):
        order = rng.permutation(len(chars))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            scores, x, fwd, bwd, both = emissions(p, chars[rows], keep=True)
            _, d, pair = crf_gradient(scores, tags[rows], p["trans"])
            d = d.astype(f32)
            flat = d.reshape(-1, TAGS)
            d_both = _times(flat, p["out"].T).reshape(*d.shape[:2], 2 * HIDDEN)
            dxf, gwf, guf, gbf = _lstm_back(np.ascontiguousarray(d_both[:, :, :HIDDEN]), x, *fwd, p["wf"], p["uf"])
            dxb, gwb, gub, gbb = _lstm_back(np.ascontiguousarray(d_both[::-1, :, HIDDEN:]), x[::-1], *bwd, p["wb"], p["ub"])
            d_embed = np.zeros_like(p["embed"])
            np.add.at(d_embed, chars[rows].T.ravel(), (dxf + dxb[::-1]).reshape(-1, EMBED))
            g = {"embed": d_embed, "wf": gwf, "uf": guf, "bf": gbf, "wb": gwb, "ub": gub, "bb": gbb, "out": _inner(both.reshape(-1, 2 * HIDDEN), flat), "out_b": flat.sum(0), "trans": pair.astype(f32)}
            size = sum(float((q * q).sum()) for q in g.values()) ** 0.5
            step += 1
            for k, q in p.items():
                e = g[k] * min(1.0, 5 / max(size, 1e-9))
                m[k] += 0.1 * (e - m[k])
                v[k] += 0.001 * (e * e - v[k])
                q -= (0.015 * (1 - epoch / (epochs + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(f32)
    return p


def marginals(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """(T, TAGS) probabilities of each tag at each place under the CRF."""
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, len(scores)):
        alpha[t] = _logsumexp(alpha[t - 1][:, None] + trans, 0) + scores[t]
    for t in range(len(scores) - 2, -1, -1):
        beta[t] = _logsumexp(trans + scores[t + 1] + beta[t + 1], 1)
    both = alpha + beta
    return np.exp(both - _logsumexp(both, 1)[:, None])


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tag path through (T, TAGS) scores."""
    back = np.empty(scores.shape, np.int64)
    best = scores[0]
    for t in range(1, len(scores)):
        step = best[:, None] + trans
        back[t] = step.argmax(0)
        best = step.max(0) + scores[t]
    path = np.empty(len(scores), np.int64)
    path[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


# --- training data -------------------------------------------------------------------------------

def disguised(kind: int, value: str, rng: random.Random) -> str:
    """A form of a span that the patterns miss."""
    digits = _digits(value)
    if kind == 0:
        user, _, host = value.partition("@")
        spelled = host.replace(".", " dot ")
        return rng.choice([f"{user} @ {host}", f"{user}[at]{host}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user} (at) {host}", f"{user} at {spelled}", f"{user}@{host.replace('.', ' . ')}", f"{user}@{host.replace('.', '[.]')}"])
    if kind == 4:
        return value
    if kind == 1:
        return value.replace(".", rng.choice(["[.]", " . ", "(.)"]))
    if kind == 2:
        return rng.choice([".", "/", "_"]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    d = digits[-10:].rjust(10, "5")
    return rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{digits[:1]} {d[:3]} {d[3:6]} {d[6:]}"])


def redrawn(kind: int, value: str, rng: random.Random) -> str:
    """A value of the same form with other digits; a secret is drawn anew, often as hex digits."""
    if kind == 4:
        of = rng.choice(["0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
        return "".join(rng.choice(of) for _ in range(len(value) if rng.random() < 0.6 else rng.randrange(20, 48)))
    return "".join(rng.choice("0123456789") if c in "0123456789" else c for c in value)


def decoy(rng: random.Random) -> str:
    """Digits that are no personal data: years, amounts, times, versions, ordinals."""
    n = rng.randrange
    return rng.choice([f" {n(1900, 2030)} ", f" {n(1, 200)} ", f" {n(1, 99)}.{n(10)} ", f" {n(1, 24)}:{n(10, 60)} ", f" {n(1, 10)},{n(100, 999)} ", f" v{n(1, 9)}.{n(20)}.{n(20)} ", f" {n(1, 99)}-{n(1, 99)} ", f" {n(2000, 2030)}-{n(10, 13)}-{n(10, 29)} ", " @ ", " dot ", " (at) ", f" {n(10**6)} "])


def training_windows(texts: list[str], limit: int = FIT_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of characters and tags around the triggers of the texts, gone through until ``limit`` windows are made.

    On each pass the digits of every span are drawn anew, half of the spans are disguised, and decoys are put between words.
    """
    rng, chars, tags = random.Random(seed), [], []
    known = [(t, s) for t in texts if (s := labelled_spans(t))]
    for turn in range(FIT_PASSES):
        for text, spans in known if turn else [(t, labelled_spans(t)) for t in texts]:
            pieces, at, marks, n = [], 0, [], 0
            for s, k, e in spans:
                if s < at:
                    continue
                value = redrawn(k, text[s:e], rng)
                value = value if rng.random() < 0.5 else disguised(k, value, rng)
                before = text[at:s] if rng.random() < 0.6 else decoy(rng).join(text[at:s].rsplit(" ", rng.randrange(1, 3)))
                pieces += [before, value]
                n += len(before)
                marks.append((n, k, n + len(value)))
                n, at = n + len(value), e
            made = "".join([*pieces, text[at:], decoy(rng) if rng.random() < 0.3 else ""])
            tag = np.zeros(len(made), np.int64)
            for s, k, e in marks:
                tag[s:e] = 2 * k + 2
                tag[s] = 2 * k + 1
            code, seen = codes(made), -1
            for m in _TRIGGER.finditer(made):
                if m.start() < seen:
                    continue
                start = max(0, m.start() - rng.randrange(WINDOW - 8))
                seen = start + WINDOW
                c, t = np.full(WINDOW, PAD), np.zeros(WINDOW, np.int64)
                c[: len(code[start:seen])], t[: len(tag[start:seen])] = code[start:seen], tag[start:seen]
                chars.append(c)
                tags.append(t)
                if len(chars) >= limit:
                    return np.array(chars), np.array(tags)
        if not known:
            break
    return np.array(chars).reshape(-1, WINDOW), np.array(tags).reshape(-1, WINDOW)


# --- scanning ------------------------------------------------------------------------------------

def window_starts(text: str) -> list[int]:
    """Starts of the windows, one every STEP characters, that hold a trigger character."""
    last, out = -1, []
    for m in _TRIGGER.finditer(text):
        for k in range(max(0, (m.start() - WINDOW) // STEP + 1, last + 1), m.start() // STEP + 1):
            out.append(k * STEP)
            last = k
    return out


def network_spans(p: dict, texts: list[str], known: list[list[tuple[int, int, int]]], block: int = 512) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the network finds in each text apart from its ``known`` spans.

    Overlapping windows are reconciled over the whole text: their scores are averaged, and every
    stretch of adjoining windows is decoded in one pass.
    """
    plan = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    coded: dict[int, np.ndarray] = {}
    stretch: list = []  # (text, start of the stretch, summed scores, number of windows)

    def decode():
        if not stretch:
            return
        i, start, total, count = stretch
        scores = total / np.maximum(count, 1)[:, None]
        n = min(len(scores), len(texts[i]) - start)
        scores = scores[:n]
        path = viterbi(scores, p["trans"])
        prob, s = None, 0
        while s < n:
            if path[s] == 0:
                s += 1
                continue
            kind, e = (path[s] - 1) // 2, s + 1
            while e < n and path[e] == 2 * kind + 2:
                e += 1
            free = all(start + e <= x[0] or start + s >= x[2] for x in known[i])
            if free and plausible(int(kind), texts[i][start + s : start + e]):
                prob = marginals(scores, p["trans"])[np.arange(n), path] if prob is None else prob
                if prob[s:e].mean() >= SURE:
                    out[i].append((start + s, int(kind), start + e))
            s = e
        stretch.clear()

    for b in range(0, len(plan), block):
        part = plan[b : b + block]
        chars = np.full((len(part), WINDOW), PAD, np.int64)
        for r, (i, s) in enumerate(part):
            if i not in coded:
                coded = {i: codes(texts[i])}
            piece = coded[i][s : s + WINDOW]
            chars[r, : len(piece)] = piece
        scores = emissions(p, chars).transpose(1, 0, 2)
        for r, (i, s) in enumerate(part):
            if not stretch or stretch[0] != i or s > stretch[1] + len(stretch[2]):
                decode()
                stretch[:] = [i, s, np.zeros((WINDOW, TAGS), np.float32), np.zeros(WINDOW, np.int64)]
            more = s + WINDOW - stretch[1] - len(stretch[2])
            if more > 0:
                stretch[2] = np.concatenate([stretch[2], np.zeros((more, TAGS), np.float32)])
                stretch[3] = np.concatenate([stretch[3], np.zeros(more, np.int64)])
            at = s - stretch[1]
            stretch[2][at : at + WINDOW] += scores[r]
            stretch[3][at : at + WINDOW] += 1
    decode()
    return out


def plausible(kind: int, value: str) -> bool:
    """Whether a span that the network proposes has the bones of its kind."""
    n = len(_digits(value))
    if value != value.strip() or "\n" in value:
        return False
    if kind == 0:
        return len(value) >= 6 and ("@" in value or re.search(r"(?i)\bat\b", value) is not None)
    if kind == 4:
        return len(value) >= 16 and n >= 3 and not any(c.isspace() for c in value)
    return (4 <= n <= 12, 12 <= n <= 19, 7 <= n <= 15)[kind - 1] and not any(c.isalpha() for c in value)


def find_spans(df: DataFrame, network: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Returns (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans): counts and digest of
    the patterns' spans, and all spans as kind:start:end, the network's where they overlap none of
    the patterns', and their number. Null and empty texts have none; ids may repeat or be null.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(it):
            texts = [t.as_py() for t in b.column(1)]
            rows = [base_spans(t) for t in texts]
            shows, counts, totals = [], [], []
            for base, more in zip(rows, network_spans(network, texts, rows), strict=True):
                shows.append((shown(base), shown(sorted(base + more))))
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(BASE_KINDS))])
                totals.append(len(base) + len(more))
            table = np.array(counts, np.int64).reshape(-1, len(BASE_KINDS))
            yield pa.RecordBatch.from_pydict({
                "id": b.column(0), **{f"n_{k}": pa.array(table[:, j]) for j, k in enumerate(BASE_KINDS)},
                "base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _ in shows], pa.string()),
                "spans": pa.array([y for _, y in shows], pa.string()), "n_spans": pa.array(totals, pa.int64()),
            })

    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(batches, schema)


def pieces_of(text: str, most: int = FIT_PIECES) -> list[str]:
    """The surroundings of a text's first triggers, apart from each other."""
    out, at = [], 0
    for m in _TRIGGER.finditer(text):
        if m.start() >= at:
            at = m.end() + 96
            out.append(text[max(0, m.start() - 64) : at])
            if len(out) == most:
                break
    return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> dict:
    """Fit on pieces around the triggers of at most ``rows`` texts, the first by a hash of their id.

    The ids are drawn first, so that neither the scan for triggers nor what reaches the driver grows
    with the corpus: a task sends the pieces of drawn texts only.
    """
    drawn = df.select(F.col(id_col).alias("_drawn")).where("_drawn IS NOT NULL").orderBy(F.xxhash64("_drawn"), "_drawn").limit(rows).distinct()
    texts = df.join(F.broadcast(drawn), F.col(id_col) == F.col("_drawn")).select(F.col("_drawn").alias("i"), text_or_empty(text_col).alias("t"))  # ``rows`` ids

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces_of(t.as_py()) for t in b.column(1)], pa.list_(pa.string()))], ["i", "p"])

    kind = dict(texts.dtypes)["i"]
    sample = texts.mapInArrow(cut, f"i {kind}, p array<string>").where(F.size("p") > 0).orderBy(F.xxhash64("i"), "i", "p").limit(rows).select("p").coalesce(1)

    def learned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for b in it for row in b.column(0).to_pylist() for x in row]
        out = io.BytesIO()
        np.savez(out, **fit(*training_windows(found)))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["network"])

    # The sample is bounded, so one task fits it; what comes back are the weights.
    made = np.load(io.BytesIO(bytes(sample.mapInArrow(learned, "network binary").first().network)))
    return {k: made[k] for k in made.files}


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every document."""
    docs = documents(spark, sf_dir)
    return find_spans(docs, train(docs)).withColumnRenamed("id", "doc_id")
