"""A byte-level BPE tokenizer compiled into deterministic transducers whose transitions carry counts of emitted tokens.

Two transducers in a row. The first reads classes of characters and marks where a piece (a word with
its space, a run of digits, of marks or of white space, a contraction) starts; it has twelve states,
so what a chunk of text does to every state is a map of twelve bytes. The second reads the bytes of
a piece and adds, with each, by how many tokens the encoding of the piece read so far grows (this
may be negative: merges reach back).

The second is made from this property of BPE with every token made by one merge, later than those of
its parts: a sequence of tokens is the encoding of its bytes exactly if no two neighbours would have
been merged across their border. So a nondeterministic reader that guesses where the last token
starts needs to know the token before it and the count there, and nothing else. Its subsets are the
states; they are made when first met, and there are finitely many as tokens have bounded length.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np

#: Classes of characters, as the first transducer reads them.
END, SPACE, WHITE, LETTER, DIGIT, MARK, QUOTE, STMD, RV, E, L = range(11)
#: Its states: what the character before belongs to. ONE: a single white space, RUN: a longer run; _S: the last is a space.
START, WORD, NUMBER, MARKS, ONE_S, ONE_W, RUN_S, RUN_W, AFTER_QUOTE, QUOTE_RV, QUOTE_L, DONE = range(12)
#: What a transition says: a piece starts at this character, or at the one before.
HERE, BEFORE = 1, 2
STATES = 12


def _plain(cls: int, joined: bool) -> int:
    """The state after a character that starts a piece, or goes on after a space (``joined``)."""
    if cls in (LETTER, STMD, RV, E, L):
        return WORD
    if cls == DIGIT:
        return NUMBER
    if cls == QUOTE:
        return MARKS if joined else AFTER_QUOTE
    return {MARK: MARKS, SPACE: ONE_S, WHITE: ONE_W, END: START}[cls]


def _step(state: int, cls: int) -> tuple[int, int]:
    """The next state and what the transition says."""
    if cls == END:
        return START, BEFORE if state in (QUOTE_RV, QUOTE_L) else 0
    fresh = _plain(cls, False), HERE
    white = cls in (SPACE, WHITE)
    if state in (ONE_S, ONE_W, RUN_S, RUN_W):
        if white:
            return (RUN_S if cls == SPACE else RUN_W), 0
        says = BEFORE if state in (RUN_S, RUN_W) else 0  # all but the last of a run are a piece of their own
        if state in (ONE_S, RUN_S):
            return _plain(cls, True), says
        return fresh[0], says | HERE
    word = cls in (LETTER, STMD, RV, E, L)
    if state == WORD:
        return (WORD, 0) if word else fresh
    if state == NUMBER:
        return (NUMBER, 0) if cls == DIGIT else fresh
    if state == MARKS:
        return (MARKS, 0) if cls in (MARK, QUOTE) else fresh
    if state == AFTER_QUOTE:
        if cls == STMD:
            return DONE, 0
        if cls in (RV, L):
            return (QUOTE_RV if cls == RV else QUOTE_L), 0
        return (MARKS, 0) if cls in (MARK, QUOTE) else fresh
    if state in (QUOTE_RV, QUOTE_L):
        if cls == (E if state == QUOTE_RV else L):
            return DONE, 0
        return (WORD, BEFORE) if word else (fresh[0], BEFORE | HERE)  # no contraction: the letter starts a word
    return fresh  # START, DONE


@lru_cache(maxsize=1)
def boundary_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next states and what is said, at state * 16 + class."""
    to, says = np.zeros(STATES * 16, np.uint8), np.zeros(STATES * 16, np.uint8)
    for s in range(STATES):
        for c in range(11):
            to[s * 16 + c], says[s * 16 + c] = _step(s, c)
    return to, says


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point; one past the last is END."""
    table = np.full(sys.maxunicode + 2, MARK, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else DIGIT
    #: The code points of Unicode's property White_Space.
    table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    table[32] = SPACE
    for chars, cls in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        table[[ord(c) for c in chars]] = cls
    table[sys.maxunicode + 1] = END
    return table


def piece_starts(classes: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Where pieces start (true per character), for any number of texts with an END after each.

    Every chunk is read from all states at once, which gives its state map; the maps are composed by
    a parallel prefix scan, and each chunk is read once more from the state that the scan tells.
    """
    to, says = boundary_tables()
    n = len(classes)
    lanes = -(-n // chunk)
    grid = np.full(lanes * chunk, END, np.uint8)
    grid[:n] = classes
    columns = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], lanes, 1)
    for column in columns:
        maps = to[(maps << 4) | column]
    state = np.empty(lanes, np.uint8)
    state[0], state[1:] = START, prefix_scan(maps)[START, :-1]
    starts = np.zeros(lanes * chunk + 1, bool)
    said = np.empty((chunk, lanes), np.uint8)
    for k, column in enumerate(columns):
        at = (state << 4) | column
        said[k] = says[at]
        state = to[at]
    said = said.T.reshape(-1)
    starts[:-1] = said & HERE
    starts[:-2] |= (said[1:] & BEFORE) != 0
    return starts[:n]


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """``maps[:, i]`` composed with all maps before it, in log2(n) rounds."""
    maps, step, n = maps.copy(), 1, maps.shape[1]
    while step < n:
        # first the map that ends ``step`` columns before, then this one
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), 0)
        step *= 2
    return maps


def byte_letters() -> dict[str, int]:
    """The printable letter by which a byte-level vocabulary names each byte: printable bytes name themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class CountTransducer:
    """The second transducer. ``count(pieces)`` gives the tokens of each piece."""

    #: States kept; beyond, the table starts anew, so its memory is bounded whatever the texts.
    STATES_KEPT = 120_000
    #: Below so many tokens, a guess is told apart by the tokens it can still end in, not by the token before it.
    NARROW = 24

    def __init__(self, path: str, states_kept: int = STATES_KEPT):
        spec = json.load(open(path, encoding="utf-8"))
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is compiled")
        if model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("dropout and ignored merges are not compiled")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", ())):
            raise ValueError("added tokens that take white space or whole words only are not compiled")
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        letters = byte_letters()
        self.text, self.rank, self.parts, self.merge = [], [], [], {}
        ids: dict[bytes, int] = {}
        for letter in model["vocab"]:
            if len(letter) == 1:
                ids[bytes([letters[letter]])] = len(self.text)
                self.text.append(bytes([letters[letter]]))
                self.rank.append(-1)
                self.parts.append(None)
        if len(ids) != 256:
            raise ValueError("a vocabulary without all bytes is not compiled")
        for r, pair in enumerate(model["merges"]):
            left, right = (bytes(letters[c] for c in side) for side in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = left + right
            if whole in ids or left not in ids or right not in ids:
                raise ValueError(f"merge {r} does not make a new token of tokens made before")
            self.merge[ids[left], ids[right]] = r
            self.parts.append((ids[left], ids[right]))
            ids[whole] = len(self.text)
            self.text.append(whole)
            self.rank.append(r)
        self._trie()
        self.states_kept = states_kept
        self._reset()

    def _trie(self) -> None:
        """Nodes by number; each knows its token and which slice of the tokens in byte order begins with it."""
        self.child: dict[int, int] = {}
        self.token, self.low, self.high = [-1], [0], [len(self.text)]
        self.sorted = sorted(range(len(self.text)), key=self.text.__getitem__)
        for k, t in enumerate(self.sorted):
            node = 0
            for b in self.text[t]:
                key = node << 8 | b
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.low.append(k)
                    self.high.append(k)
                self.high[node] = k + 1
            self.token[node] = t

    def apart(self, u: int, v: int) -> bool:
        """Whether merging leaves the tokens u and v side by side: walks back in time over the pieces that met at their border."""
        rank, merge = self.rank, self.merge
        end_u = end_v = len(rank)
        while True:
            r = merge.get((u, v))
            if r is not None and r < end_u and r <= end_v:
                return False
            if rank[u] > rank[v]:
                end_u, u = rank[u], self.parts[u][1]
            elif rank[v] >= 0:
                end_v, v = rank[v], self.parts[v][0]
            else:
                return True

    def _reset(self) -> None:
        # A guess is (trie node, what may follow, count where it starts less the count here); what may follow is the token
        # before (-1: none) or, where few tokens are left below the node, those of them that may.
        self._left: dict[tuple, tuple] = {}
        self._ids: dict[tuple, int] = {((0, -1, 0),): 0}
        self._states: list[tuple] = [((0, -1, 0),)]
        # (next state + 1) << 8 | growth + 128 by state and byte; 0 where not made yet. Pages that no state uses take no memory.
        self._table = np.zeros((self.states_kept, 256), np.int32)

    def _open(self, node: int, before) -> object:
        """What may still follow in a guess at ``node``; None if nothing."""
        low, high = self.low[node] + (self.token[node] >= 0), self.high[node]
        if low >= high:
            return None
        if high - low > self.NARROW:
            return before
        got = self._left.get((node, before))
        if got is None:
            below = self.sorted[low:high]
            if isinstance(before, tuple):
                got = tuple(t for t in before if t in below)
            else:
                got = tuple(below) if before < 0 else tuple(t for t in below if self.apart(before, t))
            self._left[node, before] = got
        return got or None

    def _make(self, state: int, byte: int) -> None:
        """The transition of ``state`` on ``byte``."""
        guesses, grown, last = [], None, None
        for node, before, rel in self._states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            t = self.token[to]
            if t >= 0 and (t in before if isinstance(before, tuple) else before < 0 or self.apart(before, t)):
                grown, last = rel + 1, t
            left = self._open(to, before)
            if left is not None:
                guesses.append((to, left, rel))
        k = self._number((*((n, b, r - grown) for n, b, r in guesses), (0, last, 0)))
        self._table[state, byte] = (k + 1) << 8 | grown + 128

    def _number(self, guesses: tuple) -> int:
        """The number of the state with these guesses, a new one if it has none."""
        k = self._ids.get(guesses)
        if k is None:
            k = self._ids[guesses] = len(self._states)
            self._states.append(guesses)
            if k >= len(self._table):
                self._table = np.concatenate([self._table, np.zeros((len(self._table) // 4 + 1, 256), np.int32)])
        return k

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece ``data[starts[i] : starts[i] + lengths[i]]``; all pieces advance together, a byte a step."""
        if len(self._states) > self.states_kept * 3 // 4:
            self._reset()
        order = np.argsort(-lengths, kind="stable")
        at, length = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        # pieces longer than k are a prefix of the order
        longer = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        for k, n in enumerate(longer.tolist()):
            if n <= 8:
                left = [self._states[i] for i in state[:n].tolist()]
                for i, guesses in enumerate(left):
                    total[i] += self._count_one(data[at[i] + k : at[i] + length[i]].tobytes(), guesses)
                break
            byte, now = data[at[:n] + k], state[:n]
            made = self._table[now, byte]
            if (new := made == 0).any():
                for key in np.unique(now[new].astype(np.int64) << 8 | byte[new]).tolist():
                    self._make(key >> 8, key & 255)
                made[new] = self._table[now[new], byte[new]]
            total[:n] += (made & 255) - 128
            state[:n] = (made >> 8) - 1
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out

    def _count_one(self, data: bytes, guesses: tuple) -> int:
        """The same for the few longest pieces, a byte at a time; the table may start anew on the way."""
        total, state = 0, self._ids.get(guesses, -1)
        for b in data:
            if state < 0 or not self._table[state, b]:
                guesses = guesses if state < 0 else self._states[state]
                if state < 0 or len(self._states) >= self.states_kept:
                    self._reset()
                    state = self._number(guesses)
                self._make(state, b)
            made = int(self._table[state, b])
            total += (made & 255) - 128
            state = (made >> 8) - 1
        return total
