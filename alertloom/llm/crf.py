"""Linear-chain conditional random field over token shapes, trained and decoded in numpy batches.

Labels are O and, for each kind, B (begin) and I (inside). A text is one sequence of all its tokens, and
every token can have any label. What a word gives to its features is worked out once, the rest
in arrays.
"""

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

BUCKETS = 1 << 13  # hashed features
TOGETHER = 250_000  # code points of texts that are decoded together; their arrays fit a core's cache
CELLS = 1 << 20  # tokens, with padding, that go through Viterbi together
SLACK = np.float32(1e-2)  # above what single precision loses
ROUNDS = 4  # of ruling out labels before Viterbi
KNOWN = 100_000  # words that are kept
HEXADECIMAL = "0123456789abcdefABCDEF"
_ODD = np.uint64(0x9E3779B97F4A7C15)
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
NEVER = np.float32(-1e4)


class Field:
    """Weights of a field: emissions by feature bucket, transitions, and the names of its kinds."""

    def __init__(self, kinds: tuple[str, ...], marks: str = ""):
        # ``marks``, the signs that spans of the kinds often hold, restrict nothing: every token is decoded.
        self.kinds, self.marks = kinds, marks
        n = 1 + 2 * len(kinds)
        self.emit = np.zeros((BUCKETS, n), dtype=np.float32)
        self.move = np.zeros((n, n), dtype=np.float32)
        self.allowed = np.ones((n, n), dtype=bool)  # I follows B or I of its kind only
        for k in range(len(kinds)):
            self.allowed[:, 2 + 2 * k] = False
            self.allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
        self.first = np.array([not (i and i % 2 == 0) for i in range(n)])

    # -- from text to features -------------------------------------------------------------------

    def sequences(self, text: str) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
        """(token spans, feature buckets of each token) of the text, one sequence if it has tokens."""
        starts, ends, _, feats = features([text])
        return [(list(zip(starts.tolist(), ends.tolist())), feats)] if len(starts) else []

    # -- decoding --------------------------------------------------------------------------------

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        out = np.zeros((len(feats), self.emit.shape[1]), dtype=np.float32)
        for column in feats.T:
            out += np.take(self.emit, column, axis=0)
        return out

    def _open(self, score: np.ndarray, head: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens that may be other than O on the best path; the others are O whatever stands around them.

        A label is ruled out if putting O in its place gains, whichever labels still stand before and behind;
        where a span went on behind, its next token begins one then. What is ruled out narrows the neighbours'
        labels, so this is repeated. ``head`` and ``last`` mark the first and last tokens of texts.
        """
        n, inner = len(self.first), range(2, len(self.first), 2)
        move = np.where(self.allowed, self.move, NEVER)
        before = np.where(self.allowed, self.move - self.move[:, :1], NEVER)  # of (label before, label)
        behind = np.where(self.first[None, :], move - move[:1], NEVER)  # of (label, label behind); none begins inside
        may = np.ones((n, len(score)), dtype=bool)
        may[:, head] = self.first[:, None]
        ends = np.where(self.first, np.float32(0), NEVER)[:, None]
        # First by what the transitions around a token gain at most, wherever it stands.
        on = max((move[y, i] - move[0, i - 1] + max(0, (self.move[i] - self.move[i - 1])[self.allowed[i]].max())
                  for i in inner for y in (i - 1, i)), default=NEVER)
        carry = np.zeros(len(score), dtype=np.float32)  # what a span gains where it goes on
        for i in inner:
            np.maximum(carry[:-1], score[1:, i] - score[1:, i - 1] + on, out=carry[:-1])
        some = np.zeros(len(score), dtype=bool)
        for y in range(1, n):
            most = max(before[:, y].max(), ends[y, 0])
            some |= score[:, y] - score[:, 0] + np.maximum(carry, max(0, behind[y].max())) + most + SLACK >= 0
        may[1:, ~some] = False
        todo = np.flatnonzero(some)
        for _ in range(ROUNDS):
            opens, stops = head[todo], last[todo]
            prev, after, next_score = may[:, todo - 1], may[:, (todo + 1) % len(score)], score[(todo + 1) % len(score)]
            left = np.where(opens, ends, NEVER)
            right = np.where(stops, np.float32(0), np.full((n, 1), NEVER))
            for other in range(n):
                np.maximum(left, np.where(prev[other] & ~opens, before[other][:, None], NEVER), out=left)
                if self.first[other]:
                    np.maximum(right, np.where(after[other] & ~stops, behind[:, other][:, None], NEVER), out=right)
            for i in inner:
                later = max(0, (self.move[i] - self.move[i - 1])[self.allowed[i]].max())
                on = np.where(after[i] & ~stops, next_score[:, i] - next_score[:, i - 1] + later - move[0, i - 1], NEVER)
                for y in (i - 1, i):
                    np.maximum(right[y], on + move[y, i], out=right[y])
            own = score[todo].T
            kept = may[:, todo] & (own - own[:1] + left + right + SLACK >= 0)
            may[:, todo] = kept
            todo = todo[kept[1:].any(axis=0)]
        out = np.zeros(len(score), dtype=bool)
        out[todo] = True
        return out

    def viterbi(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """Best label path of every sequence.

        Tokens that can only be O cut the sequences; the parts between them are decoded by themselves,
        those of like length together.
        """
        lens = np.array([len(s) for s in seqs], dtype=np.int64)
        ends = np.cumsum(lens)
        if not lens.sum():
            return [np.zeros(0, dtype=np.int8) for _ in seqs]
        score = self.emissions(np.concatenate([s for s in seqs if len(s)]))
        path = np.zeros(len(score), dtype=np.int8)
        last, head = np.zeros(len(score), dtype=bool), np.zeros(len(score), dtype=bool)
        last[ends[lens > 0] - 1] = True
        head[(ends - lens)[lens > 0]] = True
        free = self._open(score, head, last)
        begin = np.flatnonzero(free & (head | ~np.roll(free, 1)))
        end = np.flatnonzero(free & (last | ~np.roll(free, -1))) + 1
        size = end - begin
        order = np.argsort(size, kind="stable")
        while len(order):
            wide = size[order[-1]]
            low = max(np.searchsorted(size[order], wide // 2, side="right"), len(order) - max(1, CELLS // wide))
            group, order = order[low:], order[:low]
            self._best(score, path, begin[group], size[group], head[begin[group]], last[end[group] - 1])
        return np.split(path, ends[:-1])

    def _best(self, score: np.ndarray, path: np.ndarray, begin: np.ndarray, lens: np.ndarray, head: np.ndarray,
              last: np.ndarray) -> None:
        """Writes the best labels of the parts into ``path``, shortest part first. O stands before a part that
        is no text's ``head`` and behind one that is no text's ``last``."""
        move = np.where(self.allowed, self.move, NEVER)
        wide, rows = lens[-1], np.arange(len(lens))
        back = np.zeros((wide, len(lens), len(move)), dtype=np.int8)
        best = score[begin] + np.where(head[:, None], np.where(self.first, 0, NEVER), move[0])
        live = np.searchsorted(lens, np.arange(wide), side="right").tolist()  # first part that is longer
        for t in range(1, wide):
            at = live[t]
            way = best[at:, :, None] + move
            back[t, at:] = way.argmax(axis=1)
            best[at:] = way.max(axis=1) + score[begin[at:] + t]
        label = (best + np.where(last[:, None], 0, move[:, 0])).argmax(axis=1)
        for t in range(wide - 1, -1, -1):
            at = live[t]
            path[begin[at:] + t] = label[at:]
            label[at:] = back[t, rows[at:], label[at:]]

    def tag(self, texts: Iterable[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) spans of every text, in code points."""
        out = []
        for some in _together(texts):
            starts, ends, sizes, feats = features(some)
            cuts = np.cumsum(sizes)[:-1]
            paths = self.viterbi(np.split(feats, cuts))
            out += map(self.spans, np.split(starts, cuts), np.split(ends, cuts), paths)
        return out

    def spans(self, starts: np.ndarray, ends: np.ndarray, path: np.ndarray) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        marked = np.flatnonzero(path)
        for start, end, label in zip(starts[marked].tolist(), ends[marked].tolist(), path[marked].tolist()):
            if label % 2:
                out.append((self.kinds[label // 2], start, end))
            else:
                kind, begun, _ = out.pop()
                out.append((kind, begun, end))
        return out

    # -- training --------------------------------------------------------------------------------

    def label(self, tokens: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> np.ndarray:
        """Labels of tokens that lie inside the given spans."""
        out = np.zeros(len(tokens), dtype=np.int64)
        for kind, start, end in spans:
            low = bisect_right(tokens, start, key=lambda t: t[1])
            inside = range(low, bisect_left(tokens, end, key=lambda t: t[0]))
            for i in inside:
                out[i] = (1 if i == inside[0] else 2) + 2 * self.kinds.index(kind)
        return out

    def fit(self, seqs: list[np.ndarray], labels: list[np.ndarray], rounds: int = 80,
            rate: float = 0.4, decay: float = 1e-3) -> "Field":
        """Maximum likelihood by scaled forward-backward over padded batches, AdaGrad steps."""
        if not seqs:
            return self
        n = len(self.first)
        lens = np.array([len(s) for s in seqs])
        wide = lens.max()
        feats = np.zeros((len(seqs), wide, seqs[0].shape[1]), dtype=np.int32)
        gold = np.zeros((len(seqs), wide), dtype=np.int64)
        for i, (s, y) in enumerate(zip(seqs, labels)):
            feats[i, :lens[i]], gold[i, :lens[i]] = s, y
        live = np.arange(wide)[None, :] < lens[:, None]
        flat = feats[live].astype(np.int64)
        del feats
        hot = np.eye(n, dtype=np.float32)[gold[live]]
        pair = np.zeros((n, n), dtype=np.float64)
        both = live[:, 1:]
        np.add.at(pair, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        seen_e, seen_m = np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6)
        for _ in range(rounds):
            move = np.exp(self.move.astype(np.float64)) * self.allowed
            emit = np.ones((len(seqs), wide, n))
            own = self.emissions(flat).astype(np.float64)
            emit[live] = np.exp(own - own.max(axis=1, keepdims=True))
            # Forward and backward shares, scaled at every token.
            alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.ones((len(seqs), wide, 1))
            for t in range(wide):
                step = (emit[:, 0] * self.first if t == 0 else (alpha[:, t - 1] @ move) * emit[:, t])
                scale[:, t] = np.where(live[:, t, None], step.sum(axis=1, keepdims=True), 1)
                alpha[:, t] = np.where(live[:, t, None], step / scale[:, t], alpha[:, t - 1])
            expected = np.zeros((n, n))
            for t in range(wide - 2, -1, -1):
                there = live[:, t + 1, None]
                after = np.where(there, emit[:, t + 1] * beta[:, t + 1] / scale[:, t + 1], 0)
                beta[:, t] = np.where(there, after @ move.T, 1)
                expected += move * (alpha[:, t].T @ after)
            chance = (alpha * beta)[live]
            diff = hot - chance
            slope = np.stack([np.bincount(flat.ravel(), np.repeat(diff[:, k], flat.shape[1]), BUCKETS)
                              for k in range(n)], axis=1).astype(np.float32)
            slope -= decay * len(seqs) * self.emit
            seen_e += slope ** 2
            self.emit += rate * slope / np.sqrt(seen_e)
            slope_m = (pair - expected).astype(np.float32) - decay * len(seqs) * self.move
            seen_m += slope_m ** 2
            self.move += rate * slope_m / np.sqrt(seen_m)
        return self


def _together(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``TOGETHER`` code points."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def shape(token: str) -> str:
    """Case and digit pattern with runs shortened: Ab12 gives Xx9, a long run adds a plus."""
    out, last, run = [], "", 0
    for c in token:
        kind = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        run = run + 1 if kind == last else 1
        if run in (1, 5):
            out.append(kind if run == 1 else "+")
        last = kind
    return "".join(out[:12])


def _luhn(token: str) -> bool | None:
    """Whether a run of card length has a right check digit; None for other tokens."""
    if not (12 <= len(token) <= 19 and token.isascii() and token.isdigit()):
        return None
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in token[-2::-2])
    return (doubled + sum(map(int, token[-1::-2]))) % 10 == 0


def file_features(text: str) -> str:
    """Coarse class of the whole text: size and share of code-like signs."""
    signs = sum(text.count(c) for c in "=;{}") / max(1, len(text))
    return f"{min(6, len(text).bit_length() // 3)}{'code' if signs > 0.01 else 'prose'}"


class _Words(dict):
    """Rows of what is known of the words met so far: shape, start of the shape, size, lower-cased word,
    flags, check digit and whether it is hexadecimal; names as their checksums. What a word gives to
    buckets by itself (``alone``), and to buckets that it shares with a word behind it (``begun``), is hashed once."""

    def __init__(self):
        self.rows = np.zeros((0, 7), np.uint64)
        self.alone, self.begun = np.zeros((0, len(_ALONE)), np.int32), np.zeros((0, 4), np.uint64)
        self.done, self.fresh = 0, array("Q")  # words that have rows, rows of the words met since
        self._put("", _code("~"), 0, 0, _code("~"), 0, 0, 0)  # what stands before and behind a text

    def __missing__(self, w: str) -> int:
        n, plain = len(w), w.isalpha()
        hexed = n >= 8 and not w.strip(HEXADECIMAL)
        size = n if n < 10 else 10 + min(n // 6, 6)
        if plain and w.islower():  # most words
            return self._put(w, *(_LONG if n > 4 else _SHORT), size, _code(w) if n <= 12 else _OTHER,
                             4 * hexed + (size > 9), 0, hexed)
        form = shape(w)
        low = _code(w.lower()) if plain and n <= 12 else _OTHER
        mixed = not plain and any(map(str.isdigit, w)) and any(map(str.isalpha, w))
        return self._put(w, _code(form), _code(form[:2]), size, low, 4 * hexed + 2 * mixed + (size > 9),
                         {None: 0, False: 1, True: 2}[_luhn(w)], hexed)

    def _put(self, w: str, *row: int) -> int:
        self.fresh.extend(row)
        at = self[w] = len(self)
        return at

    def hashed(self) -> None:
        """Brings ``rows``, ``alone`` and ``begun`` up to the words met since."""
        if self.done == len(self):
            return
        if len(self.rows) < len(self):
            for name in ("rows", "alone", "begun"):
                old = getattr(self, name)
                new = np.zeros((len(self) + len(self) // 2, old.shape[1]), old.dtype)
                new[:self.done] = old[:self.done]
                setattr(self, name, new)
        new = slice(self.done, len(self))
        self.rows[new] = np.array(self.fresh, dtype=np.uint64).reshape(-1, 7)
        del self.fresh[:]
        form, begin, size, low, flags, check, _ = self.rows[new].T.copy()
        for at, (kind, *parts) in enumerate(((1, form), (2, low), (3, size, begin), (4, flags), (13, check, form),
                                             (10, low), (11, low), (15, form))):
            self.alone[new, at] = _buckets(kind, *parts)
        for at, (kind, part) in enumerate(((8, form), (9, form), (12, low), (14, form))):
            self.begun[new, at] = _mixed(np.uint64(kind), part)
        self.done = len(self)


def _code(name: str) -> int:
    return zlib.crc32(name.encode())


_LONG, _SHORT, _OTHER = (_code("x+"), _code("x+")), (_code("x"), _code("x")), _code("#")


def _mixed(acc: np.uint64 | np.ndarray, part: np.ndarray) -> np.ndarray:
    """Multiplicative hashing of one more part."""
    acc = ((acc * _ODD) ^ part) * _ODD
    acc ^= acc >> np.uint64(29)
    return acc


def _bucket(acc: np.ndarray) -> np.ndarray:
    return ((acc * _ODD) >> np.uint64(32)) & np.uint64(BUCKETS - 1)


def _buckets(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Buckets of one kind of feature, by hashing of its parts."""
    acc = np.uint64(kind)
    for part in parts:
        acc = _mixed(acc, part)
    return _bucket(acc)


# Columns of the features that a word gives by itself: five of its own, two of the neighbours', one of the next but one.
_ALONE = (0, 1, 2, 3, 12, 9, 10, 14)
_known: _Words | None = None


@cache
def _signs() -> np.ndarray:
    """0 white space, 1 letter or digit, 2 a token by itself, for every code point as ``TOKEN`` has it."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.full(len(every), 2, dtype=np.int8)
    for kind, runs in ((1, r"[^\W_]+"), (0, r"\s+")):
        for hit in re.finditer(runs, every):
            out[hit.start():hit.end()] = kind
    return out


def tokenized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the text's tokens."""
    kinds = _signs()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    begins, stops = kinds > 0, kinds > 0
    both = (kinds[1:] == 1) & (kinds[:-1] == 1)
    begins[1:] &= ~both
    stops[:-1] &= ~both
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all tokens within their texts, tokens of each text, and hashed features of each token: its
    shape, length and letters, its neighbours', the file's."""
    global _known
    if _known is None or len(_known) > KNOWN:
        _known = _Words()
    joined = "\n".join(texts)
    starts, ends = tokenized(joined)
    offsets = np.cumsum([0] + [len(text) + 1 for text in texts])
    stops = np.searchsorted(starts, offsets[1:])
    sizes = np.diff(stops, prepend=0)
    spot = np.arange(len(starts)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)  # two edges stand between texts
    every = np.zeros(len(starts) + 2 * len(texts) + 2, dtype=np.int64)
    every[spot] = np.fromiter(map(_known.__getitem__, TOKEN.findall(joined)), dtype=np.int64, count=len(starts))
    with np.errstate(over="ignore"):
        _known.hashed()
        alone, begun, form = _known.alone[every], _known.begun[every].T, _known.rows[every, 0]
        own, hexed = form[spot], _known.rows[every[spot], 6].astype(np.int64)
        before, behind = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), 2)
        before[1:] = behind[:-1] = starts[1:] == ends[:-1]
        before[(stops - sizes)[sizes > 0]], behind[stops[sizes > 0] - 1] = 0, 2
        around = _mixed(_mixed(np.uint64(5), np.repeat(np.arange(2, dtype=np.uint64), 3)),
                        np.tile(np.arange(3, dtype=np.uint64), 2))[3 * before + behind]
        file = np.array([_code(file_features(text)) for text in texts], dtype=np.uint64)
        file = _buckets(6, np.repeat(np.arange(2, dtype=np.uint64), len(texts)), np.tile(file, 2))
        out = np.empty((len(starts), 15), dtype=np.int32)
        out[:, _ALONE[:5]] = alone[spot, :5]
        for column, at, shift in ((9, 5, -1), (10, 6, 1), (14, 7, 2)):
            out[:, column] = alone[spot + shift, at]
        out[:, 4] = _bucket(_mixed(around, own))
        out[:, 5] = file[hexed * len(texts) + np.repeat(np.arange(len(texts)), sizes)]
        out[:, 6] = _buckets(7, np.zeros(1, dtype=np.uint64))
        out[:, 7] = _bucket(_mixed(begun[0, spot - 1], own))
        out[:, 8] = _bucket(_mixed(begun[1, spot], form[spot + 1]))
        out[:, 11] = _bucket(_mixed(begun[2, spot - 2], form[spot - 1]))
        out[:, 13] = _bucket(_mixed(begun[3, spot - 2], form[spot - 1]))
    starts -= np.repeat(offsets[:-1], sizes)
    ends -= np.repeat(offsets[:-1], sizes)
    return starts, ends, sizes, out
