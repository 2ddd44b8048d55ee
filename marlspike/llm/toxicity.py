"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks.

Kernel: the gap-weighted subsequence kernel of orders 3 and 4 with decay ``DECAY``,
each normalised, averaged.  Subsequences may have gaps, so a word with separators or
other characters inserted stays close to the word it hides.

A text is a bag of segments: its words in lower case (stripped of punctuation at
their ends), runs of single characters and of pieces of one or two characters joined
to one (tokens of punctuation between them do not count), and overlapping windows of
segments longer than ``LONGEST``, and runs of words that spell a learned phrase, joined
to one.  Its decision is the highest of its segments'.

Training, on at most ``MAX_LABELLED`` labelled texts of ``MAX_LEARNED_BYTES`` bytes
together (in order of a hash of their id; a text that no longer fits is left out):

1. words and word beginnings that are significantly more frequent in toxic texts
   (binomial tail, corrected for their number) are picked greedily until they cover
   every toxic text that any of them covers; they and the clean segments closest to
   them are the landmarks, so the number of landmarks follows the vocabulary; where
   no word covers a toxic text, runs of two and three words are picked the same way;
2. segments of toxic texts that start with a picked string, and copies of them with
   characters inserted, are positive; segments of clean texts (random, and
   the closest to the landmarks) are negative;
3. Nyström features k(x, landmarks) K^-1/2 go into a linear SVM (squared hinge loss),
   which folds back into one weight for each landmark;
4. a logistic curve over the texts' decisions gives the score: its middle is the decision
   that parts the texts with the fewest errors, its slope is fitted near the middle.

Defined results: null and empty texts have no segments and get the score of kernel 0;
equal texts have equal scores; without toxic or clean labels, or without any
significant word, every text gets the share of toxic labels (smoothed); rows without
an id or label are not learned from; extra columns are ignored.

Scale: only the model is sent out (tables over pairs of the landmarks' letter pairs: 1 MB
for 30 landmarks, 10 MB at most for 40 letters); texts are scored where they are read.
Segments are scored once in each Python worker while they stay in its cache.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import filtered, output, tidy

DECAY = 0.6
ORDERS = (3, 4)
LONGEST = 16
MAX_LABELLED = 5000
MAX_LEARNED_BYTES = 24 << 20
PHRASE_CHARS = 24
PHRASE_WORDS = (2, 3)
SPELLED = 0.5
NEAR_CLEAN = 8
HELD_OUT = (5, 0)
CACHE = 300_000
CELLS = 1 << 24
_ENDS = ".,;:!?()[]{}<>\"'`*#$%&|=+-_/\\~^"


def _cut(word: str) -> list[str]:
    """The word, or overlapping windows of a long one."""
    if len(word) <= LONGEST:
        return [word]
    return [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def segments(text: str) -> list[str]:
    """The text's segments: words, words without the separators in them, joined single characters, joined short pieces.

    Tokens without letters or digits leave a run of characters or pieces open.
    """
    out: list[str] = []
    single: list[str] = []
    short: list[str] = []  # pieces of one or two characters
    for word in [*text.lower().split(), None]:
        piece = bare = word and word.strip(_ENDS)
        if bare and not bare.isalnum():
            piece = "".join(filter(str.isalnum, bare))
        if bare and len(bare) > 2:
            out += _cut(bare)
            if piece != bare:
                out += _cut(piece)
        if piece == "":
            continue
        if piece and len(piece) == 1:
            single.append(piece)
            short.append(piece)
            continue
        if len(single) > 2:
            out += _cut("".join(single))
        if piece and len(piece) == 2:
            single = []
            short.append(piece)
            continue
        if len(short) > max(1, len(single)):
            out += _cut("".join(short))
        single, short = [], []
    return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points, padded with -1."""
    n = max(map(len, words))
    flat = np.frombuffer("".join(w.ljust(n, "\x00") for w in words).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(words), n).copy()
    flat[flat == 0] = -1
    return flat


def subsequences(s: np.ndarray, t: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of each order in ``ORDERS`` for each row pair of code arrays."""
    n, m = s.shape[1], t.shape[1]
    top = max(ORDERS)
    gaps = np.array([[decay ** (j - k) if k <= j else 0.0 for j in range(m)] for k in range(m)], np.float32)
    ends = [np.ones((len(s), m + 1), np.float32)] + [np.zeros((len(s), m + 1), np.float32) for _ in range(top - 1)]
    out = np.zeros((top + 1, len(s)), np.float32)
    square = np.float32(decay * decay)
    for i in range(n):
        same = (s[:, i : i + 1] == t) & (s[:, i : i + 1] >= 0)
        for p in range(top, 0, -1):  # downwards: order p uses order p - 1 before this character
            step = same * ends[p - 1][:, :m] * square
            out[p] += step.sum(axis=1)
            if p < top:
                ends[p][:, 1:] *= np.float32(decay)
                ends[p][:, 1:] += step @ gaps
    return out[list(ORDERS)]


def self_kernel(words: list[str]) -> np.ndarray:
    """Kernel of each word with itself, by order."""
    out = np.zeros((len(ORDERS), len(words)), np.float32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        code = _codes([words[i] for i in at])
        out[:, at] = subsequences(code, code)
    return out


class Landmarks:
    """The kernel against a fixed list of strings, over the subsequences that occur in them.

    A word's subsequences are looked up by their two halves: a table numbers the
    letter pairs of the landmarks, and order 3 is a pair and a letter, order 4 two
    pairs.  Everything else is a subsequence that no landmark has and adds nothing.
    """

    def __init__(self, words: list[str]):
        self.words = words
        letters = sorted(set("".join(words)))
        self.letters = np.array([ord(c) for c in letters], np.int32)
        self.base = len(letters) + 1
        pairs: dict[tuple[int, int], int] = {}
        found: list[dict[tuple[int, ...], dict[int, float]]] = [{} for _ in ORDERS]
        for j, word in enumerate(words):
            code = self.code(_codes([word]))[0].tolist()
            for order, features in zip(ORDERS, found):
                for at in combinations(range(len(code)), order):
                    key = tuple(code[i] for i in at)
                    features.setdefault(key, {})
                    features[key][j] = features[key].get(j, 0.0) + DECAY ** (at[-1] - at[0] + 1)
                    for x in (key[:2], key[2:]):
                        if len(x) == 2:
                            pairs.setdefault(x, len(pairs))
        self.none = len(pairs)
        self.pairs = np.full(self.base * self.base, self.none, np.int32)
        for (x, y), k in pairs.items():
            self.pairs[x * self.base + y] = k
        own = self_kernel(words)
        self.tables, self.matrix = [], []  # a matrix is (features, landmarks, weights, number of features), by landmark
        for p, (order, features) in enumerate(zip(ORDERS, found)):
            table = np.full((self.none + 1) * (self.base if order == 3 else self.none + 1), len(features), np.int32)
            cells = []
            for k, (key, weights) in enumerate(features.items()):
                table[self._place(pairs[key[:2]], key[2] if order == 3 else pairs[key[2:]], order)] = k
                cells += [(j, k, w / math.sqrt(own[p, j])) for j, w in weights.items()]
            cells.sort()
            at, mark, weight = np.array([c[1] for c in cells], np.int64), np.array([c[0] for c in cells], np.int64), np.array([c[2] for c in cells], np.float32)
            self.tables.append(table)
            self.matrix.append((at, mark, weight, len(features)))

    def _place(self, first, then, order: int):
        return first * (self.base if order == 3 else self.none + 1) + then

    def code(self, points: np.ndarray) -> np.ndarray:
        """Code points to letter numbers; 0 for letters that no landmark has."""
        at = np.searchsorted(self.letters, points)
        at = np.minimum(at, max(0, len(self.letters) - 1))
        return np.where(self.letters[at] == points, at + 1, 0).astype(np.int32)

    def each(self, code: np.ndarray):
        """(order index, decay, places in that order's table) of every subsequence of words of one length."""
        n = code.shape[1]
        column = np.ascontiguousarray(code.T)
        pair = {(i, j): self.pairs[column[i] * self.base + column[j]] for i in range(n) for j in range(i + 1, n)}
        for (i, j), p in pair.items():
            if (p == self.none).all():
                continue
            p3, p4 = p * self.base, p * (self.none + 1)
            for k in range(j + 1, n):
                yield 0, DECAY ** (k - i + 1), p3 + column[k]
                for last in range(k + 1, n):
                    yield 1, DECAY ** (last - i + 1), p4 + pair[k, last]

    def kernel(self, words: list[str]) -> np.ndarray:
        """k(word, landmark) as an array (words, landmarks)."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        most = max(16, min(2048, CELLS // max(1, *(len(m[0]) for m in self.matrix))))
        for at, code, points in self._grouped(words, most):
            seen = [np.zeros((len(at), m[3] + 1), np.float32) for m in self.matrix]
            row = np.arange(len(at))
            for p, decay, place in self.each(code):
                seen[p][row, self.tables[p][place]] += np.float32(decay)
            own = subsequences(points, points)
            for p, (feature, mark, weight, _) in enumerate(self.matrix):
                if len(mark):
                    first = np.flatnonzero(np.diff(mark, prepend=-1))
                    sums = np.add.reduceat(seen[p][:, feature] * weight, first, axis=1)
                    out[np.ix_(at, mark[first])] += sums / np.sqrt(np.maximum(own[p], 1e-30))[:, None] / len(ORDERS)
        return out

    def _grouped(self, words: list[str], most: int):
        """(places, letter numbers, code points) of words of one length, at most ``most`` at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes[sizes >= min(ORDERS)]):
            same = np.flatnonzero(sizes == n)
            for at in np.array_split(same, -(-len(same) // most)):
                points = _codes([words[i] for i in at])
                yield at, self.code(points), points

    def folded(self, weights: np.ndarray) -> list[np.ndarray]:
        """For each order, what a subsequence at a place of its table adds, over all landmarks."""
        sums = [np.bincount(feature, weight * weights[mark], n + 1).astype(np.float32) for feature, mark, weight, n in self.matrix]
        return [s[t] / np.float32(len(ORDERS)) for s, t in zip(sums, self.tables)]

    def gains(self, words: list[str], folded: list[np.ndarray]) -> np.ndarray:
        """The weighted kernel sum of each word where it can be positive, else 0."""
        out = np.zeros(len(words), np.float32)
        for at, code, points in self._grouped(words, 16_384):
            some = np.flatnonzero((code > 0).sum(axis=1) >= min(ORDERS))
            if not len(some):
                continue
            at, code, points = at[some], code[some], points[some]
            top = np.zeros((len(ORDERS), len(at)), np.float32)
            for p, decay, place in self.each(code):
                top[p] += folded[p][place] * np.float32(decay)
            good = np.flatnonzero((top > 0).any(axis=0))
            if len(good):
                own = subsequences(points[good], points[good])
                out[at[good]] = np.maximum((top[:, good] / np.sqrt(np.maximum(own, 1e-30))).sum(axis=0), 0)
        return out


class Model:
    """Weights over landmarks, a bias and a logistic curve."""

    def __init__(self, landmarks: Landmarks | None, weights, bias: float, slope: float, offset: float, phrases: Phrases | None = None):
        self.landmarks, self.weights, self.bias, self.slope, self.offset, self.phrases = landmarks, weights, bias, slope, offset, phrases
        self.known: dict[str, float] = {}
        self.table: list[np.ndarray] | None = None

    def decisions(self, texts: list[str]) -> list[float]:
        """The highest decision among each text's segments, the bias (kernel 0) at least."""
        if self.landmarks is None:
            return [self.bias] * len(texts)
        if self.table is None:
            self.table = self.landmarks.folded(self.weights)
        bags = [set(segments(t)) for t in texts]
        if self.phrases is not None:
            bags = [a | b for a, b in zip(bags, self.phrases.within(texts))]
        new = list(set().union(*bags).difference(self.known)) if bags else []
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(set().union(*bags))
        if new:
            self.known.update(zip(new, self.landmarks.gains(new, self.table).tolist()))
        known = self.known
        return [self.bias + max((known[w] for w in bag), default=0.0) for bag in bags]

    def scores(self, texts: list[str]) -> list[float]:
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * d + self.offset)))) for d in self.decisions(texts)]

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": None}


def _strings(segment: str) -> list[str]:
    """What can be picked from a segment: itself and its beginnings of 4 to 8 characters."""
    return [segment, *(segment[:k] for k in range(4, min(9, len(segment))))]


def pick(bad: list[set[str]], clean_words: Counter[str], clean: int) -> list[str]:
    """Significant words and beginnings that cover every toxic bag that any covers.

    ``clean_words`` counts the clean texts of each word; a string's count in clean texts
    is the sum over the words that hold it, so it is never too low.
    """
    inside = Counter(x for b in bad for x in {x for s in b for x in _strings(s)})
    inside = Counter({x: n for x, n in inside.items() if n > 2})
    outside: Counter[str] = Counter()
    for s, n in clean_words.items():
        for x in _strings(s):
            if x in inside:
                outside[x] += n
    for x in outside:
        outside[x] = min(outside[x], clean)
    held = [{x for s in b for x in _strings(s) if x in inside} for b in bad]
    out = covering(held, inside, outside, len(bad), clean)
    # words of their own that cover well although other strings cover the same texts
    for x in sorted(significant(inside, outside, len(bad), clean), key=lambda x: (-inside[x], -len(x), x)):
        if inside[x] >= 0.1 * max(1, len(bad)) and not any(x.startswith(o) or o.startswith(x) for o in out):
            out.append(x)
    return out


def significant(inside: Counter[str], outside: Counter[str], toxic: int, clean: int, tried: int = 0, margin: float = 3) -> set[str]:
    """Strings far more frequent in toxic texts: binomial tail, corrected for the number of strings tried."""
    base = toxic / (toxic + clean)
    limit = math.log(max(2, tried or len(inside))) + margin

    def surprise(x: str) -> float:
        n, k = inside[x] + outside[x], inside[x]
        q = min(k / n, 1 - 1e-9)
        return n * (q * math.log(q / base) + (1 - q) * math.log((1 - q) / (1 - base))) if q > base else 0.0

    return {x for x in inside if surprise(x) > limit and outside[x] * toxic * 10 <= inside[x] * clean}


def covering(bags: list[set[str]], inside: Counter[str], outside: Counter[str], toxic: int, clean: int, tried: int = 0, margin: float = 3) -> list[str]:
    """Significant strings picked greedily until they cover every bag that any covers."""
    where: dict[str, set[int]] = {x: set() for x in significant(inside, outside, toxic, clean, tried, margin)}
    held: list[set[str]] = []
    for k, b in enumerate(bags):
        held.append({x for x in b if x in where})
        for x in held[-1]:
            where[x].add(k)
    out: list[str] = []
    fresh = {x: len(v) for x, v in where.items() if v}  # bags that no picked string covers yet
    while fresh:
        worth = {x: n * (1 - min(0.9, outside[x] / (inside[x] + 1))) for x, n in fresh.items()}
        top = max(worth.values())
        x = max((x for x, v in worth.items() if v >= 0.95 * top), key=lambda x: (len(x), x))  # of equals, the longest
        out.append(x)
        for k in where.pop(x):
            for o in held[k]:
                fresh[o] -= 1
            held[k] = set()
        fresh = {o: n for o, n in fresh.items() if n}
    return out


def pieces(text: str) -> list[str]:
    """The letters and digits of each word, in lower case and in order."""
    found = ("".join(filter(str.isalnum, w)) if not w.isalnum() else w for w in text.lower().split())
    return [w for w in found if w]


def _runs(text: str) -> set[str]:
    """All runs of ``PHRASE_WORDS`` words."""
    w = pieces(text)
    return {" ".join(w[k : k + n]) for n in PHRASE_WORDS for k in range(len(w) - n + 1)}


def pick_phrases(bad: list[str], clean: list[str], toxic: int) -> list[str]:
    """Significant runs of words that cover the toxic texts ``bad``, which no single word covers."""
    if len(bad) < 3:
        return []
    bags = [_runs(t) for t in bad]
    inside = Counter(x for b in bags for x in b)
    tried = len(inside)
    inside = Counter({x: n for x, n in inside.items() if n > 4})
    outside: Counter[str] = Counter()
    for t in clean:
        outside.update(x for x in _runs(t) if x in inside)
    return covering(bags, inside, outside, toxic, len(clean), tried, 6)  # runs are many, so chance has more room than among words


class Phrases:
    """Finds runs of words that spell a phrase, each word exactly or close by the kernel, with one more word between at most."""

    def __init__(self, phrases: list[str]):
        self.phrases = [p.split() for p in phrases]
        self.strings = ["".join(p)[:PHRASE_CHARS] for p in self.phrases]
        self.roles: dict[str, frozenset[tuple[int, int]]] = {}
        self.of: dict[str, set[tuple[int, int]]] = {}
        for k, p in enumerate(self.phrases):
            for j, w in enumerate(p):
                self.of.setdefault(w, set()).add((k, j))
        long = sorted(w for w in self.of if 4 <= len(w) <= LONGEST)
        self.spelled = Landmarks(long) if long else None

    def _learn(self, words: list[str]) -> None:
        found = {w: set(self.of.get(w, ())) for w in words}
        if self.spelled is not None:
            some = [w for w in words if 3 < len(w) <= LONGEST]
            near = self.spelled.kernel(some) >= SPELLED if some else np.zeros((0, 0), bool)
            for i, j in zip(*np.nonzero(near)):
                found[some[i]] |= self.of[self.spelled.words[j]]
        self.roles.update((w, frozenset(v)) for w, v in found.items())

    def within(self, texts: list[str]) -> list[set[str]]:
        """For each text, the joined runs that spell a phrase."""
        cut = [pieces(t) for t in texts]
        distinct = set().union(*cut) if cut else set()
        if len(self.roles) + len(distinct) > CACHE:
            self.roles.clear()
        self._learn(sorted(distinct.difference(self.roles)))
        out = []
        for words in cut:
            roles = [self.roles[w] for w in words]
            found = set()
            for i, mine in enumerate(roles):
                for k, j in mine:
                    if j == 0 and (end := self._end(roles, i, k)):
                        found.add("".join(words[i:end])[:PHRASE_CHARS])
            out.append(found)
        return out

    def _end(self, roles: list[frozenset[tuple[int, int]]], at: int, k: int) -> int:
        """Where the phrase that begins at a word ends; 0 if the words do not go on with it."""
        for j in range(1, len(self.phrases[k])):
            at = next((x for x in (at + 1, at + 2) if x < len(roles) and (k, j) in roles[x]), 0)
            if not at:
                return 0
        return at + 1

    def __getstate__(self):
        return self.__dict__ | {"roles": {}}


def gapped(word: str, rng: random.Random) -> str:
    """The word with one to three characters inserted."""
    for _ in range(rng.randint(1, 3)):
        k = rng.randint(1, max(1, len(word) - 1))
        word = word[:k] + rng.choice(".-_*~+x") + word[k:]
    return word


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps over the examples inside the margin."""
    x = np.column_stack([x, np.ones(len(x))])
    pull = np.diag([*[ridge] * (x.shape[1] - 1), ridge * 1e-3])
    w = np.zeros(x.shape[1])
    inside = np.ones(len(x), bool)
    for _ in range(rounds):
        xi, ci = x[inside], weight[inside]
        w = np.linalg.solve((xi * ci[:, None]).T @ xi + pull, xi.T @ (ci * y[inside]))
        now = y * (x @ w) < 1
        if np.array_equal(now, inside):
            break
        inside = now
    return w[:-1], float(w[-1])


def logistic(d: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve over decisions (damped Newton steps, smoothed targets)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mid, unit = d.mean(), d.std() or 1.0
    x = np.column_stack([(d - mid) / unit, np.ones(len(d))])

    def loss(a: np.ndarray) -> float:
        z = x @ a
        return float((np.logaddexp(0, z) - goal * z).sum() + 1e-3 * a[0] ** 2)

    a = np.array([1.0, math.log((n1 + 1) / (n0 + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (p - goal) + np.array([2e-3, 0]) * a
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-9])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and loss(a - size * step) > loss(a):
            size /= 2
        a = a - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slope = max(float(a[0]), 1e-3) / unit
    return slope, float(a[1]) - slope * mid


def border(d: np.ndarray, y: np.ndarray) -> float:
    """The decision that parts the texts with the fewest errors; of equals, in the middle of the widest gap."""
    order = np.argsort(d, kind="stable")
    v, t = d[order], y[order] > 0
    below = np.concatenate(([0], np.cumsum(t)))  # toxic texts among the first i
    errors = below + (np.count_nonzero(~t) - (np.arange(len(v) + 1) - below))
    gap = np.concatenate(([2.0], np.diff(v), [2.0]))  # gap[i] is before text i
    errors = np.where(gap > 0, errors, len(v) + 1)
    best = np.flatnonzero(errors == errors.min())
    i = int(best[np.argmax(gap[best])])
    return float(v[0] - 1 if i == 0 else v[-1] + 1 if i == len(v) else (v[i - 1] + v[i]) / 2)


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """A model from labelled texts."""
    toxic = [bool(y) for y in labels]
    share = (sum(toxic) + 0.5) / (len(toxic) + 1)
    flat = Model(None, None, 0.0, 1.0, math.log(share / (1 - share)))
    if not any(toxic) or all(toxic):
        return flat
    rng = random.Random(seed)
    bad = [set(segments(t)) for t, y in zip(texts, toxic) if y]
    clean_words: Counter[str] = Counter()
    for t, y in zip(texts, toxic):  # one text at a time: only the counts are kept
        if not y:
            clean_words.update(set(segments(t)))
    picked = pick(bad, clean_words, len(texts) - len(bad))
    missed = [t for t, b in zip((t for t, y in zip(texts, toxic) if y), bad) if not any(s.startswith(tuple(picked)) for s in b)]
    found = pick_phrases(missed, [t for t, y in zip(texts, toxic) if not y], len(bad))
    phrases = Phrases(found) if found else None
    if not picked and not phrases:
        return flat
    positive = Counter(s for b in bad for s in b if s.startswith(tuple(picked)))
    spelled: Counter[str] = Counter()  # runs of clean texts that spell a phrase
    if phrases:
        for part in _parts(missed, 1 << 20):
            positive.update(s for b in phrases.within(part) for s in b)
        for part in _parts([t for t, y in zip(texts, toxic) if not y], 1 << 20):
            spelled.update(s for b in phrases.within(part) for s in b)
    positive = Counter({s: n for s, n in positive.items() if max(clean_words[s], spelled[s]) * sum(toxic) < n * (len(toxic) - sum(toxic)) / 4})
    heads = sorted(positive, key=lambda s: (-positive[s], s))
    if not heads:
        return flat
    clean = sorted(clean_words)
    rng.shuffle(clean)
    strings = [*picked, *(phrases.strings if phrases else ())]
    marks = Landmarks(strings)
    near = np.concatenate([marks.kernel(clean[k : k + 20_000]).max(axis=1) for k in range(0, len(clean), 20_000)])
    order = np.argsort(-near, kind="stable")
    hard, rest = [clean[i] for i in order[:1500]], [clean[i] for i in order[1500:4500]]
    marks = Landmarks(list(dict.fromkeys([*strings, *hard[:NEAR_CLEAN]])))
    hard += [s for s in sorted(spelled, key=lambda s: (-spelled[s], s)) if s not in positive and s not in clean_words][:1500]
    hidden = [gapped(s, rng) for s in [*heads[:200], *[x for x in strings if x in positive] * 8]]
    words = [*heads, *hidden, *hard, *rest]
    y = np.array([1.0] * (len(heads) + len(hidden)) + [-1.0] * (len(hard) + len(rest)))
    values, vectors = np.linalg.eigh(marks.kernel(marks.words).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    features = marks.kernel(words).astype(np.float64) @ root
    often = np.sqrt([*(positive[s] for s in heads), *[1.0] * (len(words) - len(heads))])
    weight = np.where(y > 0, often / often[y > 0].sum(), often / often[y < 0].sum())
    w, bias = svm(features, y, weight)
    model = Model(marks, (root @ w).astype(np.float32), bias, 1.0, 0.0, phrases)
    d = np.array([x for part in _parts(texts, 1 << 20) for x in model.decisions(part)])
    model.known.clear()
    if phrases:
        phrases.roles.clear()
    middle = border(d, np.array(toxic))
    model.slope = max(0.5, logistic(np.clip(d - middle, -2, 2), np.array(toxic, float))[0])
    model.offset = -model.slope * middle
    return model


def held_out(id_col: str, fold: tuple[int, int] = HELD_OUT):
    """Whether the id's fold is the one that is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], most: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MAX_LEARNED_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: at most ``most`` rows and ``most_bytes`` bytes, in order of a hash of their id.

    Sizes are fetched first, so no more text than that comes to the driver; a text that
    no longer fits is left out, and of equal rows one is learned from.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, fold)).groupBy(id_col).agg(F.max(label).alias("_y"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(most)
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_mark", F.xxhash64("_text"))
    sized = rows.join(F.broadcast(known), id_col).select(id_col, "_mark", "_y", F.octet_length("_text").alias("_size")).distinct()
    left, chosen = most_bytes, []
    for r in sized.orderBy(F.xxhash64(id_col), id_col, "_mark").limit(most).collect():
        if r["_size"] <= left:
            left -= r["_size"]
            chosen.append((r[id_col], r["_mark"], int(r["_y"])))
    if not chosen:
        return [], []
    ids = docs.sparkSession.createDataFrame(chosen, T.StructType([docs.schema[id_col], T.StructField("_mark", T.LongType()), T.StructField("_y", T.IntegerType())]))
    found = rows.join(F.broadcast(ids), [id_col, "_mark"]).dropDuplicates([id_col, "_mark"]).select(id_col, "_text", "_y").orderBy(id_col, "_text").toArrow()
    return found.column("_text").to_pylist(), found.column("_y").to_pylist()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            got = [x for part in _parts(texts) for x in shared.value.scores(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(tidy(read), output(docs, {id_col: id_col}, "score double"))


def _parts(texts: list[str], most: int = 4 << 20):
    """Consecutive texts of at most ``most`` characters together (one text at least)."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def op2(spark, sf_dir: str) -> DataFrame:
    """``op2_toxicity`` over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(*labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", HELD_OUT, MAX_LABELLED))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go.

    Null and empty texts have the score of kernel 0; equal texts fare alike; columns of
    any name come back as they are.
    """
    model = train(*labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", HELD_OUT, MAX_LABELLED))
    shared = spark.sparkContext.broadcast(model)

    def clean(texts: list[bytes]) -> list[bool]:
        return [x < 0.5 for part in _parts([t.decode("utf-8", "replace") for t in texts]) for x in shared.value.scores(part)]

    return filtered(docs, clean)
