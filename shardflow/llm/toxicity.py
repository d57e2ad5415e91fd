"""Toxicity: a subsequence string-kernel SVM with Nystroem landmarks over sentences."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import memory, numbered, on_batches, pick

#: Letters of a segment compared at once; longer ones are read in windows of this many, half of them shared.
WIDTH = 24
#: A gapped triple of letters spans this many at most, and loses DECAY for each.
SPAN, DECAY = 7, 0.8
#: Kernel values below this count as 0: the segment has nothing of a landmark.
FLOOR = 0.4
#: Landmarks that are bounded together.
GROUP = 6
#: Segments of one length that are compared at once.
BATCH = 4096
#: A power of a kernel is one, and tells words of the same syllables better apart.
POWER = 2
#: Neighbouring words of this many letters at most are also read as one.
SHORT = 4
#: Words, and joins of two, that a worker remembers, and the longest of them.
WORDS, LONGEST = 150_000, 48
#: Texts that are read together.
PART = 384
#: Labelled documents that training reads, of each label, taken by hash, and the bytes of their texts together.
SAMPLE, BYTES = 3000, 96 << 20
LANDMARKS = 192

_FOLD = {ord(a): b for a, b in zip("0134578@$", "oieastbas")}
_EDGE = ".,;:!?\"'()[]{}<>|*#%&$~_-=+/\\`"


def unit(word: str) -> str:
    """Lower-case letters of a word, without edges of punctuation and without marks inside; digits and signs that
    stand for letters count as such next to letters."""
    w = word.strip(_EDGE).lower()
    if w.isalpha():
        return w
    if not any(c.isalpha() for c in w):
        return ""
    return "".join(c for c in w.translate(_FOLD) if c.isalpha())


def codes(units: list[str], width: int) -> np.ndarray:
    """A row of 6-bit letters for each unit of `width` letters, between marks of its begin and end: a-z, and 35 codes
    for all others (Latin ones with accents differ from each other)."""
    a = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, width).astype(np.int64)
    return np.pad(np.where((a >= 97) & (a <= 122), a - 96, 27 + a % 35), ((0, 0), (1, 1)), constant_values=((0, 0), (62, 63)))


def triples(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all gapped triples of a unit and their weights."""
    t = np.array([x for x in combinations(range(width), 3) if x[2] - x[0] <= SPAN], np.int64).reshape(-1, 3)
    return t[:, 0], t[:, 1], t[:, 2], DECAY ** (t[:, 2] - t[:, 0] + 1.0)


def features(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a batch of equally long units and the weights of its columns."""
    i, j, k, weight = triples(c.shape[1])
    return (c[:, i] << 12) | (c[:, j] << 6) | c[:, k], weight


def norms(f: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of k(x, x): weights of equal triples add up before they are squared."""
    order = np.argsort(f, axis=1, kind="stable")
    s, w = np.take_along_axis(f, order, 1), weight[order]
    new = np.concatenate([np.ones((len(f), 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
    group = np.cumsum(new.ravel()) - 1
    sums = np.bincount(group, w.ravel())
    rows = np.repeat(np.arange(len(f)), f.shape[1])[new.ravel()]
    return np.sqrt(np.bincount(rows, sums**2, len(f)))


class Kernel:
    """Rows of the gapped-subsequence kernel (three letters), normalised and raised to POWER, against landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        own = [features(codes([x], len(x))) for x in landmarks]
        used = np.unique(np.concatenate([f[0] for f, _ in own])) if own else np.empty(0, np.int64)
        self.place = np.zeros(1 << 18, np.int64)  # 0: no landmark has the triple
        self.place[used] = np.arange(1, len(used) + 1)
        z = np.zeros((len(used) + 1, len(landmarks)))
        for j, (f, w) in enumerate(own):
            np.add.at(z[:, j], self.place[f[0]], w)
        self.z = (z / np.maximum(np.sqrt((z**2).sum(0)), 1e-12)).astype(np.float32)
        near = np.argsort(np.array(landmarks), kind="stable")  # landmarks that begin alike are bounded together
        many = max(1, -(-len(near) // GROUP))
        self.of = np.concatenate([near, np.full(many * GROUP - len(near), len(landmarks))]).astype(np.int64).reshape(many, GROUP)
        z = np.hstack([self.z, np.zeros((len(self.z), 1), np.float32)])
        self.parts = np.ascontiguousarray(z[:, self.of].transpose(1, 0, 2))  # group, triple, landmark of the group
        self.bound = np.ascontiguousarray(self.parts.max(2).T)

    def rows(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which units reach FLOOR with some landmark, and their rows, in which smaller values are 0. Most groups of
        landmarks fall by a bound: the sum of each triple's largest weight among them."""
        by = defaultdict(list)
        for n, u in enumerate(units):
            by[len(u)].append(n)
        who, rows = [], []
        for width, at in by.items():
            if width < 3:
                continue
            for lo in range(0, len(at), BATCH):
                some = np.array(at[lo : lo + BATCH])
                f, w = features(codes([units[n] for n in some], width))
                place, least = self.place[f], FLOOR * np.sqrt((w**2).sum()) * (1 - 1e-6)  # no norm is smaller
                w1 = w.astype(np.float32)[None, None, :]
                most = np.concatenate([np.matmul(w1, self.bound[p])[:, 0, :] for p in np.array_split(place, len(f) // 512 + 1)])
                dots: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for g in np.flatnonzero((most >= least).any(0)).tolist():
                    u = np.flatnonzero(most[:, g] >= least)
                    dot = np.concatenate([np.matmul(w1, self.parts[g][p])[:, 0, :] for p in np.array_split(place[u], len(u) // 256 + 1)])
                    i, j = np.nonzero(dot >= least)
                    dots.append((u[i], self.of[g][j], dot[i, j]))
                if not dots:
                    continue
                u, j, dot = (np.concatenate(x) for x in zip(*dots))
                near, at_ = np.unique(u, return_inverse=True)
                if not len(near):
                    continue
                k = np.zeros((len(near), len(self.landmarks)), np.float32)
                value = dot / norms(f[near], w).astype(np.float32)[at_]
                k[at_, j] = np.where(value < FLOOR, 0, value**POWER)
                hit = k.any(1)
                who.append(some[near[hit]])
                rows.append(k[hit])
        if not who:
            return np.empty(0, np.int64), np.empty((0, len(self.landmarks)), np.float32)
        return np.concatenate(who), np.concatenate(rows)


def windows(u: str) -> list[str]:
    """A unit, or the windows of one that is too long."""
    if len(u) <= WIDTH:
        return [u]
    return [u[at : at + WIDTH] for at in range(0, max(1, len(u) - WIDTH // 2), WIDTH // 2)]


#: A word of its own that stands for a line break.
BREAK = "\x00"


def tokens(text: str) -> list[str]:
    """The words of a text, with BREAK for line breaks."""
    return text.replace("\n", f" {BREAK} ").split()


def ends(word: str) -> bool:
    """Whether a sentence ends behind a word: at a mark, or at a line break."""
    return word == BREAK or word.rstrip("\"')]}*%&$#")[-1:] in ("." , "!", "?", "\u2026")


def spelled(units: list[str]) -> list[str]:
    """Runs of four or more lone letters of a sentence, each as one word; marks that stand alone between them don't
    count (`units` has empty strings there)."""
    out, run = [], []
    for u in [*units, "  "]:
        if len(u) == 1:
            run.append(u)
        elif u:
            if len(run) > 3:
                out.append("".join(run))
            run = []
    return out


@dataclass
class Model:
    """What goes to the executors: bounded by the number of landmarks. A segment adds its kernel row times alpha to its
    sentence's decision value, which starts with the bias; a text's value is that of its highest sentence (the bias
    alone without any); score = 1 / (1 + exp(-(slope * value + shift)))."""

    landmarks: list[str]
    alpha: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, value: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -50, 50))))


class Table:
    """Distinct words by number: their segment (`unit`), what it adds to a sentence, and flags; and what joins add."""

    def __init__(self, kernel: Kernel, alpha: np.ndarray):
        self.kernel, self.alpha = kernel, alpha
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.of_unit: dict[str, float] = {}
        self.units: list[str] = []
        self.value, self.flag = np.zeros(1024), np.zeros(1024, np.int8)
        self.pairs: dict[int, float] = {}
        self.missed = 0

    def adds(self, units: list[str]) -> list[float]:
        """A segment too long to compare at once has the sum of its different windows; most have 0, those that no
        landmark is near to."""
        parts, owner = [], []
        for n, u in enumerate(units):
            if 2 < len(u) <= WIDTH:
                parts.append(u)
                owner.append(n)
            elif len(u) > WIDTH:
                cut = list(dict.fromkeys(windows(u)))
                parts += cut
                owner += [n] * len(cut)
        who, rows = self.kernel.rows(parts)
        at = np.array(owner, np.int64)[who]
        return np.bincount(at, (rows @ self.alpha).astype(np.float64), len(units)).tolist()

    def learn(self, words: list[str]) -> list[str]:
        """Numbers new words; the segments that were new."""
        units = [w if (u := unit(w)) == w else u for w in words]  # one string where the two are equal
        new = list(dict.fromkeys(u for u in units if u not in self.of_unit))
        self.of_unit.update(zip(new, self.adds(new)))
        at, size = len(self.units), len(self.units) + len(words)
        if size > len(self.value):
            self.value, self.flag = (np.concatenate([x[:at], np.zeros(2 * size - at, x.dtype)]) for x in (self.value, self.flag))
        self.value[at:size] = [self.of_unit[u] for u in units]
        self.flag[at:size] = [ends(w) | (0 < len(u) <= SHORT) << 1 | (len(u) == 1 and len(w) < 4) << 2 for w, u in zip(words, units)]
        self.number.update(zip(words, range(at, size)))
        self.units += units
        return new

    def forget(self, size: int, words: list[str], units: list[str], pairs: list[int]) -> None:
        """Gives up the latest words, segments and joins. What came first is mostly what is frequent; after very many
        others all is begun anew."""
        for d, keys in ((self.number, words), (self.of_unit, units), (self.pairs, pairs)):
            for k in keys:
                del d[k]
        del self.units[size:]
        self.missed += len(words)
        if self.missed > 20 * WORDS:
            self.clear()


    def shorten(self, words: list[str]) -> None:
        """Gives up those of some words that are too long to be met again."""
        for w in words:
            if len(w) > LONGEST:
                at = self.number.pop(w)
                self.of_unit.pop(self.units[at], None)
                self.units[at] = ""


class Scorer:
    """Decision values of texts. What is learnt of words and joins is kept from one batch to the next."""

    def __init__(self, model: Model):
        self.model, self.table = model, Table(Kernel(model.landmarks), model.alpha)

    def values(self, texts: list[str]) -> list[float]:
        t = self.table
        split = [tokens(x) for x in texts]
        known = len(t.units)
        full = known + len(t.pairs) >= WORDS
        new = list(set().union(*split).difference(t.number))
        units = t.learn(new)
        pairs: list[int] = []
        out = self._values(split, pairs)
        if full:
            t.forget(known, new, units, pairs)
        else:
            t.shorten(new)
        return out

    def _values(self, split: list[list[str]], pairs: list[int]) -> list[float]:
        """pairs gets the joins that were new."""
        t = self.table
        size = np.array([len(x) for x in split])
        ids = np.fromiter(map(t.number.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        out = np.full(len(split), self.model.bias)
        if not len(ids):
            return out.tolist()
        owner = np.repeat(np.arange(len(split)), size)
        flag, value = t.flag[ids], t.value[ids]
        stop = (flag & 1).astype(bool)
        stop[np.cumsum(size)[size > 0] - 1] = True  # a text's end ends its sentence
        short = (flag & 2).astype(bool)
        at = np.flatnonzero(short[:-1] & short[1:] & ~stop[:-1])
        start = np.flatnonzero(np.concatenate([[True], stop[:-1]]))
        sentence = np.cumsum(np.concatenate([[0], stop[:-1]]))
        some = np.flatnonzero(value)
        which, adds = [sentence[some]], [value[some]]
        if len(at):
            code, back = np.unique(ids[at] << 32 | ids[at + 1], return_inverse=True)
            known, code = t.pairs, code.tolist()
            fresh = [c for c in code if c not in known]
            pairs += fresh
            known.update(zip(fresh, t.adds([t.units[c >> 32] + t.units[c & 0xFFFFFFFF] for c in fresh])))
            both = np.array([known[c] for c in code])[back]
            which.append(sentence[at[both != 0]])
            adds.append(both[both != 0])
        which, adds = np.concatenate(which), np.concatenate(adds)
        order = np.lexsort((adds, which))  # a segment counts once in a sentence, and its value tells it from others
        which, adds = which[order], adds[order]
        first = np.concatenate([[True], (which[1:] != which[:-1]) | (adds[1:] != adds[:-1])])[: len(which)]
        sums = np.bincount(which[first], adds[first], len(start))
        lone = np.add.reduceat((flag & 4) >> 2, start, dtype=np.int64)
        for k in np.flatnonzero(lone > 3).tolist():
            span = ids[start[k] : start[k + 1] if k + 1 < len(start) else None].tolist()
            sums[k] += sum(t.adds(spelled([t.units[i] if t.flag[i] & 4 or len(t.units[i]) != 1 else "  " for i in span])))
        np.maximum.at(out, owner[start], sums + self.model.bias)
        return out.tolist()


def svm(blocks: list[tuple[np.ndarray, float, np.ndarray]], c: float = 4.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps over the support vectors. A block is rows, their sign and their
    weights (rows of weight 0 don't count); c was chosen by cross-validation over rows that aren't held out; blocks are read a few rows at a time and never copied whole."""
    size = blocks[0][0].shape[1] + 1
    reg = np.eye(size)
    reg[-1, -1] = 1e-3
    w = np.zeros(size)

    def short(w: np.ndarray) -> Iterator[tuple[np.ndarray, float, np.ndarray, np.ndarray]]:
        """Rows on the wrong side of the margin, their sign, weights and how far they miss it."""
        for x, y, weight in blocks:
            for at in range(0, len(x), 8192):
                part, some = x[at : at + 8192], weight[at : at + 8192]
                gap = 1 - y * (part @ w[:-1] + w[-1])
                on = (gap > 0) & (some > 0)
                yield part[on], y, some[on], gap[on]

    def loss(w: np.ndarray) -> float:
        return 0.5 * w @ reg @ w + c * sum((weight * gap**2).sum() for _, _, weight, gap in short(w))

    for _ in range(50):
        h, g = reg.copy(), np.zeros(size)
        for x, y, weight, _ in short(w):
            x1 = np.hstack([x, np.ones((len(x), 1))])
            a = (2 * c * weight)[:, None] * x1
            h += a.T @ x1
            g += y * a.sum(0)
        step = np.linalg.solve(h, g) - w
        rate, now = 1.0, loss(w)
        while loss(w + rate * step) > now and rate > 1e-4:
            rate /= 2
        w = w + rate * step
        if np.abs(rate * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _sigmoid(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift."""
    weight = np.full(len(y), 1 / len(y))
    t, ab = (y > 0) * 0.98 + 0.01, np.array([1.0, 0.0])
    x = np.stack([f, np.ones_like(f)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -50, 50)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (t - p)) - 1e-4 * (ab - [1.0, 0.0]))
        ab = ab + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(ab[0]), 1e-3), float(ab[1])


def marks(units: list[str]) -> list[tuple[int, int]]:
    """The least hash of a document's three-word shingles under each of four seeds; none for a document without words."""
    if not units:
        return []
    h = np.array([zlib.crc32(" ".join(x).encode()) for x in zip(units, units[1:] or units, units[2:] or units)], np.uint64)
    seeds = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
    return [(seed, int(((h + np.uint64(1)) * np.uint64(seed) >> np.uint64(17)).min())) for seed in seeds]


def families(marked: list[list[tuple[int, int]]]) -> list[int]:
    """A number for each document, the same for near copies: documents are joined when any of their marks agree."""
    parent, owner = list(range(len(marked))), {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for n, some in enumerate(marked):
        for least in some:
            parent[top(n)] = top(owner.setdefault(least, n))
    return [top(n) for n in range(len(marked))]


def altered(word: str, random: np.random.Generator, n: int = 24) -> list[str]:
    """Ways to disguise a word: letters put in, doubled, left out or added at the end."""
    out, letters = [], "abcdefghijklmnopqrstuvwxyz"
    for _ in range(n):
        at, x, way = int(random.integers(1, len(word))), letters[random.integers(26)], int(random.integers(5))
        y = letters[random.integers(26)]
        out.append([word[:at] + x + word[at:], word[:at] + word[at - 1] + word[at:], word[:at] + word[at + 1 :] if len(word) > 5 else word, word + x + y, word[:1] + x + word[1:at] + y + word[at:]][way])
    return out


def segments(words: list[str], unit_of: dict[str, str]) -> Iterator[list[str]]:
    """Sentences of a text as lists of their different segments: words, joins of two short neighbours, and spelled-out
    words."""
    now: list[str] = []
    for w in [*words, None]:
        if w is not None:
            now.append(w)
        if now and (w is None or ends(w)):
            us = [unit_of[x] for x in now]
            both = [a + b for a, b in zip(us, us[1:]) if 0 < len(a) <= SHORT and 0 < len(b) <= SHORT]
            whole = [x for u in [*us, *both] if len(u) > 2 for x in windows(u)]
            lone = [u if len(u) != 1 or len(x) < 4 else "  " for u, x in zip(us, now)]
            if whole := whole + [x for r in spelled(lone) for x in windows(r)]:
                yield list(dict.fromkeys(whole))
            now = []


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS) -> Model:
    """Learns from the sentences of labelled documents, which inherit the label.

    The kernel of two sentences is a sum over pairs of their segments (a convolution of the gapped-subsequence kernel),
    each different segment counting once, so a sentence's row against the landmarks is the sum of its segments' rows, and Nystroem's map of it is the sum of
    theirs. Landmarks are the segments with the strongest evidence (a log-likelihood ratio): in how many families of toxic
    documents they are, against clean ones (near copies are one family, or a copied document's words would pass
    for insults), then clean segments that are nearest to those. Not every sentence of a toxic document is toxic: the one
    with the highest value is its witness and a positive example, as are others that the last round held for toxic;
    every sentence of clean ones is a negative example; witnesses are chosen anew a few times. So that gaps and
    inserted letters are tolerated, short sentences of altered forms of the strongest segments are positive examples as
    well, unless they are clean words.
    """
    unit_of: dict[str, str] = {}
    number_of: dict[str, int] = {}
    said: list[list[np.ndarray]] = []  # numbers of the segments of each sentence
    marked = []
    for text in texts:
        words = tokens(text)
        for w in set(words).difference(unit_of):
            unit_of[w] = unit(w)
        said.append([np.array([number_of.setdefault(u, len(number_of)) for u in s], np.int32) for s in segments(words, unit_of)])
        marked.append(marks([u for u in map(unit_of.__getitem__, words) if u]))
    names = list(number_of)
    del unit_of, number_of
    group = families(marked)
    number, count = [0, 0], (Counter(), Counter())
    together = defaultdict(list)
    for n, (g, label) in enumerate(zip(group, toxic)):
        together[label, g].append(n)
    for (label, _), members in together.items():
        number[label] += 1
        have = [s for n in members for s in said[n]]
        if have:
            count[label].update(names[k] for k in np.unique(np.concatenate(have)).tolist())
    good, bad = count
    share = number[1] / max(1, sum(number))

    def evidence(u: str) -> float:
        p, q = bad[u], good[u]
        return 2 * (p * np.log(p / ((p + q) * share)) + (q * np.log(q / ((p + q) * (1 - share))) if q else 0.0))

    strong = {u: e for u in sorted(bad) if bad[u] > 3 and bad[u] > 3 * good[u] * share / (1 - share + 1e-9) and (e := evidence(u)) > 22}
    tops = sorted(strong, key=lambda u: -strong[u])[: 2 * landmarks // 3]
    none = Model([], np.zeros(0, np.float32), -1.0)
    if not tops or share == 1:
        return none
    clean = sorted(u for u in good if u not in strong)
    who, rows = Kernel(tops).rows(clean)
    near = [clean[who[i]] for i in np.argsort(-rows.max(1, initial=0), kind="stable")[: landmarks - len(tops)]]
    kernel = Kernel(tops + near)
    gram = np.zeros((len(kernel.landmarks),) * 2)
    at, rows = kernel.rows(kernel.landmarks)
    gram[at] = rows
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = (vector @ np.diag(np.maximum(value, 1e-2) ** -0.5) @ vector.T).astype(np.float32)  # of the inverse: Nystroem's map
    every = sorted(good.keys() | bad.keys())
    place: dict[str, int] = {}
    maps, hints = [], []
    for k in range(0, len(every), 16384):  # only mapped rows are held
        at, rows = kernel.rows(every[k : k + 16384])
        place.update(zip((every[k + n] for n in at.tolist()), range(len(place), len(place) + len(at))))
        maps.append(rows @ root)
        hints.append(rows[:, : len(tops)].max(1, initial=0))
    mapped, hint = np.concatenate(maps), np.concatenate(hints)
    del maps, hints
    near_by = np.array([place.get(u, -1) for u in names], np.int64)
    del rows, every, names
    # Sentences with the same segments near landmarks are one row; those without any are row 0.
    rows_of: dict[tuple, int] = {(): 0}
    hits = [[rows_of.setdefault(tuple(np.unique(p[p >= 0]).tolist() if (p := near_by[s]).max(initial=-1) >= 0 else ()), len(rows_of)) for s in ss] for ss in said]
    del said
    keys = list(rows_of)
    x = np.zeros((len(keys), mapped.shape[1]), np.float32)
    f = np.zeros(len(keys))
    for k, hit in enumerate(keys):
        if hit:
            x[k], f[k] = mapped[list(hit)].sum(0), hint[list(hit)].max()
    del mapped, hint, rows_of, keys[:]
    calm = np.zeros(len(x))
    for rows, g, t in zip(hits, group, toxic):
        if not t:
            for k in set(rows):
                calm[k] += 0.5 / max(1, len(together[0, g]) ** 0.5)
    random = np.random.default_rng(5)
    forms = kernel.rows(sorted({w for u in tops for w in (u, *altered(u, random))} - set(good)))[1] @ root
    seen: dict[int, list[int]] = {}
    for rows, g, t in zip(hits, group, toxic):
        if t and any(rows):
            seen.setdefault(g, sorted({k for k in rows if k}))
    zero = np.zeros((1, len(root)), np.float32)
    also = np.zeros(len(x))
    for _ in range(4):
        held = np.zeros(len(x))
        for ks in seen.values():
            held[max(ks, key=lambda k: f[k])] += 2
        n = len(seen)
        w, bias = svm([(x, 1.0, held + also), (forms, 1.0, np.full(len(forms), n / max(1, len(forms)))), (x, -1.0, calm), (zero, -1.0, np.array([3.0 * n]))])
        f = np.concatenate([x[i : i + 8192] @ w for i in range(0, len(x), 8192)]) + bias
        also = np.zeros(len(x))
        for ks in seen.values():
            for k in ks:
                also[k] += f[k] > 0
    alpha = root @ w
    model = Model(kernel.landmarks, alpha.astype(np.float32), bias)
    top = np.array([max([bias, *f[[k for k in rows if k]]]) for rows in hits])
    model.slope, model.shift = _sigmoid(top, np.array([1.0 if t else -1.0 for t in toxic]))
    return model


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = BYTES) -> tuple[list[str], list[int]]:
    """At most `sample` documents of each label, those with the least hash of doc_id, without held-out ones, and at most
    `most` bytes of text together: what the driver gets is bounded. Of documents that repeat with an id one is taken, the
    shortest; of an id's labels one."""
    want = pick(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    want = want.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    order = F.xxhash64("doc_id")
    some = [want.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    few = F.broadcast(some[0].unionByName(some[1]))  # 2 * sample rows at most
    found = pick(docs, doc_id=id_col, text=text_col).where("text is not null").join(few, "doc_id")
    size = F.octet_length("text").cast("long")
    sized = found.groupBy("doc_id", "label").agg(F.min(F.struct(size.alias("n"), F.xxhash64("text").alias("h"))).alias("t"))
    rows = sorted(sized.select("doc_id", "label", "t.n", "t.h", order.alias("o")).collect(), key=lambda r: (r["o"], r["doc_id"]))
    upto = np.cumsum([r["n"] for r in rows])
    taken = [(r["doc_id"], r["label"], r["h"]) for r, n in zip(rows, upto) if n <= most]
    if not taken:
        return [], []
    kinds = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, label {found.schema['label'].dataType.simpleString()}, h bigint"
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, kinds))
    texts = pick(docs, doc_id=id_col, text=text_col).where("text is not null").withColumn("h", F.xxhash64("text")).join(chosen, ["doc_id", "h"])
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = sorted((r["doc_id"], r["text"], int(r["label"])) for r in texts.toLocalIterator())
    return [t for _, t, _ in got], [k for _, _, k in got]


def _scorer(model: Model) -> Scorer:
    """One for each worker process and model."""
    mine = memory.setdefault("toxicity", {})
    key = (tuple(model.landmarks), model.alpha.tobytes(), model.bias, WORDS)
    if key not in mine:
        mine.clear()
        mine[key] = Scorer(model)
    return mine[key]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row, by its whole text alone; null texts count as empty."""
    base = pick(docs, doc_id=id_col, text=text_col)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for b in batches:
            who = b.column(0).to_pylist()
            parts = (b.column(1).slice(k, PART).to_pylist() for k in range(0, b.num_rows, PART))
            s = [model.score(v) for texts in parts for v in scorer.values([t or "" for t in texts])]
            out = [b.column(0), pa.array([held_out(d) for d in who]), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    return on_batches(base, run, f"doc_id {kind}, held_out boolean, score double, predicted int", "toxicity")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs that score below one half, with all columns."""
    model = train(*labelled(docs, labels, sample, id_col, text_col, label_col))
    plain, at, names = numbered(docs, text=text_col)
    place = plain.columns.index(at["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for b in batches:
            parts = (b.column(place).slice(k, PART).to_pylist() for k in range(0, b.num_rows, PART))
            s = [model.score(v) for texts in parts for v in scorer.values([t or "" for t in texts])]
            yield b.filter(pa.array([x < 0.5 for x in s], pa.bool_()))

    return on_batches(plain, run, plain.schema, "toxicity").toDF(*names)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learns on the driver from at most 2 * `sample` labelled documents (`labelled`; held-out ones never), then scores
    every whole text. Null and empty texts get the score of a text without any hit; rows that repeat get equal
    scores; without usable labels every score is below one half. A null id isn't held out unless its text "None"
    hashes so. An empty table gives no rows; other columns are ignored.
    """
    return score(docs, train(*labelled(docs, labels, sample, id_col, text_col, label_col)), id_col, text_col)
