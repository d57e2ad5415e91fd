"""Quality rules: gradient-boosted trees over document statistics, after plain limits."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import on_batches, pick

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees see, and how a score may follow it: 1 never falls as it grows, -1 never rises, 0 is free.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "lines_per_word": 0,
    "upper_share": 0,
    "digit_share": 0,
    "bang_share": -1,
    "bar_share": 0,
    "stop_share": 0,
    "comma_share": 0,
    "distinct_share": 0,
    "top_word_share": -1,
    "longest_word": 0,
    "other_byte_share": 0,
}
#: Labelled documents that training reads at most, taken by hash.
SAMPLE = 8000
_SYMBOLS, _SPACES = np.frombuffer(b"#*$%&|<>", np.uint8), np.array([9, 10, 11, 12, 13, 32])


def repeated(ids: np.ndarray, kinds: int) -> int:
    """Words in three-word windows that are found twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-2] * kinds + ids[1:-1]
    if kinds >= 1 << 20:  # else three numbers fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair * kinds + ids[2:]
    s = np.sort(code)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, code), len(twice) - 1)
    hit = twice[at] == code
    cover = np.zeros(len(ids), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five base numbers and the features of a whole text."""
    b = text.encode("utf-8", "replace")
    words = b.split()
    n = len(words)
    bytes_ = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    chars = len(text) - int(bytes_[_SPACES].sum())
    symbols = int(bytes_[_SYMBOLS].sum())
    lines = [x for x in b.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = repeated(ids, max(1, len(number)))
    c, m = max(1, chars), max(1, n)
    top = int(np.bincount(ids).max()) if n else 0
    ends = int(bytes_[[33, 46, 63]].sum())
    x = [np.log1p(n), chars / m, symbols / m, dups / max(1, len(lines)), repeats / m, len(lines) / m, bytes_[65:91].sum() / c, bytes_[48:58].sum() / c,
         bytes_[33] / m, bytes_[124] / m, ends / m, bytes_[44] / m, len(number) / m, top / m, max(map(len, words), default=0), bytes_[128:].sum() / c]
    return [n, chars, symbols, dups, repeats], [float(v) for v in x]


@dataclass
class Trees:
    """Complete trees of one depth in heap order: node k has children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # goes right when above
    leaf: np.ndarray  # trees x leaves
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of all rows: each level of all trees in one step."""
        depth, trees = int(np.log2(self.leaf.shape[1])), np.arange(len(self.leaf))
        out = np.empty(len(x))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            node = np.zeros((len(part), len(trees)), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[lo : lo + 4096] = self.start + self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(1)
        return out


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0, least: float = 4.0) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins. A split of a feature with a sign is taken only if
    its sides' values keep the order, and what hangs below a side stays on its side of their middle."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    p = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(p / (1 - p)))
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(len(y), start)
    value = lambda g, h: -g / (h + ridge)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = q - y, np.maximum(q * (1 - q), 1e-6)
        node, low, high = np.zeros(len(y), np.int64), {0: -np.inf}, {0: np.inf}
        for k in range(inner):
            at = np.flatnonzero(node == k)
            lo, hi = low[k], high[k]
            best = (1e-6, None)
            if len(at):
                g0, h0 = grad[at].sum(), hess[at].sum()
                base = g0 * g0 / (h0 + ridge)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[at, j], grad[at], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[at, j], hess[at], len(e) + 1))[:-1]
                    gr, hr = g0 - gl, h0 - hl
                    ok = (hl >= least / 4) & (hr >= least / 4)
                    vl, vr = np.clip(value(gl, hl), lo, hi), np.clip(value(gr, hr), lo, hi)
                    if signs[j]:
                        ok &= signs[j] * (vr - vl) >= 0
                    gain = np.where(ok, gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - base, -1)
                    s = int(np.argmax(gain))
                    if gain[s] > best[0]:
                        best = (gain[s], (j, s, vl[s], vr[s]))
            left, right = 2 * k + 1, 2 * k + 2
            low[left], high[left], low[right], high[right] = lo, hi, lo, hi
            if best[1]:
                j, s, vl, vr = best[1]
                feature[t, k], threshold[t, k] = j, edges[j][s]
                if signs[j]:
                    mid = (vl + vr) / 2
                    (high if signs[j] > 0 else low)[left] = mid
                    (low if signs[j] > 0 else high)[right] = mid
                node[at] = np.where(binned[at, j] > s, right, left)
            else:
                node[at] = left
        for k in range(inner + 1):
            at = node == inner + k
            v = value(grad[at].sum(), hess[at].sum()) if at.any() else 0.0
            leaf[t, k] = rate * np.clip(v, low[inner + k], high[inner + k])
        margin += leaf[t, node - inner]
    return Trees(feature, threshold, leaf, start)


def train(x: np.ndarray, good: np.ndarray) -> Trees:
    """Without labels of both kinds the trees keep everything."""
    if len(set(good.tolist())) < 2:
        return Trees(np.zeros((1, 1), np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)), 1.0)
    return fit(x, good.astype(float), list(FEATURES.values()))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `sample` labelled documents, those with the least hash of the id; every fifth
    (crc32 of the id) is held out. Statistics are made on the executors and only they are fetched, one row for an id: of
    documents that repeat with an id the one with the least statistics, of its labels the least."""
    want = pick(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    want = want.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    few = F.broadcast(want.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # `sample` rows at most
    found = pick(docs, doc_id=id_col, text=text_col).where("text is not null").join(few, "doc_id").select("doc_id", "label", "text")
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py())[1] for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    each = on_batches(found, run, f"doc_id {kind}, label int, x array<double>").groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    rows = sorted(each.collect(), key=lambda r: r["doc_id"])
    return np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows], np.int64)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept for every row.

    base_failed: fewer than 50 words, or over half of the words repeat in three-word windows. Else the trees,
    trained on the driver from at most `sample` labelled documents, decide by the whole text's statistics; more
    symbols, repeats, repeated lines or exclamation marks never raise a score. Null and empty texts have no words
    and fail. Rows that repeat give equal rows; an empty table gives no rows; other columns are ignored.
    """
    trees = train(*labelled(docs, labels, sample, id_col, text_col, label_col))
    base = pick(docs, doc_id=id_col, text=text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *BASE, "base_failed", "score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [statistics(t.as_py() or "") for t in b.column(1)]
            n = np.array([x for x, _ in both], np.int64).reshape(-1, 5)
            failed = (n[:, 0] < 50) | (100 * n[:, 4] > 50 * n[:, 0])
            score = 1 / (1 + np.exp(-trees.margins(np.array([x for _, x in both]).reshape(-1, len(FEATURES)))))
            cols = [b.column(0), *(pa.array(n[:, k]) for k in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return on_batches(base, run, f"doc_id {kind}, {', '.join(f'{x} bigint' for x in BASE)}, base_failed boolean, score double, kept boolean")
