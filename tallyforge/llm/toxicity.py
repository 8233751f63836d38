"""Toxicity of whole texts: a noisy channel is undone by Viterbi decoding, and the restored text is scored.

1. ``character_model`` counts byte 4-grams (letters lower-cased, all else a blank) over all documents exactly: per-task sums, one
   shuffle, 12 bytes per distinct 4-gram on the driver; counts of shorter n-grams are sums over the 4-grams that begin with them.
2. ``Decoder.restore`` finds tokens that look disguised (leetspeak signs among letters, letters parted by blanks or signs, repeated
   letters), builds the lattice of what each may stand for, and replaces it by the most likely path under the character model.
   Other tokens have one path and stay.
3. ``fit`` learns which words and word beginnings speak for the label on a bounded sample of labelled rows; ``score`` weighs the sum
   of evidence of a text's distinct words and its strongest word against the number of distinct words, since a long text meets weak
   evidence by chance, and turns them into a probability.

Id, language, source and label never enter a score.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.llm.rolling import _BYTE, _LOWER, Words, mix, pieces, powers, text_buffer

ORDER = 4
#: What a sign may stand for among letters (fixed values).
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li",
         "+": "t", "€": "e", "£": "l", "(": "c", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h"}
_VOWELS = "aeiou"
_CORE, _INNER, _SEPARATOR = b"0123456789@$", b"!|+(*", b".-_*~/,:;'"


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_IS_CORE, _IS_INNER, _IS_SEP = _class(_CORE), _class(_INNER), _class(_SEPARATOR)
_IS_CLOSE = _class(b".!?,;:")
_IS_SPACE = _class(b" \t\n\r\x0b\x0c")
_IS_LETTER = _class(bytes([*range(65, 91), *range(97, 123)]))
_LEAD = _class(bytes(range(0xC2, 0xF5)))  # first byte of a character beyond ASCII
_LOW_BLANK = np.where((_LOWER == 0) | ((_LOWER >= 48) & (_LOWER <= 57)), 32, _LOWER).astype(np.uint8)


@dataclass
class Grams:
    """Distinct 4-grams of a corpus (sorted, most significant byte first) and the sum of the counts of all before each."""

    keys: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray) -> Grams:
        order = np.argsort(keys)
        return Grams(keys[order].astype(np.uint32), np.append(0, np.cumsum(counts[order])).astype(np.int64))

    def count(self, gram: bytes) -> float:
        """How often an n-gram of 1 to 4 bytes occurs."""
        shift = 8 * (ORDER - len(gram))
        first = int.from_bytes(gram, "big") << shift
        low = np.searchsorted(self.keys, np.uint32(first))
        high = np.searchsorted(self.keys, np.uint32(first + (1 << shift) - 1), side="right")
        return float(self.before[high] - self.before[low])

    @property
    def total(self) -> float:
        return float(max(1, self.before[-1]))


def _codes(low: np.ndarray) -> np.ndarray:
    """The 4-gram that begins at every byte; blanks follow the last one."""
    padded = np.append(low, np.full(ORDER - 1, 32, np.uint8)).astype(np.uint32)
    return (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def character_model(docs: DataFrame) -> Grams:
    """Exact counts over all texts, three blanks before and after each, so that they do not depend on partitions. Null and empty texts add nothing but blanks.

    A task holds the distinct 4-grams of its own texts, the driver those of all: their number grows with the corpus's letters and
    scripts, far slower than its texts.
    """
    def count(batches):
        held, size = [], 0
        for batch in batches:
            buf, offsets = text_buffer(batch.column("text"))
            for _, _, part, own in pieces(buf, offsets):
                low = np.full(len(part) + (ORDER - 1) * (len(own) - 1), 32, np.uint8)
                low[np.arange(len(part)) + (ORDER - 1) * np.searchsorted(own, np.arange(len(part)), side="right")] = _LOW_BLANK[part]
                held.append(np.unique(_codes(low), return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [_merged(held)]
                    size = min(len(held[0][0]), 1_000_000)
        keys, counts = _merged(held) if held else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        for a in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:a + 50_000].astype(np.int64)), pa.array(counts[a:a + 50_000])], ["gram", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return Grams.of(found.column("gram").to_numpy(), found.column("n").to_numpy())


class Decoder:
    """Restores disguised tokens under a character model."""

    def __init__(self, table: Grams):
        self.table = table
        self.known: dict[bytes, float] = {}
        self.memory: dict[str, str] = {}

    def step(self, context: bytes, byte: bytes) -> float:
        """Log probability of a byte after (at most) three bytes, interpolated over the orders."""
        key = context + byte
        got = self.known.get(key)
        if got is None:
            p = (self.table.count(byte) + 0.5) / (self.table.total + 128)
            for k in range(1, len(context) + 1):
                part = context[-k:]
                p = (self.table.count(part + byte) + 4 * p) / (self.table.count(part) + 4)
            got = self.known[key] = float(np.log(max(p, 1e-12)))
            if len(self.known) > 200_000:
                self.known.clear()
        return got

    @staticmethod
    def choices(observed: str) -> list[list[tuple[str, float]]]:
        """The lattice of an observed word: what every run of equal characters may stand for, and its log cost."""
        lattice = []
        for char, many in [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", observed, re.S)]:
            if char == "*":
                lattice.append([(v * many, -1.5 * many) for v in _VOWELS] if many <= 2 else [("", -3.0)])
                continue
            letters = [(c, -0.2) for c in SIGNS.get(char, "")] + ([(char, 0.0)] if char.isalpha() else [(char, -6.0)])
            options = []
            for c, cost in letters:
                if many == 1:
                    options.append((c, cost))
                else:  # one or two of a run may be meant
                    options += [(c, cost - (1.0 if many == 2 else 0.3)), (c * 2, cost - (0.2 if many == 2 else 0.8))]
            if many > 1 and char.isdigit():
                options.append((char * many, -6.0 * many))
            lattice.append(options)
        return lattice

    def decode(self, observed: str) -> str:
        """The most likely intended word for what is observed (lower case, without separators)."""
        states: dict[bytes, tuple[float, str]] = {b" ": (0.0, "")}
        for options in self.choices(observed):
            following: dict[bytes, tuple[float, str]] = {}
            for context, (score, text) in states.items():
                for piece, cost in options:
                    value, where = score + cost, context
                    for b in piece.encode():
                        one = bytes([b])
                        one = b" " if one.isdigit() else one
                        value += self.step(where, one)
                        where = (where + one)[-3:]
                    best = following.get(where)
                    if best is None or value > best[0]:
                        following[where] = (value, text + piece)
            states = following
        return max(((score + self.step(context, b" "), text) for context, (score, text) in states.items()), default=(0.0, ""))[1]

    def word(self, token: str) -> str:
        """A disguised token restored; what is not part of the word at its ends is cut off."""
        got = self.memory.get(token)
        if got is None:
            inner = re.sub(r"[^\w@$!|+€£*(]|_", "", token.lower().strip(".,;:!?\"'()[]{}<>*#%&-_/\\"))
            got = self.decode(inner) if inner else ""
            if len(self.memory) > 100_000:
                self.memory.clear()
            self.memory[token] = got
        return got

    def restore(self, part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of a piece of texts with disguised tokens replaced."""
        if not len(part):
            return part, own
        spans = disguised(part, own)
        if not spans:
            return part, own
        raw, out, at = part.tobytes(), [], 0
        change = np.zeros(len(own), np.int64)
        for a, b, doc in spans:
            token = raw[a:b].decode("utf-8", "replace")
            new = self.word(token).encode() or b" "
            out += [raw[at:a], new]
            change[doc + 1] += len(new) - (b - a)
            at = b
        out.append(raw[at:])
        return np.frombuffer(b"".join(out), np.uint8), own + np.cumsum(change)


def disguised(part: np.ndarray, own: np.ndarray) -> list[tuple[int, int, int]]:
    """(first byte, byte after the last, text) of tokens, or runs of one-letter tokens, that look disguised."""
    n = len(part)
    solid = ~_IS_SPACE[part]
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    begins = own[:-1][own[:-1] < n]
    fresh[begins] = solid[begins]
    start = np.flatnonzero(fresh)
    if not len(start):
        return []
    after = np.zeros(n + 1, bool)
    after[1:n] = ~solid[1:]
    after[begins[begins > 0]] = True
    after[n] = True
    stops = np.flatnonzero(after)
    stop = stops[np.searchsorted(stops, start, side="right")]

    def per_token(flag: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flag))
        return total[stop] - total[start]

    letter = _IS_LETTER[part] | _LEAD[part]
    core = _IS_CORE[part]
    beside = np.zeros(n, bool)
    beside[:-1] |= letter[1:] | core[1:]
    inner = _IS_INNER[part] & beside
    inner[0] = False
    inner[1:] &= letter[:-1] | core[:-1] | _IS_INNER[part[:-1]]
    low = _LOW_BLANK[part]
    same = np.zeros(n, bool)
    same[1:] = (low[1:] == low[:-1]) & letter[1:] & solid[:-1]
    triple = same.copy()
    triple[1:] &= same[:-1]
    letters, signs = per_token(letter), per_token(core | inner)
    sep = _IS_SEP[part] & beside
    sep[1:] &= letter[:-1] | core[:-1] | _IS_SEP[part[:-1]]
    seps = per_token(sep)
    # a sign counts among letters: "version 3." or "4.0" have none
    odd = (letters > 0) & (signs > 0) | (per_token(triple) > 0) | (per_token(same) >= 3) | (seps >= 2) & (letters + signs <= seps + 1) & (letters >= 2)
    odd |= per_token((part == 0xE2) | (part == 0xC2) & np.append(part[1:] == 0xAD, False)) > 0 if (part == 0xE2).any() or (part == 0xC2).any() else False
    odd |= (letters > 0) & (per_token((part == 0xD0) | (part == 0xD1)) > 0) & (per_token(_IS_LETTER[part]) > 0)
    doc = np.searchsorted(own, start, side="right") - 1
    # letters parted by blanks: tokens of one ASCII letter or sign; a closing mark ends the run
    lone = (per_token(_IS_LETTER[part] | core) == 1) & (stop - start <= 2) & (per_token(part >= 128) == 0)
    closed = _IS_CLOSE[part[stop - 1]]
    spans, odd_at = [], np.flatnonzero(odd | lone)
    taken = -1
    for k in odd_at:
        if k <= taken:
            continue
        if lone[k]:
            end = k
            while end + 1 < len(start) and lone[end + 1] and doc[end + 1] == doc[k] and not closed[end]:
                end += 1
            if end - k >= 2:
                spans.append((int(start[k]), int(stop[end]), int(doc[k])))
                taken = end
                continue
            taken = end
        if odd[k]:
            spans.append((int(start[k]), int(stop[k]), int(doc[k])))
    return spans


PREFIXES = (4, 5, 6, 7)


def word_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashes): for every distinct word of a text one row with the hashes of the word and of its first bytes."""
    words = Words(buf, offsets)
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros((0, 1 + len(PREFIXES)), np.uint64)
    doc = words.doc()
    order = np.lexsort((words.hash, doc))
    keep = np.append(True, (doc[order][1:] != doc[order][:-1]) | (words.hash[order][1:] != words.hash[order][:-1]))
    at = np.sort(order[keep])
    low = _LOWER[buf]
    inside = np.flatnonzero(low != 0)
    fresh = np.append(True, np.diff(inside) > 1)
    begins = offsets[:-1][offsets[:-1] < len(buf)]
    fresh |= np.isin(inside, begins)
    start = inside[fresh][at]
    end = np.append(inside[np.flatnonzero(fresh)[1:] - 1], inside[-1])[at] + 1
    out = np.zeros((len(at), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = words.hash[at]
    weight = powers(np.uint64(0x9E3779B97F4A7C15), max(PREFIXES))
    total = np.zeros(len(at), np.uint64)
    padded = np.append(low, np.zeros(max(PREFIXES), np.uint8))
    for k in range(max(PREFIXES)):
        total = total + _BYTE[padded[start + k]] * weight[k]
        if k + 1 in PREFIXES:
            j = PREFIXES.index(k + 1) + 1
            out[:, j] = np.where(end - start > k + 1, mix(total + np.uint64(k + 77)), 0)
    return doc[at], out


def curve_inputs(total: np.ndarray, top: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the probability of a text rests on: its summed and its strongest evidence and, where there is any, its number of distinct words."""
    return np.column_stack([np.log1p(total), top, np.where(total > 0, np.log1p(words), 0.0), np.ones(len(total))])


#: Evidence may only raise a score, and length only lower it.
_SIGNS_OF_CURVE = np.array([1.0, 1.0, -1.0, 0.0])


def length_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a logistic curve over ``curve_inputs`` (Newton steps, halved while they do not help); one of the wrong sign is left out."""
    used = np.ones(x.shape[1], bool)
    while True:
        own, beta = x[:, used], np.zeros(int(used.sum()))
        penalty = np.append(np.full(len(beta) - 1, ridge), 1e-6)

        def loss(b: np.ndarray) -> float:
            z = own @ b
            return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * b * b).sum() / 2)

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(own @ beta, -40, 40)))
            hess = own.T @ (own * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + np.diag(penalty)
            step, now = np.linalg.solve(hess, own.T @ (weight * (p - y)) + penalty * beta), loss(beta)
            while np.abs(step).max() > 1e-9 and loss(beta - step) > now:
                step = step / 2
            beta = beta - step
            if np.abs(step).max() < 1e-8:
                break
        full = np.zeros(x.shape[1])
        full[used] = beta
        wrong = full * _SIGNS_OF_CURVE < 0
        if not wrong.any():
            return full
        used &= ~wrong


@dataclass
class Model:
    """Evidence of features (sorted hashes and weights) and the logistic curve over a text's evidence and length."""

    keys: np.ndarray
    weights: np.ndarray
    curve: np.ndarray

    def evidence(self, doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """``curve_inputs`` of texts by the strongest evidence of each of their distinct words."""
        words = np.bincount(doc, minlength=n).astype(float) if len(doc) else np.zeros(n)
        if not len(self.keys) or not len(doc):
            return curve_inputs(np.zeros(n), np.zeros(n), words)
        best = np.zeros(len(doc))
        for j in range(hashes.shape[1]):
            h = hashes[:, j]
            some = np.flatnonzero(self.screen[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            hit = self.keys[at] == h[some]
            best[some[hit]] = np.maximum(best[some[hit]], self.weights[at[hit]])
        top = np.zeros(n)
        np.maximum.at(top, doc[best > 0], best[best > 0])
        return curve_inputs(np.bincount(doc, weights=best, minlength=n), top, words)

    def __post_init__(self):
        self.screen = np.zeros(1 << 20, bool)
        self.screen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def probability(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.curve, -40, 40)))


def _bound(ones: np.ndarray, zeros: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """A lower bound of the log odds of a feature: one standard deviation below the smoothed value."""
    ones, zeros = np.maximum(ones, 0) + 0.5, np.maximum(zeros, 0) + 0.5
    return np.log(ones / (n1 + 1)) - np.log(zeros / (n0 + 1)) - np.sqrt(1 / ones + 1 / zeros)


def copies(rows: list[np.ndarray]) -> np.ndarray:
    """A group number per text: texts that share two MinHash values of a pair of their word sets are taken as copies."""
    from tallyforge.llm.shared import root_of

    parent = list(range(len(rows)))
    seen: dict[tuple, int] = {}
    for i, r in enumerate(rows):
        if not len(r):
            continue
        for k in range(6):
            key = (k, *(int(mix(r[:, 0] + np.uint64(1000 * k + s)).min()) for s in (1, 2)))
            other = root_of(parent, seen.setdefault(key, i))
            own = root_of(parent, i)
            parent[max(own, other)] = min(own, other)
    return np.array([root_of(parent, i) for i in range(len(rows))], np.int64)


def group_counts(rows: list[np.ndarray], y: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, groups of label 1, groups of label 0) of the features in two groups of label 1 or more."""
    def counts(label: int) -> tuple[np.ndarray, np.ndarray]:
        total: dict[int, list[np.ndarray]] = {}
        for r, v, g in zip(rows, y, group, strict=True):
            if v == label:
                total.setdefault(int(g), []).append(np.unique(r[r != 0]))
        own = [np.unique(np.concatenate(s)) if len(s) > 1 else s[0] for s in total.values()]
        return np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    keys, ones = counts(1)
    keys, ones = keys[ones > 1], ones[ones > 1]
    other, many = counts(0)
    at = np.minimum(np.searchsorted(other, keys), max(len(other) - 1, 0))
    zeros = np.where(other[at] == keys, many[at], 0) if len(other) else np.zeros(len(keys), np.int64)
    return keys, ones, zeros


def train(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, least: float = 2.0) -> Model:
    """The model of feature rows (one array of words x features per text); texts are left out of their own evidence.

    A feature counts from a bound of ``least`` on. With one class only every score is the smoothed share of class 1.
    """
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    share = (n1 + 1) / (n1 + n0 + 2)
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))]))
    if not n1 or not n0:
        return flat
    group = copies(rows)
    keys, ones, zeros = group_counts(rows, y, group)
    n1, n0 = float(len(np.unique(group[y == 1]))), float(len(np.unique(group[y == 0])))
    weights = _bound(ones, zeros, n1, n0)
    good = weights >= least
    keys, ones, zeros, weights = keys[good], ones[good], zeros[good], weights[good]
    if not len(keys):
        return flat
    seen = np.zeros((len(y), 3))
    for i, (r, v) in enumerate(zip(rows, y, strict=True)):
        if not len(r):
            continue
        at = np.minimum(np.searchsorted(keys, r), len(keys) - 1)
        mine = _bound(ones[at] - (v == 1), zeros[at] - (v == 0), n1, n0)
        best = np.where((keys[at] == r) & (mine >= least), mine, 0).max(1)
        seen[i] = best.sum(), best.max(), len(r)
    return Model(keys, weights, length_curve(curve_inputs(*seen.T), y.astype(float), weight))


def fit(docs: DataFrame, labels: DataFrame, label: str, table: Grams, max_ones: int = 3000, max_zeros: int = 5000) -> Model:
    """Fit on at most ``max_ones`` and ``max_zeros`` labelled documents, those of the smallest id hash of either label.

    Their ids are broadcast (bounded by the parameters); classes are weighted by how much of them was left out.
    """
    own = labels.select(F.col("doc_id").alias("train_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("train_id").isNotNull()).dropDuplicates(["train_id"])
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = {v: own.where(F.col("y") == v).orderBy(F.xxhash64("train_id"), "train_id").limit(m) for v, m in ((1, max_ones), (0, max_zeros))}
    picked = docs.select("doc_id", "text").join(F.broadcast(part[1].unionByName(part[0])), F.col("doc_id") == F.col("train_id")).select("train_id", "text", "y")
    scale = {v: max(1.0, sizes.get(v, 0) / m) for v, m in ((1, max_ones), (0, max_zeros))}
    low = min(scale.values())
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def features(batches):
        own = Decoder(shared.value)
        for batch in batches:
            buf, offsets = text_buffer(batch.column("text"))
            for i, j, text, cut in pieces(buf, offsets):
                doc, hashes = word_features(*own.restore(text, cut))
                at = np.searchsorted(doc, np.arange(j - i + 1))
                rows = [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("train_id").slice(i, j - i).cast(pa.int64()), batch.column("y").slice(i, j - i), pa.array(rows, pa.binary())], ["train_id", "y", "f"])

    def learn(batches):
        got = [(i, y, f) for b in batches for i, y, f in zip(b.column("train_id").to_pylist(), b.column("y").to_pylist(), b.column("f").to_pylist(), strict=True)]
        got.sort()
        rows = [np.frombuffer(f, np.uint64).reshape(-1, 1 + len(PREFIXES)) for _, _, f in got]
        y = np.array([v for _, v, _ in got], int)
        model = train(rows, y, np.array([scale[v] / low for v in y.tolist()]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.keys, model.weights, model.curve))], pa.binary())], ["model"])

    raw = picked.mapInArrow(features, "train_id long, y int, f binary").repartition(1).mapInArrow(learn, "model binary").first()
    return Model(*pickle.loads(bytes(raw["model"]))) if raw else train([], np.zeros(0, int), np.zeros(0))


def score(docs: DataFrame, model: Model, table: Grams, out: str = "score") -> DataFrame:
    """``docs`` with the probability of the label for every whole text; null and empty texts have no evidence.

    A column named ``out`` is replaced. One pass without a shuffle; repeated rows get equal scores.
    """
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.curve, table))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def add(batches):
        keys, weights, curve, own_table = shared.value
        own, decoder = Model(keys, weights, curve), Decoder(own_table)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
            found = [own.probability(own.evidence(*word_features(*decoder.restore(part, cut)), j - i)) for i, j, part, cut in pieces(buf, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], [*batch.schema.names, out])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(add, schema)
