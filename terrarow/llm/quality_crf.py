r"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Viterbi decoding marks every line with a word; a document is kept if the share of its words on content lines is at
least min_share and the base rules hold. The field is trained in numpy on the lines of a bounded sample of labelled
documents (MAX_TRAIN, MAX_TRAIN_LINES, the documented bounds, taken by a hash of the id). Only documents are labelled,
so their lines' labels are found in rounds: at first a line has its document's label, but a line that occurs before in
its text, or in SHARED documents of the sample, is boilerplate; a field is fitted, and lines whose marginal is sure of
the other label take it, as long as at least CLEAN_SHARE of a clean document's words stay content and at most
JUNK_SHARE of another one's become it. Chains so change state within documents, and the transitions learn from it.
Features are taken of every whole line of every whole text.

Words are runs of characters other than space and \t-\r. Edge cases: null or empty text has no words and fails the
base rule; labels other than 0 and 1 are ignored, and a table without usable ones keeps what the base rules keep;
repeated rows are judged alike; texts of any length are judged whole; an empty table gives no rows; ids and
other columns never influence a verdict.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table
from .textual import as_bytes, shingle_hashes, word_hashes

#: Labelled documents that the field is fitted on, and lines of each, at most.
MAX_TRAIN, MAX_TRAIN_LINES = 3000, 400
#: Share of the clean documents of the fit that the decoding must keep.
KEEP_CLEAN = 0.999
#: Documents of the sample from which a common line is boilerplate; shares that relabelled lines leave; how sure.
SHARED, CLEAN_SHARE, JUNK_SHARE, SURE = 3, 0.75, 0.25, 0.9
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_SHARE = 50, 50, 0.5
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SYMBOL_BYTE = np.zeros(256, bool)
_SYMBOL_BYTE[[ord(c) for c in "#*$%&|<>"]] = True
_START_BYTE = np.ones(256, bool)
_START_BYTE[0x80:0xC0] = False
N_FEATURES = 15


@dataclass(frozen=True)
class Base:
    """Counts of one text by the base rules, and where its words and lines are."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    line_of_word: np.ndarray
    repeated: np.ndarray  # by word
    dup_line: np.ndarray  # by line with a word

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def base_counts(text: str | None) -> Base:
    data = as_bytes(text)
    words, starts, ends = word_hashes(data)
    n = len(words)
    chars = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(_START_BYTE[data], out=chars[1:])
    repeated = np.zeros(n, bool)
    if n >= 4:
        _, group, count = np.unique(shingle_hashes(words, 3), return_inverse=True, return_counts=True)
        again = count[group] > 1
        for j in range(3):
            repeated[j : j + len(again)] |= again
    # lines with a word, told apart by their bytes
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts)
    used = np.unique(line)
    seen, dup = set(), np.zeros(len(used), bool)
    raw = data.tobytes()
    for i, k in enumerate(used.tolist()):
        own = raw[0 if k == 0 else breaks[k - 1] + 1 : breaks[k] if k < len(breaks) else len(raw)]
        dup[i] = own in seen
        seen.add(own)
    return Base(n, int((chars[ends] - chars[starts]).sum()), len(_SYMBOLS.findall(text or "")), int(dup.sum()), int(repeated.sum()), data, starts, ends, np.searchsorted(used, line), repeated, dup)


def lines_of(b: Base) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, and hashes from the first to the last word, of the lines with a word."""
    first = np.searchsorted(b.line_of_word, np.arange(len(b.dup_line)))
    words = np.diff(np.append(first, b.n_words))
    raw = b.data.tobytes()
    keys = [xxhash.xxh3_64_intdigest(raw[b.starts[i] : b.ends[i + n - 1]]) for i, n in zip(first.tolist(), words.tolist())]
    return words, np.array(keys, np.uint64)


def line_features(b: Base) -> np.ndarray:
    """One row of N_FEATURES for each line with a word."""
    n = len(b.dup_line)
    out = np.zeros((n, N_FEATURES))
    if not n:
        return out
    first = np.searchsorted(b.line_of_word, np.arange(n))
    lo, hi = b.starts[first], b.ends[np.append(first[1:], b.n_words) - 1]
    sums = lambda mask: np.add.reduceat(np.append(mask, False), np.stack([lo, hi], 1).ravel(), dtype=np.int64)[::2]
    d = b.data
    size = (hi - lo).astype(float)
    words = np.diff(np.append(first, b.n_words)).astype(float)
    upper = sums((d >= 65) & (d <= 90))
    lower = sums((d >= 97) & (d <= 122))
    by_word = lambda mask: np.add.reduceat(mask.astype(float), first)
    last = d[b.ends - 1]
    out[:, 0] = 1
    out[:, 1] = np.minimum(np.log1p(words), 6) / 3
    out[:, 2] = np.minimum(5 * sums(_SYMBOL_BYTE[d]) / size, 3)
    out[:, 3] = upper / np.maximum(upper + lower, 1)
    out[:, 4] = np.minimum(8 * sums((d >= 48) & (d <= 57)) / size, 3)
    out[:, 5] = by_word(b.repeated) / words
    out[:, 6] = b.dup_line
    out[:, 7] = np.minimum(20 * sums(d == ord("!")) / size, 3)
    out[:, 8] = np.minimum(20 * sums(d == ord("|")) / size, 3)
    out[:, 9] = by_word((last == 46) | (last == 44)) / words * 3
    out[:, 10] = words < 4
    out[:, 11] = np.isin(d[hi - 1], [46, 33, 63, 58, 34])
    out[:, 12] = size / words / 8
    out[:, 13] = np.minimum(10 * sums((d == ord("/")) | (d == ord("@")) | (d == ord("="))) / size, 3)
    out[:, 14] = by_word(_SYMBOL_BYTE[last]) / words
    return out


@dataclass(frozen=True)
class LineField:
    """State 1 is content, 0 boilerplate. Emissions w . f for state 1, 0 for state 0; move[a, b] from a to b."""

    w: np.ndarray
    move: np.ndarray

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        gain = features @ self.w
        # two states: the decoding needs only the difference of the best scores of 1 and 0
        m = self.move
        best, back = 0.0, np.zeros((len(gain), 2), bool)
        for i, g in enumerate(gain.tolist()):
            if i == 0:
                best = g
                continue
            to0, to1 = (m[0, 0], best + m[1, 0]), (m[0, 1], best + m[1, 1])
            back[i] = to0[1] > to0[0], to1[1] >= to1[0]
            best = max(to1) + g - max(to0)
        states = np.zeros(len(gain), bool)
        at = best >= 0
        for i in range(len(gain) - 1, -1, -1):
            states[i] = at
            at = back[i, int(at)]
        return states

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Probability of state 1 of each line, by forward and backward recursion."""
        gain, m = (features @ self.w).tolist(), self.move.tolist()
        ahead, behind = [0.0] * len(gain), [0.0] * len(gain)  # log odds of state 1 from the lines before and behind
        step = lambda odds, m: float(np.logaddexp(m[0][1], odds + m[1][1]) - np.logaddexp(m[0][0], odds + m[1][0]))
        turned = [[m[0][0], m[1][0]], [m[0][1], m[1][1]]]
        for i in range(1, len(gain)):
            ahead[i] = step(ahead[i - 1] + gain[i - 1], m)
        for i in range(len(gain) - 2, -1, -1):
            behind[i] = step(behind[i + 1] + gain[i + 1], turned)
        return 1 / (1 + np.exp(-np.clip(np.array(ahead) + gain + np.array(behind), -50, 50)))


def train_field(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, penalty: float = 0.02) -> LineField:
    """Maximum regularised likelihood by gradient ascent, all chains at once by forward and backward recursion."""
    if not sequences:
        return LineField(np.r_[1.0, np.zeros(N_FEATURES - 1)], np.zeros((2, 2)))
    sequences = sorted(sequences, key=lambda s: -len(s[0]))
    lengths = np.array([len(f) for f, _ in sequences])
    steps = int(lengths[0])
    alive = [int((lengths > t).sum()) for t in range(steps)]
    offset = np.concatenate(([0], np.cumsum(alive)))
    rows = [np.stack([sequences[k][0][t] for k in range(alive[t])]) for t in range(steps)]
    x = np.concatenate(rows)
    y = np.concatenate([[sequences[k][1][t] for k in range(alive[t])] for t in range(steps)]).astype(int)
    weight = np.concatenate([1.0 / np.sqrt(lengths[: alive[t]]) for t in range(steps)])
    weight /= weight.sum()
    seen = np.zeros((2, 2))
    for t in range(1, steps):
        a, b = y[offset[t - 1] : offset[t - 1] + alive[t]], y[offset[t] : offset[t + 1]]
        np.add.at(seen, (a, b), weight[offset[t] : offset[t + 1]])
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    mw, vw = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    lse = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for r in range(1, rounds + 1):
        gain = np.stack([np.zeros(len(x)), x @ w], 1)
        fwd, bwd = np.empty_like(gain), np.zeros_like(gain)
        fwd[: alive[0]] = gain[: alive[0]]
        for t in range(1, steps):
            prev = fwd[offset[t - 1] : offset[t - 1] + alive[t]]
            fwd[offset[t] : offset[t + 1]] = np.stack([lse(prev + move[:, b]) for b in (0, 1)], 1) + gain[offset[t] : offset[t + 1]]
        pair = np.zeros((2, 2))
        for t in range(steps - 1, 0, -1):
            own = slice(offset[t], offset[t + 1])
            before = slice(offset[t - 1], offset[t - 1] + alive[t])
            after = gain[own] + bwd[own]
            bwd[before] = np.stack([lse(after + move[a]) for a in (0, 1)], 1)
            joint = fwd[before][:, :, None] + move[None] + after[:, None, :]
            joint -= np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None]
            pair += (np.exp(joint) * weight[own][:, None, None]).sum(0)
        post = fwd + bwd
        p1 = np.exp(post[:, 1] - lse(post))
        grad = np.concatenate([x.T @ (weight * (y - p1)) - penalty * w / 50, (seen - pair).ravel() - penalty * move.ravel() / 50])
        mw, vw = 0.9 * mw + 0.1 * grad, 0.99 * vw + 0.01 * grad**2
        step = 0.1 * (mw / (1 - 0.9**r)) / (np.sqrt(vw / (1 - 0.99**r)) + 1e-8)
        w, move = w + step[: len(w)], move + step[len(w) :].reshape(2, 2)
    return LineField(w, move)


@dataclass(frozen=True)
class Chain:
    """The lines of a labelled document: features, words, and whether a line is repeated or shared by documents."""

    features: np.ndarray
    words: np.ndarray
    common: np.ndarray
    quality: int

    def labels(self, wish: np.ndarray) -> np.ndarray:
        """wish, as far as the document's share of content words allows; the most wished lines (falling |wish|) first.

        wish: above 0 for content, below for boilerplate.
        """
        own = np.full(len(wish), self.quality)
        most = ((1 - CLEAN_SHARE) if self.quality else JUNK_SHARE) * self.words.sum()
        other = np.flatnonzero((wish < 0) if self.quality else (wish > 0))
        for k in other[np.argsort(-np.abs(wish[other]), kind="stable")].tolist():
            if self.words[k] <= most:
                own[k] = 1 - self.quality
                most -= self.words[k]
        return own


def fit_lines(chains: list[Chain], rounds: int = 2) -> LineField:
    """Fields and line labels in turn, the first labels from the documents' and the lines that occur elsewhere."""
    wishes = [np.where(c.common, -1.0, 0.0) for c in chains]
    for r in range(rounds + 1):
        labels = [c.labels(w) for c, w in zip(chains, wishes)]
        field = train_field([(c.features, y) for c, y in zip(chains, labels)])
        if r < rounds:
            for k, c in enumerate(chains):
                p = field.marginals(c.features)
                wishes[k] = np.where(c.common, -1.0, np.where(np.maximum(p, 1 - p) >= SURE, 2 * p - 1, 0.0))
    return field


def held_to_clean(field: LineField, clean: list[Chain]) -> LineField:
    """The field with the least content bias, in quarters up to 1, that keeps KEEP_CLEAN of the clean chains by their words."""
    for bias in (0.0, 0.25, 0.5, 0.75, 1.0):
        out = LineField(field.w + np.r_[bias, np.zeros(len(field.w) - 1)], field.move)
        if sum(c.words @ out.viterbi(c.features) >= MIN_SHARE * c.words.sum() for c in clean) >= KEEP_CLEAN * len(clean):
            break
    return out


def labelled_chains(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> list[Chain]:
    """max_train labelled documents at most; only line features come to the driver."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("quality", "text")

    def features(batch):
        out: dict[str, list] = {"quality": batch.column(0), "features": [], "words": [], "keys": []}
        for t in batch.column(1):
            b = base_counts(t.as_py())
            words, keys = lines_of(b)
            for c, v in (("features", line_features(b).astype(np.float32)), ("words", words.astype(np.int64)), ("keys", keys)):
                out[c].append(v[:MAX_TRAIN_LINES].tobytes())
        yield out

    got = [r for r in map_rows(rows, features, "quality int, features binary, words binary, keys binary").orderBy("quality", "features", "keys").collect() if r.features]
    keys = [np.frombuffer(r["keys"], np.uint64) for r in got]
    each, n = np.unique(np.concatenate([np.unique(k) for k in keys]), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    shared = each[n >= SHARED]
    chains = []
    for r, k in zip(got, keys):
        f = np.frombuffer(r.features, np.float32).reshape(-1, N_FEATURES).astype(float)
        chains.append(Chain(f, np.frombuffer(r.words, np.int64), (f[:, 6] > 0) | np.isin(k, shared), r.quality))
    return chains


def fit_on_labels(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> LineField:
    """The field fitted on max_train labelled documents at most."""
    chains = labelled_chains(docs, labels, max_train)
    return held_to_clean(fit_lines(chains), [c for c in chains if c.quality == 1])


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, n_boilerplate_lines bigint, kept boolean"


def judge(docs: DataFrame, model: LineField, min_share: float = MIN_SHARE, keep_columns: bool = False) -> DataFrame:
    """Per document the base counts, the words' share on content lines, and the verdict.

    keep_columns: return the input's own columns of the kept documents instead.
    """

    def verdicts(batch):
        names = [f.name for f in batch.schema]
        got = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "n_boilerplate_lines", "kept")}
        for t in batch.column(names.index("text")):
            b = base_counts(t.as_py())
            states = model.viterbi(line_features(b))
            share = float(states[b.line_of_word].mean()) if b.n_words else 0.0
            row = (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.failed, share, int((~states).sum()), not b.failed and share >= min_share)
            for c, v in zip(got, row):
                got[c].append(v)
        if keep_columns:
            import pyarrow as pa

            chosen = batch.filter(pa.array(got["kept"]))
            yield {c: chosen.column(i) for i, c in enumerate(names)}
        else:
            yield {"doc_id": batch.column(names.index("doc_id"))} | got

    return map_rows(docs if keep_columns else docs.select("doc_id", "text"), verdicts, docs.schema if keep_columns else SCHEMA)


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_on_labels(docs, table(spark, sf_dir, "labels")))
