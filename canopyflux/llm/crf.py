"""A linear-chain conditional random field over word features, in numpy: training, and Viterbi decoding in batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: A sentence: the feature numbers of each word, of the word before the first and of the one after the last.
Sentence = Sequence[Sequence[int]]


@dataclass(frozen=True)
class Crf:
    """Weights by (feature, label) of a word's own features, of its left and of its right neighbour's, and of label pairs.

    Label 0 is "outside"; before and after a sentence everything is outside.
    """

    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair: np.ndarray

    @property
    def labels(self) -> int:
        return len(self.pair)

    def gain(self, score: np.ndarray) -> np.ndarray:
        """At most what each word adds to a path by another label than 0, whatever the label before it is."""
        into = (self.pair - self.pair[0, 0]).max(0)
        return (score[:, 1:] - score[:, :1] + into[1:]).max(1).astype(float)

    def doubtful(self, gain: np.ndarray) -> np.ndarray:
        """The words that can have another label than 0 in a best path; all others are certain.

        A run of such words gains the sum of ``gain`` at most, and what the way back to 0 adds. Where no run through a word
        can gain, the run would be better outside.
        """
        total = np.cumsum(gain)
        least = np.minimum.accumulate(np.r_[0.0, total[:-1]])
        most = np.maximum.accumulate(total[::-1])[::-1]
        back = float((self.pair[1:, 0] - self.pair[0, 0]).max())
        return most - least + back > -1e-3

    def decode(self, sentences: Sequence[np.ndarray], most: int = 20_000) -> list[np.ndarray]:
        """The best labels of each sentence. A sentence is its scores by word and label: own, left and right summed.

        Sentences of like length are decoded together, about ``most`` words at once.
        """
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(sentences)
        order = sorted(range(len(sentences)), key=lambda i: len(sentences[i]))
        group: list[int] = []
        for i in order:
            if group and (len(group) + 1) * len(sentences[i]) > most:
                self._viterbi(sentences, group, out)
                group = []
            group.append(i)
        if group:
            self._viterbi(sentences, group, out)
        return out

    def _viterbi(self, sentences, group: list[int], out: list[np.ndarray]) -> None:
        lengths = np.array([len(sentences[i]) for i in group])
        n, steps = len(group), int(lengths.max(initial=0))
        if not steps:
            return
        score = np.zeros((steps, n, self.labels), np.float32)
        for k, i in enumerate(group):
            score[: lengths[k], k] = sentences[i]
        best = self.pair[0] + score[0]
        back = np.zeros((steps, n, self.labels), np.int8)
        rows = np.arange(n)
        last = np.where(lengths[:, None] == 1, best + self.pair[:, 0], -np.inf)
        for t in range(1, steps):
            via = best[:, :, None] + self.pair
            back[t] = via.argmax(1)
            best = via.max(1) + score[t]
            last = np.where(lengths[:, None] == t + 1, best + self.pair[:, 0], last)
        path = np.zeros((steps, n), np.int8)
        now = last.argmax(1)
        for t in range(steps - 1, -1, -1):
            live = t < lengths
            path[t] = np.where(live, now, 0)
            if t:
                now = np.where(live, back[t, rows, now], now)
        for k, i in enumerate(group):
            out[i] = path[: lengths[k], k]


def train(sentences: Sequence[Sentence], labels: Sequence[Sequence[int]], features: int, kinds: int, steps: int = 150, rate: float = 0.2, decay: float = 2e-4) -> Crf:
    """Maximise the conditional likelihood by Adam over all sentences at once. The data are a small table, so this is short.

    Words with the same features are one row of ``bundle``; forward and backward sums are scaled at every word. Sentences
    are put in order of length, the longest first, so that each step takes only those that reach it.
    """
    order = sorted(range(len(sentences)), key=lambda i: -len(sentences[i]))
    sentences, labels = [sentences[i] for i in order], [labels[i] for i in order]
    n, longest = len(sentences), max(len(x) - 2 for x in sentences)
    lengths = np.array([len(x) - 2 for x in sentences])
    numbers: dict[tuple[int, ...], int] = {}
    place = np.zeros((n, longest + 2), np.int64)
    gold = np.zeros((n, longest), np.int64)
    for i, (words, tags) in enumerate(zip(sentences, labels, strict=True)):
        place[i, : len(words)] = [numbers.setdefault(tuple(sorted(set(w))), len(numbers)) for w in words]
        gold[i, : len(tags)] = tags
    bundle = np.zeros((len(numbers), features))
    for found, i in numbers.items():
        bundle[i, list(found)] = 1
    around = [np.ascontiguousarray(x) for x in (place[:, 1:-1], place[:, :-2], place[:, 2:])]
    live = np.arange(longest) < lengths[:, None]
    ends = np.arange(longest) == lengths[:, None] - 1
    reach = live.sum(0).tolist()
    rng = np.random.default_rng(7)
    weights = [rng.normal(0, 0.01, (features, kinds)) for _ in range(3)] + [np.zeros((kinds, kinds))]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    hot = np.eye(kinds)[gold] * live[..., None]
    pair_gold = np.einsum("ntj,ntk->jk", hot[:, :-1], hot[:, 1:])
    pair_gold[0] += hot[:, 0].sum(0)
    pair_gold[:, 0] += hot[ends].sum(0)
    for step in range(1, steps + 1):
        *by_word, pair = weights
        score = sum((bundle @ w)[x] for w, x in zip(by_word, around, strict=True))
        score = np.exp(score - score.max(2, keepdims=True))
        move = np.exp(pair)
        fore, after = np.ones((n, longest, kinds)), np.ones((n, longest, kinds))
        for t in range(longest):
            own = reach[t]
            x = (fore[:own, t - 1] @ move if t else move[0]) * score[:own, t]
            fore[:own, t] = x / x.sum(1, keepdims=True)
        for t in range(longest - 1, -1, -1):
            own = reach[t]
            x = (score[:own, t + 1] * after[:own, t + 1]) @ move.T if t + 1 < longest else np.ones((own, kinds))
            x = np.where(ends[:own, t, None], move[:, 0], x)
            after[:own, t] = x / x.sum(1, keepdims=True)
        prob = fore * after
        prob *= live[..., None] / prob.sum(2, keepdims=True)
        pairs = np.zeros((kinds, kinds))
        for t in range(1, longest):
            own = reach[t]
            here = score[:own, t] * after[:own, t]
            total = ((fore[:own, t - 1] @ move) * here).sum(1, keepdims=True)
            pairs += move * (fore[:own, t - 1].T @ (here / total))
        pairs[0] += prob[:, 0].sum(0)
        pairs[:, 0] += prob[ends].sum(0)
        error = hot - prob
        error = error[live]
        grads = [bundle.T @ np.stack([np.bincount(x[live], error[:, k], len(bundle)) for k in range(kinds)], 1) for x in around] + [pair_gold - pairs]
        for i, g in enumerate(grads):
            g = g / n - decay * weights[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            weights[i] = weights[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Crf(*(w.astype(np.float32) for w in weights))
