"""Quality rules as a short-circuit cascade.

A rule maps a text to a number and rejects the text if the number is beyond a bound. The verdict of a text is "kept" if
no rule rejects it, which doesn't depend on the order of the rules; the order decides only what the verdict costs. So
the rules are timed on a random sample of all rows that reach the cascade, on the executors, and then run by rejections
per second: first the rule with the most, then the one with the most among the rows that it lets pass, and so on. Each
rule is asked only for the texts that all rules before it have let pass. A rule must gain clearly more than another to
pass it by, so that the noise of a clock doesn't change the order.

Words are the runs of anything but the six ASCII white space characters. Counts are exact and cover whole texts.

Defined results: a null text counts as empty (no words, so it is rejected by the least number of words); ratios of an
empty text are 0; a blank line is never a repeated line. Rows are judged one by one, so repeated rows get equal
verdicts and an empty table gives an empty result. Columns that clash with the result's names belong to the input and
are left alone by :func:`filter_quality`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, core, slices, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 5


class Text:
    """A text and what the rules share of it, worked out when first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._words: list[bytes] | None = None
        self._ids: np.ndarray | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the ASCII white space
        return self._words

    @property
    def ids(self) -> np.ndarray:
        """The words as numbers, equal for equal words; distinct words are numbered from 0."""
        if self._ids is None:
            numbers: dict[bytes, int] = {}
            new = count().__next__
            self._ids = np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, new()) for w in self.words), np.int64, len(self.words))
        return self._ids


def n_words(t: Text) -> int:
    return len(t.words)


def word_chars(t: Text) -> int:
    return len(t.text) - sum(map(t.text.count, ASCII_SPACE))


def n_symbols(t: Text) -> int:
    return sum(map(t.text.count, SYMBOLS))


def n_dup_lines(t: Text) -> int:
    lines = [x for x in t.text.split("\n") if x.strip(ASCII_SPACE)]
    return len(lines) - len(set(lines))


def n_repeat_words(t: Text) -> int:
    """Words inside 5-word windows that occur twice or more in the text."""
    n = len(t.words) - WINDOW + 1
    if n < 2:
        return 0
    ids = t.ids
    size = int(ids.max()) + 1
    if size == len(ids):
        return 0  # no word occurs twice
    key, span = ids[:n].copy(), size
    for i in range(1, WINDOW):
        if span * size >= 2**62:  # number the prefixes anew, so that the key stays exact
            key = np.unique(key, return_inverse=True)[1]
            span = int(key.max()) + 1
        key, span = key * size + ids[i : i + n], span * size
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n + 1, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def symbol_ratio(t: Text) -> float:
    return _ratio(n_symbols(t), len(t.words))


def shouting(t: Text) -> float:
    """Share of ASCII letters that are capitals."""
    raw = np.frombuffer(t.text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = np.count_nonzero((raw >= 65) & (raw <= 90))
    return _ratio(upper, upper + np.count_nonzero((raw >= 97) & (raw <= 122)))


def stutter(t: Text) -> float:
    """Share of words that equal the word before them."""
    ids = t.ids
    return _ratio(int(np.count_nonzero(ids[1:] == ids[:-1])), len(ids))


def repetition(t: Text) -> float:
    return 100 * n_repeat_words(t) / max(1, n_words(t))


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``low`` > measure(text) or measure(text) > ``high``."""

    name: str
    measure: Callable[[Text], float]
    low: float = -np.inf
    high: float = np.inf

    def rejects(self, t: Text) -> bool:
        x = self.measure(t)
        return x < self.low or x > self.high


#: 100 * repeated words > 20 * words is compared in whole numbers.
BASE_RULES = (
    Rule("few_words", n_words, low=10),
    Rule("repetition", lambda t: 100 * n_repeat_words(t) - 20 * n_words(t), high=0),
)
#: Bounds of the method's own rules.
RULES = (Rule("symbols", symbol_ratio, high=0.3), Rule("shouting", shouting, high=0.6), Rule("stutter", stutter, high=0.3))
#: Rows, about, that the cost and the selectivity of the rules are estimated on.
SAMPLE_ROWS = 400
#: Times a rule is run on a sampled text; the shortest counts.
TRIALS = 3
#: Of the rules whose gain is at least this share of the greatest one, the first as they are given is taken.
LIKE = 0.25


def trial(rules: Sequence[Rule], text: str) -> tuple[list[bool], list[float]]:
    """Which rules reject a text, and the CPU seconds that each takes on its own."""
    rejects, costs = [], []
    for rule in rules:
        took = []
        for _ in range(TRIALS):
            t, began = Text(text), time.perf_counter_ns()
            hit = rule.rejects(t)
            took.append(time.perf_counter_ns() - began)
        rejects.append(bool(hit))
        costs.append(min(took) / 1e9)
    return rejects, costs


def ordered(rules: Sequence[Rule], sample: Sequence[tuple[Sequence[bool], Sequence[float]]]) -> list[Rule]:
    """``rules`` by rejections per second of the rows that reach them, as :func:`trial` has found them for a sample."""
    if not sample:
        return list(rules)
    rejects, costs = np.array([r for r, _ in sample], bool), np.array([c for _, c in sample])
    rest, live, out = list(range(len(rules))), np.ones(len(sample), bool), []
    while rest:
        seconds = {i: max(float(costs[:, i].mean()), 1e-9) for i in rest}
        hits = {i: int(rejects[live, i].sum()) for i in rest}
        some = [i for i in rest if hits[i]] or rest  # where none rejects anything, the cheap ones come first
        gain = {i: max(hits[i], 1) / seconds[i] for i in some}
        first = next(i for i in some if gain[i] >= LIKE * max(gain.values()))
        rest.remove(first)
        out.append(rules[first])
        live &= ~rejects[:, first]
    return out


def plan(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, reach: Sequence[Rule] = ()) -> list[Rule]:
    """The order of ``rules`` for these texts, from about ``sample_rows`` of them; it changes the cost only.

    The sample is drawn from all rows, of any length; of it, the rows that ``reach`` lets pass are tried on the executors.
    """
    rows = docs.select(F.col(text_col).alias("t"))
    total = rows.count()
    if not total:
        return list(rules)

    def run(batches):
        for b in batches:
            tried = [trial(rules, x) for x in texts(b, "t") if first_rejection(reach, Text(x)) is None]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in tried], pa.list_(pa.bool_())), pa.array([c for _, c in tried], pa.list_(pa.float64()))], names=["rejects", "costs"])

    drawn = rows.sample(min(1.0, sample_rows / total), 17)
    return ordered(rules, [(r.rejects, r.costs) for r in drawn.mapInArrow(run, "rejects array<boolean>, costs array<double>").collect()])


def first_rejection(rules: Sequence[Rule], t: Text) -> str | None:
    return next((r.name for r in rules if r.rejects(t)), None)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Each row's id, the base measures, base_failed, kept, and the rule that rejected it first (null: kept).

    The cascade is asked only for rows that the base rules let pass.
    """
    rows = core(docs, id_col, text_col)
    cascade = plan(rows, rules, text_col, reach=BASE_RULES)
    base = list(BASE_RULES)
    schema = T.StructType(
        [T.StructField(id_col, rows.schema[id_col].dataType)]
        + [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())]
    )

    def run(batches):
        for b in slices(batches):
            found = []
            for x in texts(b, text_col):
                t = Text(x)
                n, repeated = n_words(t), n_repeat_words(t)
                failed = base[0].name if n < 10 else base[1].name if 100 * repeated > 20 * n else None
                why = failed or first_rejection(cascade, t)
                found.append((n, word_chars(t), n_symbols(t), n_dup_lines(t), repeated, failed is not None, why is None, why))
            cols = list(zip(*found, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *map(pa.array, cols, kinds)], names=schema.names)

    return rows.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BASE_RULES + RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns, as they were."""
    cascade = plan(docs, rules, text_col)
    place = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array([first_rejection(cascade, Text(x.as_py() or "")) is None for x in b.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
