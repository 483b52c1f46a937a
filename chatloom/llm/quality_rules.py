"""Weak supervision: quality rules vote or abstain, EM weighs them, a posterior decides.

Instead of requiring that every rule passes, each rule votes good (1), bad (0)
or abstains (-1).  A two-class latent model is fitted by expectation
maximisation: per rule the chance that it votes good on a good text and bad on
a bad text, and the share of good texts.  A text is kept if its posterior
probability of being good is at least one half.

The fit needs only how often each combination of votes occurs, one partially
aggregated count over all documents; the driver sees at most 3^rules rows
(6561 for the eight rules here), whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import pin

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"

FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_letters long, n_digits long, n_wordy long"
)


def repeat_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice (first occurrence included)."""
    n = len(ids)
    if n < 4:
        return 0
    base = int(ids.max()) + 1
    pair = ids[:-2] * base + ids[1:-1]
    if base**3 >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * base + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    repeated = np.zeros(n - 2, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= repeated
    return int(covered.sum())


def text_features(text: str) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``FEATURES`` (n_letters: A-Z, a-z; n_wordy: these and all non-ASCII)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    octets = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in _SPACES),
        int(sum(octets[ord(c)] for c in _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(ids),
        len(lines),
        int(octets[65:91].sum()),
        int(octets[65:91].sum() + octets[97:123].sum()),
        int(octets[48:58].sum()),
        int(octets[65:91].sum() + octets[97:123].sum() + octets[0xC0:].sum()),
    )


def _feature_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for texts in batches:
        rows = [text_features(t if isinstance(t, str) else "") for t in texts]
        yield pd.DataFrame(np.array(rows, np.int64).reshape(len(rows), len(names)), columns=names)


@dataclass(frozen=True)
class Rule:
    """Votes bad if ``bad`` holds, good if ``good`` holds, else abstains (null counts as not holding)."""

    name: str
    good: str
    bad: str


#: Ratios are written as products, so an empty text divides by nothing and such rules abstain.
RULES = (  # the number of words is the base test's and has no vote of its own
    Rule("word_length", "n_words > 0 AND word_chars BETWEEN 3 * n_words AND 10 * n_words",
         "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    Rule("symbols", "n_words > 0 AND 100 * n_symbols <= n_words", "n_words > 0 AND 10 * n_symbols >= n_words"),
    Rule("duplicate_lines", "n_lines > 0 AND 20 * n_dup_lines <= n_lines", "n_lines > 0 AND 10 * n_dup_lines >= 3 * n_lines"),
    Rule("repeated_words", "n_words > 0 AND 10 * n_repeat_words <= n_words", "n_words > 0 AND 10 * n_repeat_words >= 3 * n_words"),
    Rule("capitals", "n_letters > 0 AND 100 * n_upper <= 15 * n_letters", "n_letters > 0 AND 10 * n_upper >= 3 * n_letters"),
    Rule("letters", "word_chars > 0 AND 100 * n_wordy >= 90 * word_chars", "word_chars > 0 AND 100 * n_wordy < 85 * word_chars"),
    Rule("digits", "word_chars > 0 AND 20 * n_digits <= word_chars", "word_chars > 0 AND 5 * n_digits >= word_chars"),
)


@dataclass(frozen=True)
class VoteModel:
    """``good_rate``: share of good texts; per rule P(votes good | good) and P(votes bad | bad)."""

    good_rate: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def log_odds(self, votes: list[Column]) -> Column:
        """Log odds of good; an abstaining rule adds nothing."""
        total = F.lit(math.log(self.good_rate / (1 - self.good_rate)))
        for vote, g, b in zip(votes, self.on_good, self.on_bad):
            total = total + (
                F.when(vote == 1, F.lit(math.log(g / (1 - b)))).when(vote == 0, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
            )
        return total


def fit_votes(votes: np.ndarray, counts: np.ndarray, false_alarms: float = 0.01, weight: float = 0.1, rounds: int = 500, tolerance: float = 1e-9) -> VoteModel:
    """EM over distinct vote rows (1, 0, -1) and how often each occurs.

    Both accuracies of every rule are estimated.  What anchors the two classes
    is a prior: rules are written to be wrong about ``false_alarms`` of good
    texts, and that belief weighs as many texts as ``weight`` times those the
    rule voted on (without it the classes settle on the densest cluster of
    votes, whatever it is).  A rule is also no worse than chance: P(bad | bad) is
    at least P(bad | good).  One pseudo-observation per cell keeps rates off 0
    and 1.  No rows: the starting values.
    """
    n_rules = votes.shape[1]
    rate, on_good, on_bad = 0.9, np.full(n_rules, 0.999), np.full(n_rules, 0.4)
    good_vote, bad_vote = (votes == 1).astype(float), (votes == 0).astype(float)
    total = counts.sum()
    belief = weight * (counts @ (good_vote + bad_vote))
    for _ in range(rounds if total else 0):
        odds = math.log(rate / (1 - rate)) + good_vote @ np.log(on_good / (1 - on_bad)) + bad_vote @ np.log((1 - on_good) / on_bad)
        good = counts / (1 + np.exp(-odds))
        bad = counts - good
        new_good = (good @ good_vote + 1 + belief * (1 - false_alarms)) / (good @ (good_vote + bad_vote) + 2 + belief)
        new_bad = np.maximum((bad @ bad_vote + 1) / (bad @ (good_vote + bad_vote) + 2), 1 - new_good + 1e-6)
        new_bad = np.minimum(new_bad, 1 - 1e-9)
        new_rate = (good.sum() + 1) / (total + 2)
        moved = max(abs(new_good - on_good).max(), abs(new_bad - on_bad).max(), abs(new_rate - rate))
        rate, on_good, on_bad = new_rate, new_good, new_bad
        if moved < tolerance:
            break
    return VoteModel(float(rate), tuple(map(float, on_good)), tuple(map(float, on_bad)))


def _vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), F.lit(0)).when(F.expr(rule.good), F.lit(1)).otherwise(F.lit(-1))


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  rules: tuple[Rule, ...] = RULES, min_words: int = 50, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, base counts, base_failed, one vote per rule, posterior, kept.

    ``base_failed``: fewer than ``min_words`` words, or more than half of the
    words inside repeated 3-word windows.  ``kept`` is false if base_failed, else
    posterior >= ``threshold``.  A null text has no words; rows that repeat, and
    null ids, are judged row by row; an empty table gives an empty result.
    Columns other than the two named are not read.
    """
    features = F.pandas_udf(_feature_batches, FEATURES)
    counted = pin(docs.select(F.col(id_column).alias("doc_id"), features(F.col(text_column).cast("string")).alias("f")).select("doc_id", "f.*"))
    names = [f"vote_{r.name}" for r in rules]
    voted = counted.select("*", *[_vote(r).alias(n) for r, n in zip(rules, names)])
    patterns = voted.groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    patterns.sort(key=lambda r: tuple(r[n] for n in names))
    model = fit_votes(np.array([[r[n] for n in names] for r in patterns], np.int64).reshape(len(patterns), len(names)),
                      np.array([r["count"] for r in patterns], np.float64))
    posterior = 1 / (1 + F.exp(-model.log_odds([F.col(n) for n in names])))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("posterior", posterior).withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", *names)
    )
