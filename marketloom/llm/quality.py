"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Built from DataFrame functions alone. The texts are read once; the votes are one byte per rule, and the model is fitted on
the counts of vote patterns, of which there are at most 3 ** (number of rules) however many documents there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import BLANKS, WORD, store, whole



def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


#: Each rule reads the features of one document and votes 1 (good), -1 (bad) or 0 (abstains).
RULES: dict[str, Callable[[Column], Column]] = {
    "length": lambda q: _vote(q.n_words < 50, q.n_words < 0),
    "word_length": lambda q: _vote((q.word_chars < 3 * q.n_words) | (q.word_chars > 12 * q.n_words), q.word_chars.between(4 * q.n_words, 8 * q.n_words)),
    "symbols": lambda q: _vote(10 * q.n_symbols > q.n_words, 100 * q.n_symbols <= q.n_words),
    "capitals": lambda q: _vote(10 * q.n_upper > 3 * q.word_chars, 10 * q.n_upper <= q.word_chars),
    "marks": lambda q: _vote(4 * q.n_marks > q.n_words, 20 * q.n_marks <= q.n_words),
    "repeats": lambda q: _vote(100 * q.n_repeat_words > 50 * q.n_words, 100 * q.n_repeat_words <= 20 * q.n_words),
    "variety": lambda q: _vote(q.n_words.between(50, 2000) & (5 * q.n_distinct < q.n_words), 2 * q.n_distinct >= q.n_words),
    "lines": lambda q: _vote((q.n_lines >= 4) & (10 * q.n_dup_lines > 5 * q.n_lines), 10 * q.n_dup_lines <= 2 * q.n_lines),
}


def with_features(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """`docs` with a struct column `out` (replaced if there is one) of word, symbol, line and repetition counts.

    Null and empty texts count zero throughout. Repeated 3-word windows are found by sorting the window hashes of the one
    text with their positions, so nothing is shuffled and the work per text is n log n.
    """
    t, q = f"__{out}_t", f"__{out}_"
    # Each explode of a one-element array keeps its value as a computed column instead of an expression that later steps repeat.
    held = lambda df, value, name: df.select("*", F.explode(F.array(value)).alias(name))
    df = docs.withColumn(t, whole(text))
    df = held(df, F.transform(F.array_remove(F.split(F.col(t), f"[{BLANKS}]+"), ""), lambda w: F.xxhash64(w)), f"{q}w")
    df = held(df, F.filter(F.split(F.col(t), "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD))), f"{q}l")
    w = F.col(f"{q}w")
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))
    df = held(df, hashes, f"{q}h")
    h = F.col(f"{q}h")
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = held(df, placed, f"{q}s")
    s = F.col(f"{q}s")
    pairs = F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    starts = F.coalesce(F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))), F.array().cast("array<int>"))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc.n + F.least(F.lit(3), x - acc.last)).alias("n")),
        lambda acc: acc.n,
    )
    lines = F.col(f"{q}l")
    without = lambda chars: F.length(F.regexp_replace(F.col(t), f"[{chars}]+", ""))
    count = lambda chars: (F.length(F.col(t)) - without(chars)).cast("long")
    features = F.struct(
        F.size(w).cast("long").alias("n_words"),
        without(BLANKS).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        count("A-ZÀ-ÖØ-Þ").alias("n_upper"),
        count("!?*|#").alias("n_marks"),
    )
    return held(df.drop(out), features, out).select(*[F.col(f"`{c}`") for c in docs.columns if c != out], out)


def base_failed(q: Column) -> Column:
    return (q.n_words < 50) | (100 * q.n_repeat_words > 50 * q.n_words)


def votes(q: Column) -> Column:
    return F.struct(*[rule(q).alias(name) for name, rule in RULES.items()])


@dataclass(frozen=True)
class Model:
    """Share of good documents, and per rule the chance of a good vote among good and among bad documents where it votes."""

    prior: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def numbers(self) -> list[float]:
        return [self.prior, *self.on_good.values(), *self.on_bad.values()]

    def odds(self) -> tuple[float, dict[str, tuple[float, float]]]:
        """Log odds of good before any vote, and what a good and a bad vote of each rule add."""
        pairs = {n: (self.on_good[n], self.on_bad[n]) for n in RULES}
        return math.log(self.prior / (1 - self.prior)), {n: (math.log(a / b), math.log((1 - a) / (1 - b))) for n, (a, b) in pairs.items()}

    def chance(self, votes: dict) -> float:
        start, rules = self.odds()
        return 1 / (1 + math.exp(-start - sum(rules[n][votes[n] < 0] for n in RULES if votes[n])))

    def posterior(self, v: Column) -> Column:
        """Probability that a document with these votes is good."""
        start, rules = self.odds()
        sums = F.lit(start)
        for n, (up, down) in rules.items():
            sums = sums + F.when(v[n] == 1, up).when(v[n] == -1, down).otherwise(0.0)
        return 1 / (1 + F.exp(-sums))


#: Pseudo counts of (good, bad) votes, which keep rules that never vote from 0 and 1: a rule is right more often than not.
_SEEN_GOOD, _SEEN_BAD = (9.0, 1.0), (4.0, 4.0)


def fit(voted: DataFrame, votes_column: str = "votes", rounds: int = 200, tolerance: float = 1e-9) -> Model:
    """Expectation-maximisation over all rows of `voted`.

    Spark counts the vote patterns; the rounds need those counts alone, at most 3 ** len(RULES) rows whatever the input, and
    are plain arithmetic on them. It starts from accuracies that trust any single bad vote. An empty table gives the start.
    """
    patterns = voted.groupBy(*[F.col(votes_column)[n].alias(n) for n in RULES]).agg(F.count("*").alias("n")).orderBy(*RULES).collect()
    model = Model(0.8, {n: 0.98 for n in RULES}, {n: 0.6 for n in RULES})
    if not patterns:
        return model
    total = sum(p.n for p in patterns)
    for _ in range(rounds):
        good = [p.n * model.chance(p) for p in patterns]
        bad = [p.n - g for p, g in zip(patterns, good, strict=True)]

        def share(name: str, weights: list[float], seen: tuple[float, float]) -> float:
            up = sum(w for p, w in zip(patterns, weights, strict=True) if p[name] == 1) + seen[0]
            return up / (up + seen[1] + sum(w for p, w in zip(patterns, weights, strict=True) if p[name] == -1))

        new = Model((sum(good) + 4) / (total + 5), {n: share(n, good, _SEEN_GOOD) for n in RULES}, {n: share(n, bad, _SEEN_BAD) for n in RULES})
        moved = max(abs(x - y) for x, y in zip(new.numbers(), model.numbers(), strict=True))
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, text: str = "text", out: str = "quality", threshold: float = 0.5, drop_text: bool = False) -> DataFrame:
    """`docs` with a struct column `out`: features, votes, base_failed, posterior and kept (not base_failed, posterior at least the threshold).

    Null, empty and very short texts fail the base; every input row comes back once, repeated rows too. `docs` is written
    once with its features (without the text if `drop_text`), so pass only the columns that are needed.
    """
    featured = with_features(docs, text, out)
    q = F.col(out)
    fields = featured.schema[out].dataType.names
    other = [F.col(f"`{c}`") for c in docs.columns if c != out and not (drop_text and c == text)]
    scored = store(featured.select(*other, F.struct(*[q[f].alias(f) for f in fields], votes(q).alias("votes"), base_failed(q).alias("base_failed")).alias(out)), "quality")
    model = fit(scored.select(q["votes"].alias("votes")))
    q, good = F.col(out), model.posterior(F.col(out)["votes"])
    return scored.select(*other, F.struct(*[q[f].alias(f) for f in [*fields, "votes", "base_failed"]], good.alias("posterior"), (~q["base_failed"] & (good >= threshold)).alias("kept")).alias(out))
