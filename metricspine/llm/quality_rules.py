"""Quality rules under weak supervision: votes, expectation-maximisation, posterior probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emitter, rows_of, sources, spark_schema, written
from .text_stats import TextStats, text_stats

MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """A vote from the share of part in whole, in thousandths: (comparison, limit) for a good and for a bad vote.

    With no whole, part itself is compared. A rule with one of the two only is
    one-sided. It abstains where neither holds, and on a whole of zero.
    """

    name: str
    part: str
    whole: str | None
    good: tuple[str, int] | None
    bad: tuple[str, int] | None

    def vote(self, s: TextStats) -> int:
        part, whole = getattr(s, self.part), getattr(s, self.whole) if self.whole else 1
        scale = 1000 if self.whole else 1
        for value, test in ((1, self.good), (-1, self.bad)):
            if whole and test and (scale * part >= test[1] * whole if test[0] == ">=" else scale * part <= test[1] * whole):
                return value
        return 0


#: The rules of the registered query, in the order of their votes.
RULES = (
    Rule("length", "n_words", None, (">=", 80), None),
    Rule("function_words", "n_function", "n_words", (">=", 150), ("<=", 60)),
    Rule("marks", "n_marks", "n_words", (">=", 40), ("<=", 10)),
    Rule("symbols", "n_symbols", "n_words", None, (">=", 100)),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, (">=", 300)),
    Rule("repetition", "n_repeat_words", "n_words", None, (">=", 250)),
    Rule("adjacent", "n_adjacent", "n_words", None, (">=", 80)),
    Rule("top_word", "top_count", "n_words", None, (">=", 200)),
    Rule("upper_case", "n_upper", "n_lower", None, (">=", 250)),
    Rule("exclamations", "n_exclaim", "n_words", None, (">=", 80)),
    Rule("word_length", "word_chars", "n_words", None, (">=", 11000)),
)

ROUNDS = 20
PRIOR = 0.8
#: What expectation-maximisation starts from, and is smoothed towards with a weight of PSEUDO documents: the probabilities of bad, no and good votes on good texts and on bad ones.
START = ((0.03, 0.37, 0.60), (0.30, 0.35, 0.35))
PSEUDO = 10.0


def posterior(votes: np.ndarray, prior: float, tables: np.ndarray) -> np.ndarray:
    """P(good | votes) for patterns of votes in -1, 0, 1; tables[y, rule, vote + 1] is P(vote | class), class 0 being good."""
    rules = np.arange(votes.shape[1])
    logs = np.log(tables[:, rules, votes + 1]).sum(axis=2)
    return 1 / (1 + np.exp(np.log(1 - prior) + logs[1] - np.log(prior) - logs[0]))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """The prior and the rules' vote tables, by expectation-maximisation over vote patterns with counts.

    Without rows the starting values stay.
    """
    start = np.repeat(np.array(START)[:, None, :], votes.shape[1], axis=1)
    prior, tables = PRIOR, start
    total = counts.sum()
    if not total:
        return prior, tables
    cast = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    for _ in range(rounds):
        p = posterior(votes, prior, tables)
        weight = np.stack((counts * p, counts * (1 - p)))
        sums = np.einsum("yk,krv->yrv", weight, cast)
        mass = weight.sum(axis=1)
        prior = (mass[0] + PSEUDO * PRIOR) / (total + PSEUDO)
        tables = (sums + PSEUDO * start) / (mass[:, None, None] + PSEUDO)
    return prior, tables


def accuracies(tables: np.ndarray) -> np.ndarray:
    """For each rule, the probability that a vote is right, on good texts and on bad ones."""
    return np.stack((tables[0, :, 2] / (tables[0, :, 0] + tables[0, :, 2]), tables[1, :, 0] / (tables[1, :, 0] + tables[1, :, 2])))


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """doc_id, the text's counts, base_failed, votes, probability and kept for each row of docs.

    Each rule votes good (+), bad (-) or abstains (0). Documents enter the
    estimation as vote patterns with counts: at most 3 to the number of rules
    rows, whatever the corpus, come to the driver. Expectation-maximisation
    estimates the prior and how each rule votes on good and on bad texts, which
    gives its accuracy; the posterior of the pattern is the document's
    probability of quality. kept: not base_failed, and the probability is at
    least threshold. base_failed: fewer than 50 words, or more than half of
    them in repeated windows of three.

    Texts are read once, by one task each; the counts are written to the shared
    folder, and the posterior joins them by pattern.

    Null and empty texts have zero counts and fail; a very long text is counted
    whole by one task, which holds its words; a posterior of exactly threshold is
    kept; repeated rows count each
    time; a null doc_id is kept as null; extra columns are ignored; an empty
    table gives no rows.
    """
    names = TextStats._fields
    schema = pa.schema([pa.field(x, pa.int64()) for x in ("doc_id", *names)] + [pa.field("votes", pa.string())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                s = text_stats(text)
                yield doc_id, *s, "".join("-0+"[r.vote(s) + 1] for r in rules)

        yield from emitter(schema, rows())

    body = sources(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string"))
    counted = written(body.mapInArrow(count, spark_schema(schema)), "quality-votes")
    patterns = sorted((r[0], r[1]) for r in counted.groupBy("votes").count().collect())
    votes = np.array([["-0+".index(c) - 1 for c in p] for p, _ in patterns], dtype=np.int64).reshape(len(patterns), len(rules))
    prior, tables = estimate(votes, np.array([n for _, n in patterns], dtype=float))
    found = [(p, float(q)) for (p, _), q in zip(patterns, posterior(votes, prior, tables), strict=True)]
    table = docs.sparkSession.createDataFrame(found, "votes string, probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.join(F.broadcast(table), "votes").select("doc_id", *names, failed.alias("base_failed"), "votes", "probability", (~failed & (F.col("probability") >= threshold)).alias("kept"))
