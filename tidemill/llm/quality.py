"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Everything is DataFrame expressions. Measures and votes come from one pass without a shuffle; the model is
fitted on the counts of the vote patterns, at most 3 ** len(RULES) rows whatever the corpus; the driver sees
one row of parameters a round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import SPACES, stored, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _hashed_with_next(hashes: Column, step: int) -> Column:
    """Each hash combined with the one ``step`` places on: from windows of ``step`` words come those of twice as many."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _whole(windows: str, words: int) -> Column:
    """The windows that end within the text: what the shifted zip made beyond its last word goes."""
    return F.slice(F.col(windows), 1, F.greatest(F.col("_n") - (words - 1), F.lit(0)))


def _covered(pairs: str) -> Column:
    """Of (window, start) sorted by window: how many words the windows with an equal neighbour cover."""
    at = lambda i: F.get(F.col(pairs), i)
    equal = lambda i, j: F.coalesce(at(i)["w"] == at(j)["w"], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: equal(i, i - 1) | equal(i, i + 1))
    starts = F.sort_array(F.transform(found, lambda i: at(i)["i"]))
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, first, lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n")), lambda s: s["n"])


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``given`` (a struct of the columns of ``df``), ``MEASURES`` and base_failed, and what the rules need.

    That is n_lines (with a word), n_ended (of these, ending in . ! or ?), n_symbol_lines (with a symbol), n_digits
    and n_distinct (words). Windows of eight words are built by doubling, and only where one of four repeats.
    """
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("given"))
    given, text = ["given"], f"given.`{text}`"
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    one = df.withColumns({"_t": t, "_words": words_of(F.col(text)), "_lines": lines})
    two = one.select(
        *[F.col(f"`{c}`") for c in given],
        F.size("_words").alias("_n"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike("[.!?]$"))).cast("long").alias("n_ended"),
        F.size(F.filter("_lines", lambda x: x.rlike(f"[{SYMBOLS}]"))).cast("long").alias("n_symbol_lines"),
    )
    three = two.withColumn("_h4", _hashed_with_next(_hashed_with_next(F.col("_h"), 1), 2)).withColumn("n_distinct", F.size(F.array_distinct("_h")).cast("long"))
    repeated = (F.col("_n") > WINDOW) & (F.size(F.array_distinct(_whole("_h4", 4))) < F.col("_n") - 3)
    four = three.withColumn("_h8", F.when(repeated, _hashed_with_next(F.col("_h4"), 4))).withColumn("_w", _whole("_h8", WINDOW))
    paired = F.array_sort(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    five = four.withColumn("_p", F.when(F.size("_w") > F.size(F.array_distinct("_w")), paired))
    six = five.withColumn("n_repeat_words", F.coalesce(_covered("_p"), F.lit(0)).cast("long")).withColumn("n_words", F.col("_n").cast("long"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return six.withColumn("base_failed", base).select(*[F.col(f"`{c}`") for c in given], *MEASURES, "n_digits", "n_lines", "n_ended", "n_symbol_lines", "n_distinct", "base_failed")


@dataclass(frozen=True)
class Rule:
    """Votes +1 (good) where ``good`` holds, else -1 (bad) where ``bad`` does, else 0 (abstains)."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.good), 1).when(F.expr(self.bad), -1).otherwise(0).cast("int").alias(f"v_{self.name}")


#: Bounds are on ratios, so they hold for any length; the measures are integers, and products replace divisions.
#: Between a rule's two bounds it abstains. The model takes votes to be independent, given the class.
RULES = (
    Rule("word_length", "word_chars BETWEEN 4 * n_words AND 7 * n_words", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols >= n_words"),
    Rule("symbol_lines", "10 * n_symbol_lines <= n_lines", "2 * n_symbol_lines > n_lines"),
    Rule("repetition", "20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    Rule("lines", "10 * n_dup_lines <= n_lines", "3 * n_dup_lines > n_lines AND n_dup_lines >= 2"),
    Rule("length", "n_words >= 50", "n_words < 30"),
    Rule("digits", "20 * n_digits <= word_chars", "5 * n_digits > word_chars"),
    Rule("line_ends", "2 * n_ended >= n_lines", "5 * n_ended < n_lines"),
    Rule("variety", "2 * n_distinct >= n_words OR n_distinct >= 300", "3 * n_distinct < n_words AND n_distinct < 300"),
)

#: To begin with: share of good texts, and how often a rule that votes is right about good and about bad ones.
START = (0.9, 0.95, 0.3)
#: So many votes at the starting rates are added to each count, so that a rule that never objects has an accuracy too.
PSEUDO_VOTES = 10.0


@dataclass(frozen=True)
class QualityModel:
    """prior: share of good texts; accuracy: for each vote column, P(+1 | good) and P(-1 | bad) where the rule votes."""

    prior: float
    accuracy: dict[str, tuple[float, float]]

    def posterior(self) -> Column:
        """Probability that a row with these vote columns is good; votes are independent, abstention says nothing."""
        odds = F.log(F.lit(self.prior) / F.lit(1 - self.prior))
        for name, (good, bad) in self.accuracy.items():
            odds = odds + F.when(F.col(name) == 1, F.lit(math.log(good / (1 - bad)))).when(F.col(name) == -1, F.lit(math.log((1 - good) / bad))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(votes: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 50, settled: float = 1e-4) -> QualityModel:
    """Expectation-maximisation over all rows of ``votes``, by their vote patterns.

    Each round takes the posterior of every pattern and from it the prior and each rule's two accuracies, smoothed
    by ``PSEUDO_VOTES``. Accuracies are free but for one guard, which keeps the two classes from changing places: a
    rule must object to bad texts at least as often as to good ones, else its votes count for nothing in that round
    (both classes get its overall rate). It ends when nothing moves by over ``settled``, or after ``rounds``.
    An empty table keeps the starting values.
    """
    names = [f"v_{r.name}" for r in rules]
    patterns = stored(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "quality-patterns")
    model = QualityModel(START[0], {v: START[1:] for v in names})
    smooth = lambda hits, misses, rate: (hits + PSEUDO_VOTES * rate) / (hits + misses + PSEUDO_VOTES)
    for _ in range(rounds):
        weighed = patterns.withColumn("p", model.posterior()).withColumns({"good": F.col("n") * F.col("p"), "bad": F.col("n") * (1 - F.col("p"))})
        sums = [F.coalesce(F.sum(F.when(F.col(v) == vote, F.col(kind))), F.lit(0.0)) for v in names for kind in ("good", "bad") for vote in (1, -1)]
        good, bad, *of_rules = weighed.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0)), *sums).first()
        accuracy = {}
        for v, (yes_good, no_good, yes_bad, no_bad) in zip(names, zip(*[iter(of_rules)] * 4)):
            right_good, right_bad = smooth(yes_good, no_good, START[1]), smooth(no_bad, yes_bad, START[2])
            if right_bad < 1 - right_good:
                objects = (no_good + no_bad + PSEUDO_VOTES * (1 - START[1] + START[2])) / (yes_good + no_good + yes_bad + no_bad + 2 * PSEUDO_VOTES)
                right_good, right_bad = 1 - objects, objects
            accuracy[v] = (right_good, right_bad)
        new = QualityModel(smooth(good, bad, START[0]), accuracy)
        moved = max(abs(new.prior - model.prior), *(abs(x - y) for v in names for x, y in zip(new.accuracy[v], model.accuracy[v])))
        model = new
        if moved < settled:
            break
    return model


def quality(documents: DataFrame, keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``documents``' columns (or ``keep`` of them), ``MEASURES``, base_failed, posterior and kept.

    ``documents`` has text. kept is false where base_failed, else whether the posterior reaches ``threshold``. The
    model is fitted on the rows that pass the base. Null and empty texts have no words, so they fail the base;
    rows with a null doc_id and repeated rows are rows like others. A column of ``documents`` that is named as one
    of those added gives way to it.
    """
    columns = documents.columns if keep is None else keep
    judged = _judged(documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, "text"])]), [F.col(f"given.`{c}`").alias(f"_g{i}") for i, c in enumerate(columns)], threshold)
    added = [*MEASURES, "base_failed", "posterior", "kept"]
    return judged.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(columns) if c not in added], *added)


def _votes() -> list[Column]:
    return [r.vote() for r in RULES]


def _verdict(rows: DataFrame, model: QualityModel, threshold: float) -> DataFrame:
    return rows.withColumn("posterior", model.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def _judged(texts: DataFrame, kept: list[Column], threshold: float) -> DataFrame:
    """Measures, votes and verdict of each row, with the columns ``kept`` of its ``given``; votes are stored once."""
    rows = stored(with_measures(texts).select(*kept, *MEASURES, "base_failed", *_votes()), "quality-votes")
    return _verdict(rows, fit(rows.where("NOT base_failed")), threshold)


#: Always true. A filter on a row number is not pushed below it; pushed down, it would repeat each measure where it is used.
_UNPUSHED = "_row >= 0"


def quality_filter(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that ``quality`` keeps, with their columns.

    Texts are measured twice, once for the fit and once for the verdict: nothing is shuffled, and no copy of the
    texts is stored between the two.
    """
    measured = with_measures(documents).select("given", "base_failed", *_votes()).withColumn("_row", F.monotonically_increasing_id())
    model = fit(measured.where(F.expr(_UNPUSHED) & ~F.col("base_failed")))
    return _verdict(measured, model, threshold).where(F.expr(_UNPUSHED) & F.col("kept")).select("given.*")


def vote_report(documents: DataFrame) -> DataFrame:
    """(rule, said_good, said_bad, abstained, right_on_good, right_on_bad, prior): a row for each rule, over the rows that pass the base.

    The accuracies are those that ``fit`` estimates; an empty table has counts of zero and the starting values.
    """
    votes = stored(with_measures(documents.select("text")).where("NOT base_failed").select(*_votes()), "quality-report")
    model = fit(votes)
    counts = votes.agg(*[F.count_if(F.col(f"v_{r.name}") == x) for r in RULES for x in (1, -1, 0)]).first()
    rows = [(r.name, *counts[3 * i : 3 * i + 3], *model.accuracy[f"v_{r.name}"], model.prior) for i, r in enumerate(RULES)]
    return documents.sparkSession.createDataFrame(rows, "rule string, said_good long, said_bad long, abstained long, right_on_good double, right_on_bad double, prior double")
