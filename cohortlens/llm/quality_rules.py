"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Metrics are whole numbers, so that ratios compare exactly: a rule says that ``scale * metric`` must lie
between ``low * per`` and ``high * per``.  Everything is evaluated inside one projection by Spark's own
functions, without a shuffle and without user functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is a that it for on with as was by at be this are from or an not "
    "la de le les des et un une en du que pour est par sur au pas dans qui ce il "
    "der die das und zu den mit von ist auf ein eine nicht im für dem sich "
    "el los las del y se con por es su para como"
).split()

# The languages of the list as labels name them, their letters, and labels that name no language.
COVERED = r"^(?:en|eng|english|fr|fra|fre|french|de|deu|ger|german|es|spa|spanish)(?:[-_].*)?$"
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäæçéèêëîïôœùûüÿñßáíóú"
UNNAMED = ["", "und", "unknown", "none", "null", "mul", "mis", "zxx", "other", "n/a"]
_NOT_OTHER = rf"[\P{{L}}{LETTERS}{LETTERS.upper()}]+"
# Scripts that are written without spaces.
UNSPACED_SCRIPTS = "Han Hiragana Katakana Thai Lao Khmer Myanmar Tibetan".split()
_UNSPACED = "[^" + "".join(f"\\p{{Is{s}}}" for s in UNSPACED_SCRIPTS) + "]+"

METRICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_stop_words",
)


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``low * per <= scale * metric <= high * per``; ``per`` None stands for 1.

    ``unless`` tells, from the text and the label of its language, where the rule doesn't apply.
    """

    name: str
    metric: str
    per: str | None = None
    scale: int = 1
    low: int | None = None
    high: int | None = None
    unless: Callable[[Column, Column], Column] | None = None

    def fails(self, metric: Callable[[str], Column]) -> Column:
        value = F.lit(self.scale) * metric(self.metric)
        of = metric(self.per) if self.per else F.lit(1)
        failed = F.lit(False)
        if self.low is not None:
            failed = failed | (value < F.lit(self.low) * of)
        if self.high is not None:
            failed = failed | (value > F.lit(self.high) * of)
        return failed


def _share(text: Column, rest: str, percent: int) -> Column:
    """Whether so much of the text's letters is left when ``rest`` is taken out."""
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("bigint")
    return (left(rest) > 0) & (100 * left(rest) >= percent * left(r"\P{L}+"))


def other_language(text: Column, lang: Column) -> Column:
    """The label names a language without words in the list, or 3 % of the letters are none of its languages'."""
    label = F.lower(F.trim(lang))
    named = label.isNotNull() & ~label.isin(*UNNAMED) & ~label.rlike(COVERED)
    return F.coalesce(named, F.lit(False)) | F.coalesce(_share(text, _NOT_OTHER, 3), F.lit(False))


def unspaced_script(text: Column, lang: Column) -> Column:
    """A third of the letters belong to scripts written without spaces, whose words can't be told."""
    return F.coalesce(_share(text, _UNSPACED, 33), F.lit(False))


#: Too short, or too much of it said twice.
BASE_RULES = (
    Rule("words", "n_words", low=20),
    Rule("repeated_words", "n_repeat_words", per="n_words", scale=100, high=30),
)

RULES = (
    Rule("word_length", "word_chars", per="n_words", low=2, high=15, unless=unspaced_script),
    Rule("symbols", "n_symbols", per="n_words", scale=100, high=10),
    Rule("stop_words", "n_stop_words", per="n_words", scale=100, low=2, unless=other_language),
    Rule("duplicate_lines", "n_dup_lines", per="n_lines", scale=100, high=60),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(words: Column) -> Column:
    """Number of words that stand in a window of eight which occurs twice or more."""

    def covered(windows: Column) -> Column:
        places = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(found: Column) -> Column:
            """Ascending starts of the windows that have a twin."""
            same = lambda x, i: F.coalesce(F.get(found, i).getField("h") == x.getField("h"), F.lit(False))
            twins = F.filter(found, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.sort_array(F.transform(twins, lambda x: x.getField("i")))

        def length(at: Column) -> Column:
            steps = F.transform(
                at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))
            )
            return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

        return _let(places, lambda found: _let(starts(found), length))

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - WINDOW + 1),
        lambda i: F.xxhash64(F.slice(words, i, WINDOW)),
    )
    # Most texts repeat nothing: only the others are sorted.
    found = _let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)),
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(found)


def metrics(text: Column) -> Column:
    """Struct of all :data:`METRICS` (long) of a whole text; a null text counts as empty.

    Words are runs without ASCII white space; lines end at a line feed, and only lines with a word count.
    """
    text = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("bigint")

    def of_words(words: Column) -> Column:
        stop = F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(F.array_join(words, ""))).alias("word_chars"),
            long(_repeated(words)).alias("n_repeat_words"),
            long(F.size(stop)).alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            long(F.size(lines)).alias("n_lines"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        )

    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))
    symbols = long(F.length(text) - F.length(F.translate(text, SYMBOLS, "")))
    parts = F.array(
        F.struct(
            _let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), symbols.alias("s")
        )
    )
    place = {"n_lines": "l", "n_dup_lines": "l", "n_symbols": "s"}

    def flat(found: Column) -> Column:
        columns = []
        for name in METRICS:
            part = found.getField(place.get(name, "w"))
            columns.append((part if name == "n_symbols" else part.getField(name)).alias(name))
        return F.struct(*columns)

    return F.get(F.transform(parts, flat), F.lit(0))


def failed(metric: Callable[[str], Column], rules: Sequence[Rule], text: Column, lang: Column) -> Column:
    """Names of the rules that a text fails."""

    def fails(rule: Rule) -> Column:
        # The text is read again only where the rule would fail it.
        return rule.fails(metric) & ~rule.unless(text, lang) if rule.unless else rule.fails(metric)

    return F.array_compact(F.array(*(F.when(fails(rule), F.lit(rule.name)) for rule in rules)))


def _label(lang: str | None) -> Column:
    return (F.col(lang) if lang else F.lit(None)).cast("string")


def judged(
    df: DataFrame,
    text: str = "text",
    base_rules: Sequence[Rule] = BASE_RULES,
    rules: Sequence[Rule] = RULES,
    into: str = "quality",
    lang: str | None = None,
) -> DataFrame:
    """Add the struct ``into``: all metrics, ``base_failed``, ``failed`` (names) and ``kept``.

    ``lang`` names the column with the label of the language, if there is one; any other column is carried
    unread.  Null and empty texts have no words and fail the base rules;
    repeated rows are judged alike; a column named as ``into`` is replaced.
    """
    every = [*base_rules, *rules]

    def verdict(found: Column) -> Column:
        metric = found.getField
        fails = failed(metric, every, F.col(text), _label(lang))
        return F.struct(
            *(metric(name).alias(name) for name in METRICS),
            (F.size(failed(metric, base_rules, F.col(text), _label(lang))) > 0).alias("base_failed"),
            fails.alias("failed"),
            (F.size(fails) == 0).alias("kept"),
        )

    return df.withColumn(into, _let(metrics(F.col(text)), verdict))


def kept(
    df: DataFrame,
    text: str = "text",
    base_rules: Sequence[Rule] = BASE_RULES,
    rules: Sequence[Rule] = RULES,
    lang: str | None = None,
) -> DataFrame:
    """The rows of ``df`` whose text passes every rule, with the columns of ``df``."""
    # One expression that binds the metrics: a filter on a column of verdicts would repeat them per rule.
    every = [*base_rules, *rules]
    none = lambda found: F.size(failed(found.getField, every, F.col(text), _label(lang))) == 0
    return df.where(_let(metrics(F.col(text)), none))
