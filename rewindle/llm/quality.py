"""Quality rules: one table of thresholds, compiled into one projection of built-in functions.

Measures of a text, words being runs of anything but white space (blank, tab to carriage return):

=================  ===========================================================================
``n_words``        words
``word_chars``     code points in words
``n_symbols``      characters among ``# * $ % & | < >``
``n_lines``        lines, split at line feeds, that hold a word
``n_dup_lines``    such lines equal to an earlier line of the text
``n_repeat_words`` words inside a three-word window that the text holds twice or more
``n_stop``         words that are stop words
=================  ===========================================================================

A null or empty text has no words and all counts are zero. Rows are judged one by one, so repeated
rows get the same verdict each, and a table without rows gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewindle.llm.common import fresh, words

SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for on as with by a an it at from or are be this was "
    "de la le et les des en un une du que qui dans est pour par sur pas au "
    "der die das und ist den von zu mit im dem auf für nicht sich ein eine als "
    "el los las y por con para del se su al lo no es"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``low <= top / bottom <= high``; ``bottom`` None stands for 1.

    A ratio whose lower part is zero counts as zero.
    """

    name: str
    top: str
    bottom: str | None
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = F.col(self.top).cast("double")
        if self.bottom:
            value = F.when(F.col(self.bottom) > 0, value / F.col(self.bottom)).otherwise(0.0)
        checks = [F.lit(True)]
        if self.low is not None:
            checks.append(value >= self.low)
        if self.high is not None:
            checks.append(value <= self.high)
        return reduce(lambda a, b: a & b, checks)


#: The two rules every caller shares.
BASE_RULES = (
    Rule("words", "n_words", None, low=50),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
)
#: The production table: wide bounds, so that plain prose of any of the languages passes.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.2),
    Rule("stop_words", "n_stop", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
)

_INDEX = 31  # bits of a packed window that hold its position


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` and the measures of its column ``text``.

    Windows are first compared by hash: hash and position share a long, so sorting a plain array of
    longs brings equal ones together. Only windows whose hashes meet are then compared word by word,
    which makes the counts exact whatever the hashes do.
    """
    w, lines, keys, meet, same, at = fresh(df, "w", "lines", "keys", "meet", "same", "at")
    n = F.size(w)
    window = F.transform(
        F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _INDEX).bitwiseOR(i.cast("long")),
    )

    def neighbour(array: str, key) -> Column:
        """Items of a sorted array that share ``key`` with the item before or after."""
        return F.filter(array, lambda x, j: F.coalesce(key(x) == key(F.get(array, j - 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(array, j + 1)), F.lit(False)))

    def words_at(k: Column) -> Column:
        i = k.bitwiseAND((1 << _INDEX) - 1).cast("int")
        return F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))

    whole = F.coalesce(F.col(text), F.lit(""))
    split = df.withColumns({w: words(F.col(text)), lines: F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    hashed = split.withColumn(keys, F.sort_array(window))
    hashed = hashed.withColumn(meet, neighbour(keys, lambda x: F.shiftright(x, _INDEX)))
    exact = hashed.withColumn(same, F.sort_array(F.transform(meet, words_at)))
    exact = exact.withColumn(at, F.sort_array(F.transform(neighbour(same, lambda x: F.struct(x["a"], x["b"], x["c"])), lambda x: x["i"])))
    covered = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
    # A filter on a measure must not be pushed below this projection, where it would work out all steps
    # anew for each use; Spark pushes none below a projection that numbers its rows.
    once = F.when(F.monotonically_increasing_id() >= 0, n.cast("long"))
    return exact.select(
        *[F.col(f"`{c}`") for c in df.columns],
        once.alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop"),
    )


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``measured`` rows with ``base_failed``, ``kept`` and the names of the rules a text breaks.

    Columns of ``df`` that bear the name of a measure or verdict are left out in its favour.
    """
    own = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "base_failed", "kept", "broken"}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])
    all_of = lambda some: reduce(lambda a, b: a & b, [r.holds() for r in some], F.lit(True))
    broken = F.filter(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull())
    return measured(df, text).withColumns({"base_failed": ~all_of(base), "kept": all_of(base) & all_of(rules), "broken": broken})


def well_formed(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes every rule, with their own columns."""
    slim = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = judged(df.select(F.col(text).alias("text"), slim.alias("row")), "text", rules)
    return out.where("kept").select("row.*")
