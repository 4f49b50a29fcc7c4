"""Quality rules: a table of thresholds compiled into one projection.

Each rule of RULES bounds one measure of a text: a length, a share of symbols
or stop words, or a share of lines. ``rated`` compiles the table into one
select of built-in functions: no shuffle, no user function, and every measure
is computed once (values that several measures need are bound by ``let``).
Rows never meet, so a source or group of copies of any size is no hot spot.

Null, empty and blank texts have no words, so base_failed is true and kept
false. Very long texts are taken whole: memory and time grow as n log n of a
text's words. Repeated rows are rated each; ties don't arise; a null doc_id
stays null. Other columns are carried by ``passing`` and left out by
``rated``; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from or have not "
    "der die und den von zu das sich mit des auf für ist im nicht dem ein eine als auch "
    "de la le et les en un du une que est pour par dans avec qui pas sur au "
    "el y los las se del con por no una su para al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= measure <= high; a bound that is None doesn't bind."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The table of thresholds.
RULES = (
    Rule("chars.mean", 2.5, 12.0),
    Rule("symbols.share", None, 0.1),
    Rule("lettered_share", 0.7, None),
    Rule("capital_share", None, 0.4),
    Rule("stop.n", 2, None),
    Rule("stop.share", 0.01, None),
    Rule("dup_line_share", None, 0.5),
    Rule("bullet_share", None, 0.9),
    Rule("ellipsis_share", None, 0.3),
)


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _neighbours(values: Column, key, take) -> Column:
    """take(x) of every x in an ordered array whose key equals that of the value before or after it; inner ones twice."""
    m = F.greatest(F.size(values) - 1, F.lit(0))
    same = F.zip_with(F.slice(values, F.lit(1), m), F.slice(values, F.lit(2), m), lambda a, b: F.when(key(a) == key(b), F.array(take(a), take(b))))
    return F.flatten(F.filter(same, lambda x: x.isNotNull()))


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more, the first included.

    Hashes of windows are sorted with their places; only windows whose 31
    bits have a neighbour with the same are then compared by their words.
    """
    gram = lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    starts = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), lambda _, i: i)
    hashed = F.transform(starts, lambda i: F.shiftleft(F.xxhash64(*gram(i)).bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(i.cast("long")))
    maybe = let(F.sort_array(hashed), lambda s: _neighbours(s, lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")))
    placed = F.transform(F.array_distinct(maybe), lambda i: F.struct(F.array(*gram(i)).alias("g"), i.alias("i")))
    again = let(F.sort_array(placed), lambda s: _neighbours(s, lambda x: x["g"], lambda x: x["i"]))
    return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(*[i + k for k in range(WINDOW)])))))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def _only(text: Column, kind: str) -> Column:
    """How many characters of a text are of a kind, as in a regular expression's class."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def _measures(text: Column, words: Column, lines: Column) -> Column:
    """Every measure of a text, given its words and its lines with a word."""
    n, n_lines = F.size(words), F.size(lines)
    chars = F.length(F.array_join(words, ""))
    symbols = _only(text, re.escape(SYMBOLS))
    dup = n_lines - F.size(F.array_distinct(lines))
    stops = _count(words, lambda w: F.lower(w).isin(STOP_WORDS))
    letters = F.struct(_only(text, r"\p{L}").alias("all"), _only(text, r"\p{Lu}").alias("capital"))
    return F.struct(
        n.cast("long").alias("n_words"), dup.cast("long").alias("n_dup_lines"), _repeated(words).cast("long").alias("n_repeat_words"),
        let(chars, lambda k: F.struct(k.cast("long").alias("n"), _share(k, n).alias("mean"))).alias("chars"),
        let(symbols, lambda k: F.struct(k.cast("long").alias("n"), _share(k, n).alias("share"))).alias("symbols"),
        _share(_count(words, lambda w: w.rlike(r"\p{L}")), n).alias("lettered_share"),
        let(letters, lambda x: _share(x["capital"], x["all"])).alias("capital_share"),
        let(stops, lambda k: F.struct(k.alias("n"), _share(k, n).alias("share"))).alias("stop"),
        _share(dup, n_lines).alias("dup_line_share"),
        _share(_count(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")), n_lines).alias("bullet_share"),
        _share(_count(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")), n_lines).alias("ellipsis_share"),
    )


def measured(text: Column) -> Column:
    """The measures of a text as one struct."""
    words = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: let(lines(t), lambda x: _measures(t, w, x))))


def broken(measures: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The table compiled: names of the rules that the measures break, in the table's order."""
    out = []
    for r in rules:
        m = reduce(lambda c, part: c[part], r.measure.split("."), measures)
        bad = [m < r.low] if r.low is not None else []
        bad += [m > r.high] if r.high is not None else []
        out.append(F.when(reduce(lambda a, b: a | b, bad, F.lit(False)), F.lit(r.measure)))
    return F.array_compact(F.array(*out))


def _base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])


def _rating(text: Column, rules: tuple[Rule, ...]) -> Column:
    """measures, base_failed and the broken rules of a text as one struct."""
    return let(measured(text), lambda m: F.struct(m.alias("m"), _base_failed(m).alias("base_failed"), broken(m, rules).alias("broken")))


def rated(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the names of the broken rules, comma-joined."""
    q = docs.select("doc_id", _rating(F.col("text"), rules).alias("q"))
    at = {"n_words": "n_words", "word_chars": "chars.n", "n_symbols": "symbols.n", "n_dup_lines": "n_dup_lines", "n_repeat_words": "n_repeat_words"}
    base = [F.col(f"q.m.{m}").alias(c) for c, m in at.items()]
    kept = ~F.col("q.base_failed") & (F.size("q.broken") == 0)
    return q.select("doc_id", *base, F.col("q.base_failed").alias("base_failed"), kept.alias("kept"), F.array_join("q.broken", ",").alias("broken"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns."""
    ok = let(_rating(F.col("text"), rules), lambda q: ~q["base_failed"] & (F.size(q["broken"]) == 0))
    return docs.where(ok)
