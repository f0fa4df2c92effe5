"""Quality rules as a short-circuit cascade, ordered by rejections for their cost."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Rows on which costs and rejections are measured; they only set the order, never a verdict.
SAMPLE_ROWS = 2000


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none in a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    none = F.expr("cast(array() as array<string>)")
    return bound(trimmed, lambda t: F.when(t == "", none).otherwise(F.split(t, WORD_GAP)))


def repeated_words(w: Column) -> Column:
    """Words inside five-word windows that the text holds twice or more, the first included."""
    spots = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(spots, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                earlier, later = F.get(p, i - 1)["h"], F.get(p, i + 1)["h"]
                return F.coalesce(x["h"] == earlier, F.lit(False)) | F.coalesce(x["h"] == later, F.lit(False))

            return F.sort_array(F.transform(F.filter(p, twin), lambda x: x["i"]))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            bound(pairs, places), start,
            lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n")),
            lambda s: s["n"],
        )

    counted = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(w) <= WINDOW, 0).otherwise(counted)


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != "")


#: Figures of a text; each is 0 for a null text.
METRICS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words(t)).cast("long"),
    "word_chars": lambda t: F.length(F.concat_ws("", words(t))).cast("long"),
    "n_symbols": lambda t: F.coalesce(F.regexp_count(t, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"),
    "n_lines": lambda t: F.size(worded_lines(t)).cast("long"),
    "n_dup_lines": lambda t: bound(worded_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": lambda t: bound(words(t), repeated_words).cast("long"),
    "n_capitals": lambda t: F.coalesce(F.regexp_count(t, F.lit("[A-Z]")), F.lit(0)).cast("long"),
}


@dataclass(frozen=True)
class Rule:
    """A name and the condition under which a document goes, over a getter of figures."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
)
MORE_RULES = (
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 14 * m("n_words"))),
    Rule("duplicate_lines", lambda m: (2 * m("n_dup_lines") > m("n_lines")) & (m("n_dup_lines") >= 2)),
    Rule("capitals", lambda m: 10 * m("n_capitals") > 4 * m("word_chars")),
)
RULES = BASE_RULES + MORE_RULES


def figures(given: tuple[str, ...] = ()) -> Callable[[str], Column]:
    """A metric as the column of that name where it is given, else computed from the text."""
    return lambda name: F.col(name) if name in given else METRICS[name](F.col("text"))


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample of rows, the most rejections for a second first.

    Ties, as on an empty table, keep the given order.
    """
    total = docs.count()
    sample = docs.sample(fraction=min(1.0, 1.2 * sample_rows / max(total, 1)), seed=7).limit(sample_rows).persist()
    try:
        def seconds(condition: Column) -> tuple[float, float]:
            best, share = float("inf"), 0.0
            for _ in range(2):  # the first run also compiles
                began = time.perf_counter()
                share = sample.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("int"))).first()[0] or 0.0
                best = min(best, time.perf_counter() - began)
            return best, share

        empty = seconds(F.lit(False))[0]
        measured = []
        for rule in rules:
            took, share = seconds(rule.rejects(figures()))
            measured.append((rule, max(took - empty, 1e-3), share))
    finally:
        sample.unpersist()
    return sorted(measured, key=lambda x: -x[2] / x[1])


def quality_cascade(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
    given: tuple[str, ...] = (), measured_on: DataFrame | None = None,
) -> DataFrame:
    """Add ``failed`` (the first rule that rejects, null if none) and ``kept``.

    ``given`` names the figures that ``docs`` has as columns; costs are those on
    ``measured_on``, where given.  Other columns pass.  Rules are tried in the order of ``ordered_rules``; a document that one
    rejects is spared the rest.  The verdict does not depend on the order,
    ``failed`` does.  A null or empty text has no words and fails; a rule whose
    condition is null does not reject.
    """
    get = figures(given)
    chain = F
    for rule, _, _ in ordered_rules(docs if measured_on is None else measured_on, rules, sample_rows):
        chain = chain.when(F.coalesce(rule.rejects(get), F.lit(False)), rule.name)
    failed = chain.otherwise(F.lit(None)) if rules else F.lit(None).cast("string")
    return docs.withColumn("failed", failed).withColumn("kept", F.col("failed").isNull())


def with_figures(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Add metrics as columns; those of words come from one split of the text."""
    of_words = {
        "n_words": F.size,
        "word_chars": lambda w: F.length(F.concat_ws("", w)),
        "n_repeat_words": repeated_words,
    }
    own = [n for n in names if n in of_words]

    def counted(w: Column) -> Column:
        return F.struct(*[of_words[n](w).cast("long").alias(n) for n in own])

    text = F.col("text")
    split = docs.withColumn("_words", bound(words(text), counted)) if own else docs
    columns = {n: F.col("_words")[n] if n in own else METRICS[n](text) for n in names}
    return split.withColumns(columns).drop("_words")
