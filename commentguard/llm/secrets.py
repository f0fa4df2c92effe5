"""Secret scan: fixed kinds, and strings of high entropy in a sliding window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from commentguard.llm.quality_rules import bound

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Strings long enough for a window, of the characters that keys are written in.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: The character class of a candidate is the first whose pattern it matches, with
#: the least bits a character of a window that make it a secret.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alphanumeric", r"^[A-Za-z0-9]+$", 3.7), ("base64", r".*", 3.9))
#: Candidates that are no secrets whatever their entropy: words, numbers, paths and identifiers
#: written in words, and runs without a digit or without a letter.
ALLOWED = (
    r"^[A-Za-z+/_=-]+$", r"^[0-9+/_=-]+$", r"^[A-Za-z]+[0-9]{0,4}$", r"^([A-Z]?[a-z]+|[0-9]{1,4})([/_-]([A-Z]?[a-z]+|[0-9]{1,4}))+$",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<start:int,kind:string,end:int>>"
_FOUND = "array<struct<start:int,end:int,value:string>>"
#: Elements of an array that are folded into another, or compared with another's, at once.
PART = 256
#: Windows of a long candidate that are looked at in one piece.
PIECE = 512


def found(text: Column, pattern: str, kind: str) -> Column:
    """All matches in order with their places in code points, as (start, end, value).

    The places follow from the lengths of what the matches leave between them.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gaps"), matches.alias("matches")), lambda p: p["matches"].isNotNull())

    def located(all_pairs: Column) -> Column:
        def reach(p: Column) -> Column:
            return F.length(p["gaps"]) + F.length(p["matches"])

        # A fold that adds to an array copies it at each step, so it goes over parts, and over the parts' lengths.
        parts = F.transform(numbers_of_parts(all_pairs), lambda k: F.slice(all_pairs, k * PART + 1, PART))
        lengths = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, p: n + reach(p)))
        heads = F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))

        def of_part(part: Column, head: Column) -> Column:
            def step(s: Column, p: Column) -> Column:
                begin, end = s["at"] + F.length(p["gaps"]), s["at"] + reach(p)
                one = F.array(F.struct(begin.alias("start"), end.alias("end"), p["matches"].alias("value")))
                return F.struct(end.alias("at"), F.concat(s["out"], one).alias("out"))

            start = F.struct(head.alias("at"), F.expr(f"cast(array() as {_FOUND})").alias("out"))
            return F.aggregate(part, start, step, lambda s: s["out"])

        return F.flatten(F.zip_with(parts, F.slice(heads, 1, F.size(parts)), of_part))

    return F.when(text.rlike(pattern), bound(pairs, located)).otherwise(F.expr(f"cast(array() as {_FOUND})"))


def numbers_of_parts(values: Column) -> Column:
    """The numbers, from 0, of an array's parts of ``PART`` elements; there is one at least."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / PART), F.lit(1)).cast("int") - 1)


def highest_entropy(value: Column) -> Column:
    """The most bits a character of any window of ``WINDOW`` characters.

    sum(c log2 c) over the characters' counts goes from one window to the next by
    the character that leaves and the one that enters: only their two counts
    change.  The entropy is log2(n) - sum / n.  A step costs the window, whatever
    the string's length.
    """
    weights = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 2)]
    # What the sum changes by when a character that is there c times leaves, and when it enters.
    leaving = F.array(F.lit(0.0), *[F.lit(weights[c - 1] - weights[c]) for c in range(1, WINDOW + 1)])
    entering = F.array(*[F.lit(weights[c + 1] - weights[c]) for c in range(WINDOW + 1)])

    def best_of(piece: Column) -> Column:
        def count(first: Column, n: Column, letter: Column) -> Column:
            return n - F.length(F.replace(F.substring(piece, first, n), letter, F.lit("")))

        def step(s: Column, i: Column) -> Column:
            # One character leaves the window of the last WINDOW, then the new one enters.
            first = F.greatest(i - WINDOW + 1, F.lit(1))
            gone = F.when(i > WINDOW, count(i - WINDOW, F.lit(WINDOW), F.substring(piece, i - WINDOW, F.lit(1)))).otherwise(0)
            known = count(first, i - first, F.substring(piece, i, F.lit(1)))
            moved = s["sum"] + F.get(leaving, gone) + F.get(entering, known)

            def taken(total: Column) -> Column:
                bits = F.when(i >= WINDOW, F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(0.0)
                return F.struct(total.alias("sum"), F.greatest(s["best"], bits).alias("best"))

            return bound(moved, taken)

        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.length(piece)), zero, step, lambda s: s["best"])

    # Pieces of a long string overlap by a window less one; in a short string a place is near its start.
    n = F.greatest(F.ceil((F.length(value) - WINDOW + 1) / PIECE), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(value, k * PIECE + 1, F.lit(PIECE + WINDOW - 1)))
    return F.array_max(F.transform(pieces, best_of))


def _spans(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """The three fixed kinds, leftmost first and without overlap within a kind."""
    value = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    assign = F.filter(found(text, ASSIGN, "assign"), lambda m: F.length(value(m)) >= 6)
    return {
        "assign": _spans(assign, "assign"),
        "access": _spans(found(text, ACCESS, "access"), "access"),
        "hex": _spans(found(text, HEX, "hex"), "hex"),
    }


def entropy_spans(text: Column) -> Column:
    """Candidates whose densest window reaches the least entropy of their class, without allowed ones."""
    def secret(m: Column) -> Column:
        value, allowed, least = m["value"], F.lit(False), F
        for pattern in ALLOWED:
            allowed = allowed | value.rlike(pattern)
        for _, pattern, bits in CLASSES:
            least = least.when(value.rlike(pattern), bits)
        return F.when(allowed, False).otherwise(bound(value, highest_entropy) >= least)

    return _spans(F.filter(found(text, CANDIDATE, "entropy"), secret), "entropy")


KINDS = ("assign", "access", "hex", "entropy")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, an array of (start, kind, end), in code points, end exclusive.

    An entropy span that lies within a span of a fixed kind is not repeated.
    Null and empty texts have no spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with_base = docs.select("doc_id", text.alias("_text")).withColumns(base_spans(F.col("_text")))
    fixed = F.concat("assign", "access", "hex")
    added = without_inner(entropy_spans(F.col("_text")), fixed)
    return with_base.withColumn("entropy", added).select("doc_id", *KINDS)


def without_inner(spans: Column, outer: Column) -> Column:
    """The spans, in order, that lie in none of ``outer``; a part of them is compared only with what it touches."""
    def kept(every: Column, known: Column) -> Column:
        def of_part(part: Column) -> Column:
            low, high = F.get(part, 0)["start"], F.element_at(part, -1)["end"]
            near = F.filter(known, lambda f: (f["end"] > low) & (f["start"] < high))
            return bound(near, lambda some: F.filter(part, lambda x: ~F.exists(some, lambda f: (f["start"] <= x["start"]) & (x["end"] <= f["end"]))))

        parts = F.transform(numbers_of_parts(every), lambda k: F.slice(every, k * PART + 1, PART))
        return F.when(F.size(every) > 0, F.flatten(F.transform(parts, of_part))).otherwise(every)

    return bound(spans, lambda every: bound(outer, lambda known: kept(every, known)))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), F.array_position(F.lit(list(KINDS)), x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")
    ))
    return F.array_join(F.transform(F.sort_array(order), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
