"""Phrase lexicons and their matching against normalised text.

A single word matches when it is a token.  A phrase of several words matches
when its first word is a token and the phrase occurs anywhere in the text, so
it has no right boundary: "your kind" also hits "your kindness".

Two forms give the same signals, and a list that a lexicon lacks is empty in both:

* the expression form turns a lexicon of bounded size into literals; it needs
  no Python and is what batch and stream moderation use;
* the scan form searches each text once with an automaton of all phrases, for
  lexicons beyond that bound.  Neither shuffles or needs a key.
"""

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from commentguard import fixed_values as fv

MATCHER_LISTS = [
    "severe", "threat", "soft", "profanity", "directed_attack", "protected_abuse",
    "group_target",
]
TOKEN_LISTS = ["movie", "user", "community"]
LOOSE_LISTS = ["hate_word", "fan_word"]
SIGNAL_LISTS = MATCHER_LISTS + TOKEN_LISTS + LOOSE_LISTS

TONE_LISTS = ["positive", "negative"]

# Up to this many phrases a lexicon is turned into literals.
MAX_LITERAL_PHRASES = 5_000
# Phrases of one automaton; a larger lexicon is searched with several.
PART_PHRASES = 200_000
# Texts that lie in a worker as Python strings at once.
PIECE = 128


def build_lexicon(spark: SparkSession, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """(list, phrase) rows of the given word lists, with the match index columns."""
    lists = fv.LEXICON if lists is None else lists
    rows = [(name, phrase) for name, phrases in lists.items() for phrase in phrases]
    return with_index(spark.createDataFrame(rows, "list string, phrase string"))


def with_index(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(
        "list",
        "phrase",
        F.substring_index("phrase", " ", 1).alias("first"),
        F.contains("phrase", F.lit(" ")).alias("is_phrase"),
    )


def literal_lists(lexicon: DataFrame | dict | None) -> dict[str, list[str]] | None:
    """The lexicon as word lists, or None when it is too large for literals."""
    if lexicon is None:
        return fv.LEXICON
    if isinstance(lexicon, dict):
        return lexicon
    rows = lexicon.select("list", "phrase").limit(MAX_LITERAL_PHRASES + 1).collect()
    if len(rows) > MAX_LITERAL_PHRASES:
        return None
    lists: dict[str, list[str]] = {}
    for row in rows:
        lists.setdefault(row["list"], []).append(row["phrase"])
    return lists


def _words(phrases):
    return [p for p in phrases if " " not in p]


def _phrases_by_first(phrases):
    groups: dict[str, list[str]] = {}
    for phrase in phrases:
        if " " in phrase:
            groups.setdefault(phrase.split(" ", 1)[0], []).append(phrase)
    return groups


# --- Expression form ---------------------------------------------------------
# Written as SQL text: a list of a hundred phrases is then one expression to
# hand to the session instead of hundreds of single calls.


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _one_of(column: str, words: list[str]) -> str:
    return f"{column} IN ({', '.join(_quoted(w) for w in words)})" if words else "false"


def _any_within(text: str, phrases: list[str]) -> str:
    return " OR ".join(f"contains({text}, {_quoted(p)})" for p in phrases) or "false"


def hit_tokens(tokens: str, lists: dict[str, list[str]]) -> Column:
    """The tokens that are a word, or begin a phrase, of any signal list."""
    words = sorted({p.split(" ", 1)[0] for name in SIGNAL_LISTS for p in lists.get(name, [])})
    return F.expr(f"array_distinct(filter({tokens}, t -> {_one_of('t', words)}))")


def has_token(tokens: str, words: list[str]) -> Column:
    return F.expr(f"exists({tokens}, t -> {_one_of('t', words)})")


def contains(hits: str, normalized: str, phrases: list[str]) -> Column:
    """Does a phrase of the list match?  Reads only the tokens that can matter."""
    tests = [_one_of("t", _words(phrases))]
    for first, members in _phrases_by_first(phrases).items():
        tests.append(f"(t = {_quoted(first)} AND ({_any_within(normalized, members)}))")
    return F.expr(f"exists({hits}, t -> {' OR '.join(tests)})")


def contains_any(tokens: str, normalized: str, terms: list[str]) -> Column:
    """As ``contains``, but a phrase may match without its first word as a token."""
    phrases = [p for p in terms if " " in p]
    return has_token(tokens, _words(terms)) | F.expr(_any_within(normalized, phrases))


def occurring(normalized: str, terms: list[str]) -> Column:
    """How many of the terms occur anywhere in the text, inside words too."""
    counted = [f"CAST(contains({normalized}, {_quoted(t)}) AS INT)" for t in terms]
    return F.expr(" + ".join(counted) or "0")


def signal_columns(
    hits: str, normalized: str, lists: dict[str, list[str]]
) -> dict[str, Column]:
    signals = {"has_mention": F.array_contains(hits, fv.MENTION_TOKEN)}
    for name in MATCHER_LISTS:
        signals[name] = contains(hits, normalized, lists.get(name, []))
    for name in TOKEN_LISTS:
        signals[name] = has_token(hits, lists.get(name, []))
    for name in LOOSE_LISTS:
        signals[name] = contains_any(hits, normalized, lists.get(name, []))
    return signals


def with_signals(df: DataFrame, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """Add the boolean signal columns ``sig_*`` to a normalised frame."""
    lists = fv.LEXICON if lists is None else lists
    out = df.withColumn("_hits", hit_tokens("tokens", lists))
    signals = signal_columns("_hits", "normalized_text", lists)
    signals["has_mention"] = F.array_contains("tokens", fv.MENTION_TOKEN)  # whatever the lists have
    return out.withColumns({f"sig_{n}": c for n, c in signals.items()}).drop("_hits")


def v1_signal_columns(normalized: str, lists: dict[str, list[str]]) -> dict[str, Column]:
    """The first policy version: plain substring tests, tokens for two lists only."""
    tokens = f"split({normalized}, ' ')"
    signals = {
        name: F.expr(_any_within(normalized, lists.get(name, [])))
        for name in MATCHER_LISTS + LOOSE_LISTS + ["community"]
    }
    signals["has_mention"] = F.contains(F.col(normalized), F.lit("@user"))
    signals["user"] = has_token(tokens, ["@user", *lists.get("user", [])])
    signals["movie"] = has_token(tokens, lists.get("movie", []))
    return signals


def matched_phrases(
    df: DataFrame, lists: dict[str, list[str]] | None = None, out: str = "matched"
) -> DataFrame:
    """Add the array of (list, phrase) that hit, for the matcher lists."""
    lists = fv.LEXICON if lists is None else lists
    entries = ", ".join(
        f"struct({_quoted(name)} AS list, {_quoted(p)} AS phrase, "
        f"{_quoted(p.split(' ', 1)[0])} AS first, {str(' ' in p).lower()} AS is_phrase)"
        for name in MATCHER_LISTS
        for p in lists.get(name, [])
    )
    pairs = F.expr(
        f"transform(filter(array({entries}), e -> array_contains(_hits, e.first) "
        "AND (NOT e.is_phrase OR contains(normalized_text, e.phrase))), "
        "e -> struct(e.list, e.phrase))"
    )
    none = F.slice(F.array(F.struct(F.lit("").alias("list"), F.lit("").alias("phrase"))), 1, 0)
    return (
        df.withColumn("_hits", hit_tokens("tokens", lists))
        .withColumn(out, F.when(F.size("_hits") > 0, pairs).otherwise(none))
        .drop("_hits")
    )


# --- Scan form ---------------------------------------------------------------

# How a list matches: a word as a token and a phrase behind its first word; words
# only; a phrase anywhere; or any term anywhere, inside words too.
_FIRST, _WORDS, _LOOSE, _ANYWHERE = range(4)
_RULES = {
    **dict.fromkeys(MATCHER_LISTS, _FIRST), **dict.fromkeys(TOKEN_LISTS, _WORDS),
    **dict.fromkeys(LOOSE_LISTS, _LOOSE), **dict.fromkeys(TONE_LISTS, _ANYWHERE),
}
_RULES_V1 = {**dict.fromkeys(MATCHER_LISTS + LOOSE_LISTS + TONE_LISTS + ["community"], _ANYWHERE), "user": _WORDS, "movie": _WORDS}
_BETWEEN = "\x00"
_AUTOMATA: dict = {}


class _Scanner:
    def __init__(self, entries: list[tuple[str, str]], rules: dict[str, int]):
        self.words: dict[str, list[str]] = {}
        self.always: list[str] = []
        inside: dict[str, list[tuple[str | None, str]]] = {}
        for name, phrase in entries:
            rule, label = rules.get(name, _FIRST), f"{name}{_BETWEEN}{phrase}"
            if rule != _ANYWHERE and " " not in phrase:
                self.words.setdefault(phrase, []).append(label)
            elif phrase == "":
                self.always.append(label)
            elif rule != _WORDS:
                inside.setdefault(phrase, []).append((phrase.split(" ", 1)[0] if rule == _FIRST else None, label))
        self.tree = ahocorasick.Automaton()
        for phrase, labels in inside.items():
            self.tree.add_word(phrase, labels)
        if inside:
            self.tree.make_automaton()
        self.any_inside = bool(inside)

    def scan(self, tokens, text) -> list[str] | None:
        if tokens is None or text is None:
            return None
        own = set(tokens)
        found = [label for t in own if t in self.words for label in self.words[t]] + self.always
        if self.any_inside:
            for labels in {id(x): x for _, x in self.tree.iter(text)}.values():
                found += [label for first, label in labels if first is None or first in own]
        return found


def lexicon_matches(lexicon: DataFrame, tokens: Column, normalized: Column, rules: dict[str, int]) -> Column:
    """The entries of a lexicon table that match, as "list NUL phrase", each as often as the table has it.

    A list that ``rules`` does not name matches as the matcher lists do.
    """
    spark = lexicon.sparkSession
    entries = lexicon.select("list", "phrase").dropna()
    parts = max(1, -(-entries.count() // PART_PHRASES))

    def part(number: int) -> Column:
        of_part = entries.where(F.pmod(F.xxhash64("list", "phrase"), F.lit(parts)) == number)
        held = spark.sparkContext.broadcast([tuple(r) for r in of_part.collect()])
        key = uuid.uuid4().hex  # of the automaton, which a Python worker keeps

        @F.arrow_udf("array<string>")
        def scan(tokens: pa.Array, text: pa.Array) -> pa.Array:
            if key not in _AUTOMATA:
                if len(_AUTOMATA) >= 4:
                    _AUTOMATA.clear()
                _AUTOMATA[key] = _Scanner(held.value, rules)
            scanner, found = _AUTOMATA[key], []
            # Tokens become Python's a few texts at a time: those of a batch take many times its bytes.
            for start in range(0, len(text), PIECE):
                some = (column.slice(start, PIECE).to_pylist() for column in (tokens, text))
                found.append(pa.array([scanner.scan(a, b) for a, b in zip(*some, strict=True)], pa.list_(pa.string())))
            return pa.chunked_array(found, pa.list_(pa.string())).combine_chunks()

        return scan(tokens, normalized)

    return F.concat(*[part(k) for k in range(parts)]) if parts > 1 else part(0)


def of_list(matches: Column, name: str) -> Column:
    return F.filter(matches, lambda m: F.startswith(m, F.lit(f"{name}{_BETWEEN}")))


def match_lexicon(df: DataFrame, lexicon: DataFrame, key: str = "comment_id") -> DataFrame:
    """(key, list, phrase) for every match of an entry, by the rule of the matcher lists.

    ``df`` is normalised.  It is read once and stays where it is.
    """
    matches = lexicon_matches(lexicon.select("list", "phrase").distinct(), F.col("tokens"), F.col("normalized_text"), dict.fromkeys(_RULES, _FIRST))
    found = df.select(key, F.explode(matches).alias("_m"))
    cut = F.split("_m", _BETWEEN)
    return found.select(key, F.get(cut, 0).alias("list"), F.get(cut, 1).alias("phrase"))


def scanned_signals(df: DataFrame, lexicon: DataFrame, v1: bool = False) -> DataFrame:
    """Add ``sig_*`` and ``_matches`` to a normalised frame, as ``with_signals`` and ``v1_signal_columns`` do."""
    tokens = F.split("normalized_text", " ") if v1 else F.col("tokens")
    df = df.withColumn("_matches", lexicon_matches(lexicon, tokens, F.col("normalized_text"), _RULES_V1 if v1 else _RULES))
    signals = {n: F.size(of_list(F.col("_matches"), n)) > 0 for n in SIGNAL_LISTS}
    if v1:
        signals["has_mention"] = F.contains(F.col("normalized_text"), F.lit("@user"))
        signals["user"] = signals["user"] | F.array_contains(tokens, "@user")
    else:
        signals["has_mention"] = F.array_contains(tokens, fv.MENTION_TOKEN)
    return df.withColumns({f"sig_{n}": c for n, c in signals.items()})
