"""Text scalars as Spark columns; all of them run in the JVM.

White space and word characters are spelled out as classes (see
``fixed_values``), never as ``\\s``, ``\\w`` or ``\\b``: Java gives those an
ASCII or a Unicode meaning by flag and by release.  Quantifiers over runs are
possessive where the following token cannot match inside the run, which keeps
every pattern linear and free of recursion on long texts.
"""

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from commentguard import fixed_values as fv

_W = fv.WORD
_S = fv.SPLIT_SEPARATORS
_NON_ALNUM = r"[^\p{L}\p{N}]*+"
_TOKEN = r"[a-z0-9\-]+"
_MENTION = rf"@(?<![a-z0-9]@)[{_W}]+"
# One or more single characters, each set off by separators, that together end
# at a word boundary.  An underscore separates but is a word character, so a
# letter before an underscore may be passed through but may not end the match.
_HOP = rf"(?:[{_S}]++[a-z0-9](?=_))*+[{_S}]++[a-z0-9](?![{_W}])"
_SPELLED_OUT = rf"(?<![{_W}])[a-z0-9](?:{_HOP})++"
_SPELLED_OUT_ASCII = rf"\b[a-z0-9][{_S}]++[a-z0-9](?:_|\b)"
_SHIT = rf"sh(?<![{_W}]sh){_NON_ALNUM}t(?![{_W}])"
_FUCK = rf"f(?<![{_W}]f){_NON_ALNUM}u{_NON_ALNUM}c{_NON_ALNUM}k(?![{_W}])"


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ascii(c: Column | str) -> Column:
    c = _text(c)
    return F.octet_length(c) == F.length(c)


# --- Normalisation steps -----------------------------------------------------


def nfkc(c: Column | str) -> Column:
    """Unicode compatibility composition by the ICU library Spark ships with.

    ASCII text is its own normal form and skips the call.
    """
    c = _text(c)
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)
    )
    return F.when(~is_ascii(c), composed).otherwise(c)


def strip_zero_width(c: Column | str) -> Column:
    return F.translate(_text(c), fv.ZERO_WIDTH, "")


def map_confusables(c: Column | str) -> Column:
    """Lower-case Cyrillic and Greek look-alikes to ASCII letters."""
    return F.translate(_text(c), fv.CONFUSABLES_FROM, fv.CONFUSABLES_TO)


def clean_characters(c: Column | str) -> Column:
    """``strip_zero_width`` and ``map_confusables`` in one pass."""
    return F.translate(
        _text(c), fv.CONFUSABLES_FROM + fv.ZERO_WIDTH, fv.CONFUSABLES_TO
    )


def has_devanagari(c: Column | str) -> Column:
    return F.rlike(_text(c), F.lit(fv.DEVANAGARI))


def transliterate(c: Column | str, transliterator=None) -> Column:
    """Devanagari runs to one space, or to what a given column function makes, such as ``iast``."""
    c = _text(c)
    if transliterator is None:
        return F.regexp_replace(c, fv.DEVANAGARI + "+", " ")
    return F.when(has_devanagari(c), transliterator(c)).otherwise(c)


def _letters(table: str) -> dict[str, str]:
    parts = table.split(" ")
    return dict(zip(parts[::2], parts[1::2], strict=True))


def iast(c: Column | str) -> Column:
    """Devanagari to Latin letters by the IAST scheme; all other text stays.

    A transducer over consonant, vowel sign and virama: a consonant that
    neither sign nor virama follows takes its inherent ``a``; virama and nukta
    go.  Marks without a letter of their own (accents) stay.  One test of the
    following character and per-character maps: linear in the text, in the JVM.
    """
    consonants, signs = _letters(fv.IAST_CONSONANTS), _letters(fv.IAST_SIGNS)
    c = F.regexp_replace(
        _text(c), f"([{''.join(consonants)}]{fv.NUKTA}?+)(?![{''.join(signs)}{fv.VIRAMA}])", "$1a"
    )
    for pair, letters in _letters(fv.IAST_NUKTA_PAIRS).items():
        c = F.replace(c, F.lit(pair), F.lit(letters))
    one = consonants | signs | _letters(fv.IAST_VOWELS) | _letters(fv.IAST_OTHERS)
    # Letters of which two or more come: all but the first are put behind the
    # character, which is then mapped to the first like any other.
    tails: dict[str, str] = {}
    for letter, letters in one.items():
        if len(letters) > 1:
            tails[letters[1:]] = tails.get(letters[1:], "") + letter
    for tail, those in tails.items():
        c = F.regexp_replace(c, f"([{those}])", f"$1{tail}")
    return F.translate(c, "".join(one) + fv.VIRAMA + fv.NUKTA, "".join(v[0] for v in one.values()))


def mask_mentions(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), _MENTION, f" {fv.MENTION_TOKEN} ")


def squeeze_repeats(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"([^\n])\1{2,}", "$1$1")


def deleet(c: Column | str) -> Column:
    return F.translate(_text(c), fv.LEET_FROM, fv.LEET_TO)


def has_split_words(c: Column | str) -> Column:
    """Can ``join_split_words`` change this text?  (May say yes in vain.)"""
    c = _text(c)
    return F.when(is_ascii(c), F.rlike(c, F.lit(_SPELLED_OUT_ASCII))).otherwise(
        F.rlike(c, F.lit(_SPELLED_OUT))
    )


def join_split_words(c: Column | str) -> Column:
    """``b h a d`` to ``bhad``: inside a spelled-out word only [a-z0-9-] stay."""
    c = _text(c)
    words = F.transform(
        F.regexp_extract_all(c, F.lit(_SPELLED_OUT), F.lit(0)),
        lambda word: F.array_join(
            F.regexp_extract_all(word, F.lit(_TOKEN), F.lit(0)), ""
        ),
    )
    between = F.split(c, _SPELLED_OUT, -1)
    return F.array_join(
        F.zip_with(between, words, lambda gap, word: F.concat(gap, F.coalesce(word, F.lit("")))),
        "",
    )


def undisguise_shit(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), _SHIT, "shit")


def undisguise_fuck(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), _FUCK, "fuck")


def token_list(c: Column | str) -> Column:
    """Maximal runs of [a-z0-9-], in order, with repeats."""
    return F.regexp_extract_all(_text(c), F.lit(_TOKEN), F.lit(0))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(token_list(c))


def strip_symbols(c: Column | str) -> Column:
    """Everything outside [a-z0-9-] to single spaces, trimmed.

    Joining the tokens is the same as replacing what lies between them, and
    far faster in Java than matching the negated class.
    """
    return F.array_join(token_list(c), " ")


def normalize_text(c: Column | str, transliterator=None) -> Column:
    """The whole chain as one expression.

    ``operators.normalize.with_normalized`` gives the same text faster, as it
    skips steps a row does not need.
    """
    c = mask_mentions(F.lower(transliterate(clean_characters(nfkc(c)), transliterator)))
    c = deleet(squeeze_repeats(c))
    joined = F.get(F.transform(F.array(c), join_split_words), F.lit(0))
    return strip_symbols(undisguise_fuck(undisguise_shit(joined)))


def normalize_text_v1(c: Column | str) -> Column:
    """The shorter chain of the first policy version; keeps ``@user`` marks."""
    c = F.regexp_replace(F.lower(_text(c)), rf"@[{_W}]+", "@user")
    c = squeeze_repeats(c)
    return F.array_join(F.regexp_extract_all(c, F.lit(r"[a-z0-9@\-]+"), F.lit(0)), " ")


# --- Language ----------------------------------------------------------------


def detect_script(raw: Column | str) -> Column:
    return F.when(has_devanagari(raw), F.lit("hi_devanagari")).otherwise(F.lit("unknown"))


def lower_tokens(c: Column | str) -> Column:
    return token_list(F.lower(_text(c)))


def language_mix(c: Column | str) -> Column:
    c = _text(c)
    hinglish = F.exists(lower_tokens(c), lambda t: t.isin(fv.HINGLISH_TOKENS))
    return (
        F.when(has_devanagari(c), F.lit("hindi_devanagari"))
        .when(hinglish, F.lit("hinglish_latin"))
        .otherwise(F.lit("english"))
    )


# --- Redaction, previews, keys -----------------------------------------------


def collapse_space(c: Column | str) -> Column:
    """Runs of white space to one blank, none at the ends.

    Single blanks, nearly all of it, are left alone, so there is little to
    replace.
    """
    blanks = F.regexp_replace(_text(c), f"[{fv.SPACE}&&[^ ]]", " ")
    return F.trim(F.regexp_replace(blanks, " {2,}", " "))


def redact_text(c: Column | str) -> Column:
    """Links, addresses and handles masked, white space collapsed, 280 characters."""
    c = F.regexp_replace(_text(c), rf"https?://[^{fv.SPACE}]+", "[link]")
    c = F.regexp_replace(
        c,
        rf"(?<![{_W}])\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}{{1,3}}){{3}}(?![{_W}])",
        "[ip]",
    )
    c = F.regexp_replace(c, rf"@[{_W}]+", "@user")
    return F.substring(collapse_space(c), 1, fv.TEXT_CAP)


@F.pandas_udf(T.StringType())
def _unescape_html(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(html.unescape, na_action="ignore")


def plain_text(c: Column | str) -> Column:
    """HTML entities resolved, white space collapsed.

    The full entity table needs Python; only texts with an ampersand go there,
    the others send a NULL.
    """
    c = F.coalesce(_text(c), F.lit(""))
    escaped = F.when(F.contains(c, F.lit("&")), c)
    return collapse_space(F.coalesce(_unescape_html(escaped), c))


def text_hash(c: Column | str) -> Column:
    return F.sha2(_text(c), 256)


def cache_key(text: Column | str, context_type: Column | str) -> Column:
    return F.sha2(F.concat(_text(text), F.lit(":"), _text(context_type)), 256)


def has_email(c: Column | str) -> Column:
    return F.rlike(_text(c), F.lit(rf"[{_W}.\-]@[{_W}.\-]+\.[{_W}]"))


def has_phone(c: Column | str) -> Column:
    return F.rlike(_text(c), F.lit(rf"(?<![{_W}])\p{{Nd}}{{10,}}+(?![{_W}])"))


def find_pii(c: Column | str) -> Column:
    return F.struct(has_email(c).alias("email"), has_phone(c).alias("phone"))


def preview(c: Column | str, n: int = fv.PREVIEW_CHARS) -> Column:
    c = _text(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


# --- JSON label lists --------------------------------------------------------


def encode_labels(labels: Column | str) -> Column:
    return F.to_json(_text(labels))


def parse_labels(c: Column | str) -> Column:
    return F.from_json(_text(c), T.ArrayType(T.StringType()))


def is_json(c: Column | str) -> Column:
    return F.try_parse_json(_text(c)).isNotNull()


def is_json_list(c: Column | str) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(_text(c)))
    return F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False))
