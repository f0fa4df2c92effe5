"""The normalisation chain as a stack of narrow projections."""

from pyspark.sql import Column, DataFrame, functions as F

from commentguard.functions import text as tx


def with_normalized(
    df: DataFrame, text: str = "text", normalized: str = "normalized_text", tokens: str = "tokens",
    transliterator=None,
) -> DataFrame:
    """Add the normalised text and its token list.

    Every step is a projection of its own, so a test that lets rows skip the
    step reads a finished value and nothing is computed twice.  No shuffle.
    ``transliterator`` is a column function for Devanagari (``tx.iast``); without
    one its runs become blanks.
    """
    work = "_norm"

    def step(frame: DataFrame, make) -> DataFrame:
        return frame.withColumn(work, make(F.col(work)))

    def only_if(test, change):
        return lambda c: F.when(test(c), change(c)).otherwise(c)

    def contains(part: str):
        return lambda c: F.contains(c, F.lit(part))

    def beyond_ascii(c: Column) -> Column:
        return ~tx.is_ascii(c)

    out = df.withColumn(work, tx.nfkc(text))
    out = step(out, only_if(beyond_ascii, tx.clean_characters))
    out = step(out, only_if(beyond_ascii, lambda c: tx.transliterate(c, transliterator)))
    out = step(out, F.lower)
    out = step(out, only_if(contains("@"), tx.mask_mentions))
    out = step(out, tx.squeeze_repeats)
    out = step(out, only_if(lambda c: F.rlike(c, F.lit(r"[@$013457!|]")), tx.deleet))
    out = step(out, only_if(tx.has_split_words, tx.join_split_words))
    out = step(out, only_if(contains("sh"), tx.undisguise_shit))
    out = step(out, tx.undisguise_fuck)
    out = out.withColumn(tokens, tx.token_list(work))
    return out.withColumn(normalized, F.array_join(tokens, " ")).drop(work)
