"""Lexicon matching as a join on tables: of the lexicon only a filter of a few bits a word passes the driver."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from commentguard.operators.ranks import salted_join
from commentguard.plans.shared import written

#: Phrases of one first word that lie in one row of the index.
CHUNK = 1_000
# Bits of the filter of first words at most (2 MB); a larger lexicon lets more tokens through to the join.
MAX_BITS = 1 << 24
# Texts whose tokens are looked up together.
PIECE = 2_048


def phrase_index(lexicon: DataFrame) -> DataFrame:
    """(first, entries): the distinct entries of each first word, in rows of about ``CHUNK``.

    An entry has its list, its phrase and what follows the first word and a
    blank; that is null for a single word.
    """
    entries = lexicon.select("list", "phrase").dropna().distinct().withColumn("first", F.substring_index("phrase", " ", 1))
    rest = F.when(F.contains("phrase", F.lit(" ")), F.expr("substring(phrase, length(first) + 2)"))
    sizes = entries.groupBy("first").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = entries.join(sizes, "first").withColumn("chunk", F.pmod(F.xxhash64("list", "phrase"), "chunks"))
    entry = F.struct("list", "phrase", rest.alias("rest"))
    return dealt.groupBy("first", "chunk").agg(F.collect_list(entry).alias("entries")).drop("chunk")


def first_word_bits(index: DataFrame) -> np.ndarray:
    """A Bloom filter with one hash of the index's first words: 16 to 32 bits a word, ``MAX_BITS`` at most."""
    firsts = index.select("first").distinct()
    bits = min(MAX_BITS, 64 << (firsts.count() // 4).bit_length())
    place = F.pmod(F.xxhash64("first"), F.lit(bits))
    word = F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))"))
    out = np.zeros(bits // 64, np.int64)
    for row in firsts.select(place.alias("place")).groupBy((F.col("place") / 64).cast("int").alias("at")).agg(word.alias("word")).collect():
        out[row["at"]] = row["word"]
    return out.view(np.uint64)


def occurrences(tokens: pa.Array, held: np.ndarray, words: int) -> tuple[np.ndarray, list[str], list[list[str]]]:
    """(row, word, what follows) for each distinct token of each row that may begin an entry.

    What follows are the next ``words`` tokens at most, after each occurrence
    but the row's last token.  A phrase may begin inside a token, so an
    occurrence is every token that ends in the word.
    """
    flat = tokens.flatten().dictionary_encode()
    known, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    lengths = tokens.value_lengths().fill_null(0).to_numpy()
    owner, ends = np.repeat(np.arange(len(tokens)), lengths), np.cumsum(lengths)
    place = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in known], np.uint64).view(np.int64) % (64 * len(held))
    may = held[place // 64] >> (place % 64).astype(np.uint64) & np.uint64(1) == 1
    hits = np.unique((owner * len(known) + codes)[may[codes]])

    # For each token the words that it ends in, as stretches of one list.
    wanted = {known[c]: c for c in np.flatnonzero(may).tolist()}
    sizes = sorted(set(map(len, wanted)))
    inside = [[wanted[w[len(w) - n :]] for n in sizes if n <= len(w) and w[len(w) - n :] in wanted] for w in known]
    many = np.array([len(x) for x in inside], np.int64)
    starts, listed = np.cumsum(many) - many, np.array([c for x in inside for c in x], np.int64)
    at = np.flatnonzero((many[codes] > 0) & (np.arange(len(codes)) < ends[owner] - 1)) if len(codes) else np.empty(0, np.int64)
    each = many[codes[at]]
    at, nth = np.repeat(at, each), np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    pair = owner[at] * len(known) + listed[starts[codes[at]] + nth]
    found = np.searchsorted(hits, pair)
    own = found < len(hits)
    own[own] = hits[found[own]] == pair[own]
    after: list[list[str]] = [[] for _ in hits]
    for k, p in zip(found[own].tolist(), at[own].tolist(), strict=True):
        after[k].append(" ".join([known[c] for c in codes[p + 1 : min(p + 1 + words, ends[owner[p]])].tolist()]))
    size = max(1, len(known))
    return hits // size, [known[c] for c in (hits % size).tolist()], after


def join_lexicon(df: DataFrame, lexicon: DataFrame, key: str = "comment_id") -> DataFrame:
    """(key, list, phrase) for every match of an entry by the rule of the matcher lists, once for each row of ``df``.

    ``df`` has ``key``, tokens and normalized_text, which is the tokens joined by
    blanks.  Its rows are read once and stay where they are: a token that may be
    a first word of the lexicon, by a filter of a few bits a word, goes on with
    what follows each of its occurrences, and these meet the phrases.  The join
    is salted: a word in every text, or one that begins a million phrases,
    spreads over tasks.  Equal keys may stand on several rows.
    """
    index = written(phrase_index(lexicon), "phrase-index")
    longest = index.select(F.explode("entries").alias("e")).agg(F.max(F.size(F.split("e.phrase", " ")))).first()[0] or 1
    held = first_word_bits(index)
    # No filter on these columns: it would be moved below the normalisation and normalise each text twice.
    rows = df.select(F.col(key).alias("key"), F.when(F.col("normalized_text").isNotNull(), F.col("tokens")).alias("tokens"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                owner, firsts, after = occurrences(piece.column("tokens"), held, longest - 1)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key").take(pa.array(owner)), pa.array(firsts, pa.string()), pa.array(after, pa.list_(pa.string()))],
                    ["key", "first", "after"],
                )

    kind = df.schema[key].dataType.simpleString()
    after = rows.mapInArrow(follow, f"key {kind}, first string, after array<string>")
    met = salted_join(after, index, "first", ["key"]).select("key", "after", F.explode("entries").alias("e"))
    hit = F.col("e.rest").isNull() | F.exists("after", lambda a: F.startswith(a, F.col("e.rest")))
    return met.where(hit).select(F.col("key").alias(key), "e.list", "e.phrase")
