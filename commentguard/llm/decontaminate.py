"""Benchmark decontamination: one Aho-Corasick automaton over the words of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A-Z become a-z, what is not of a word becomes a blank; bytes keep their places.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
#: Most bytes of item text in one automaton; a larger benchmark takes one pass for each such part.
PART_BYTES = 1_000_000
RUN = "struct<word_start:int,word_end:int,start:int,end:int>"
HITS = f"doc_id long, text_key long, n_words long, items array<string>, runs array<{RUN}>"


class Automaton:
    """All windows of the items as sequences of word numbers.

    Texts are scanned as numbers of known words, 0 for any other, so an
    occurrence always is one of whole words.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple, set[str]] = {}
        for name, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normal_bytes(text).split()]
            for k in range(max(1, len(words) - window + 1) if words else 0):
                windows.setdefault(tuple(words[k : k + window]), set()).add(name)
        self.empty = not windows
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, names in windows.items():
            self.tree.add_word(words, (len(words), names))
        if windows:
            self.tree.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged runs [start, end) of hit words, and the items they belong to."""
        runs: list[list[int]] = []
        found: set[str] = set()
        if self.empty or not words:
            return runs, found
        known = self.numbers.get
        for end, (length, names) in self.tree.iter(tuple([known(w, 0) for w in words])):
            found |= names
            start, end = end - length + 1, end + 1
            while runs and runs[-1][0] >= start:
                runs.pop()
            if runs and runs[-1][1] >= start:
                runs[-1][1] = end
            else:
                runs.append([start, end])
        return runs, found


def normal_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL)


def placed(text: str, normal: bytes, runs: list[list[int]]) -> list[dict]:
    """The runs of words with their code points in the original text."""
    out, places = [], [m.span() for m in _WORD.finditer(normal)]
    raw, at, seen = text.encode("utf-8", "surrogatepass"), 0, 0
    for first, last in runs:
        ends = []
        for byte in (places[first][0], places[last - 1][1]):
            seen += sum(b & 0xC0 != 0x80 for b in raw[at:byte])
            at = byte
            ends.append(seen)
        out.append({"word_start": first, "word_end": last, "start": ends[0], "end": ends[1]})
    return out


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """What each document shares with the test items of ``benchmark`` (item_id, text).

    Words are runs of digits, letters and non-ASCII characters, A-Z
    lower-cased.  Every ``window`` consecutive words of an item are looked for,
    the whole item where it is shorter.  Returns for each row of ``docs``:
    doc_id, text_key (xxhash64 of the text), n_words, items (ids with an
    occurrence, sorted) and runs (merged
    runs of hit words: words and code points of the original, end exclusive).

    Null and empty texts have no words, on either side; an item without words
    never occurs; items that share an id are one; a null item_id counts as the
    empty string.  An empty benchmark hits nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    passes = [_hits(rows, items.where(part == k), window, every=k == 0) for k in range(parts)]
    if parts == 1:
        return passes[0]
    hits = passes[0].where("size(items) > 0")
    for other in passes[1:]:
        hits = hits.union(other)
    key = ["doc_id", "text_key"]
    merged = hits.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
    )
    merged = merged.mapInArrow(_merge, f"doc_id long, text_key long, items array<string>, runs array<{RUN}>")
    named = merged.select(*[F.col(c).alias(f"_{c}") for c in merged.columns])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    return passes[0].join(named, same, "left").select(
        *key, "n_words", F.coalesce("_items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("_runs", F.expr(f"cast(array() as array<{RUN}>)")).alias("runs"),
    )


def _hits(rows: DataFrame, items: DataFrame, window: int, every: bool) -> DataFrame:
    """One pass with one automaton: each row's hits, or only rows that have any."""
    held = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in items.distinct().collect()])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())),
        ("runs", pa.list_(pa.struct([(f, pa.int32()) for f in ("word_start", "word_end", "start", "end")]))),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(held.value, window)
        for batch in batches:
            out = []
            for name, key, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                normal = normal_bytes(text)
                words = normal.split()
                runs, found = automaton.scan(words)
                if every or runs:
                    out.append((name.as_py(), key.as_py(), len(words), sorted(found), placed(text, normal, runs) if runs else []))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(scan, HITS)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for runs in batch.column(3).to_pylist():
            merged: list[dict] = []
            for run in runs:
                if merged and run["word_start"] <= merged[-1]["word_end"]:
                    if run["word_end"] > merged[-1]["word_end"]:
                        merged[-1] |= {"word_end": run["word_end"], "end": run["end"]}
                else:
                    merged.append(dict(run))
            out.append(merged)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, batch.column(3).type)], schema=batch.schema)
