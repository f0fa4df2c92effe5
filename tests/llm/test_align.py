"""Token alignment against a plain comparison of byte ranges, and corpus counts against a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from commentguard.llm import align
from commentguard.llm.align import Aligner, align_tokens, common_ends, link_support
from commentguard.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES
from commentguard.llm.tokens import byte_bpe, byte_letters

TEXTS = [
    "The quick brown fox", "naïve café 漢字 😀 x", "<|endoftext|> </s> <unk> <0x41>", "  two  blanks\n\nand\tlines ", "a", " ", "\n", "▁mark", "",
    None, "The quick brown fox", "don't 'S 12345 ___ ́combining \x00 nul", "word " * 3000, "x" * 20_000, "1" * 5_000, " " * 150_000 + "end",
    "Straße Übergröße l'été où ſ ﬁ Ⅷ ²",
]


def plain(texts):
    a_model, b_model = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a_model.encode_special_tokens = True
    letters, out = byte_letters(), []
    names = {i: t for t, i in a_model.get_vocab().items()}
    for text in texts:
        a_ids = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b_model.encode(text) if text else []
        a = [bytes(letters[c] for c in names[i]) for i in a_ids]
        b = []
        for i in b_ids:
            piece = b_model.id_to_piece(i)
            b.append(bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode())
        if not text or b"".join(a) != (" " + text).encode() or b"".join(b) != (" " + text).encode():
            a_ids, b_ids, a, b = [], [], [], []
        ends = [list(np.cumsum([len(x) for x in side])) if side else [] for side in (a, b)]
        groups, k, j = [], 0, 0
        after = [{end: n + 1 for n, end in enumerate(side)} for side in ends]
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = after[0][end], after[1][end]
            groups.append((a_ids[k:p], b_ids[j:q]))
            k, j = p, q
        out.append((a_ids, b_ids, groups, ends))
    return out


def expected(texts):
    found = plain(texts)
    counts = Counter((g[0][-1], g[1][-1]) for _, _, groups, _ in found for g in groups)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for k, (a, b, groups, _) in enumerate(found):
        own = [(counts[g[0][-1], g[1][-1]], most[g[1][-1]]) for g in groups]
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if a else ""
        rows.append((k, len(a), len(b), len(groups), len(own), sum(n == m for n, m in own), sum(n for n, _ in own), digest))
    return rows


@pytest.mark.parametrize("links", [1, 40, 10**6])
def test_equals_plain_alignment(spark, tmp_path, monkeypatch, links):
    monkeypatch.setattr(align, "BLOCK_LINKS", links)
    monkeypatch.setattr(align, "BLOCKS_PER_SALT", 3)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, a_ids string, block int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_tokenizer_alignment"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == expected(TEXTS)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = [(docs[r[0]].doc_id, *r[1:]) for r in expected([d.text for d in docs])]
    assert sorted(map(tuple, QUERIES["op12_tokenizer_alignment"](spark, sf).collect())) == want


def test_more_than_65536_pairs_in_a_block(spark):
    pairs = np.arange(70_000)
    rows = [(1, 7, pairs.astype(np.uint32).tobytes(), [int(p) << 32 | 5 for p in pairs], [1] * 69_999 + [2]), (2, 7, np.uint32(69_999).tobytes(), None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, block long, links binary, pairs array<long>, pair_counts array<long>")
    got = link_support(frame, {"doc_id": F.col("doc_id")}).orderBy("doc_id").collect()
    assert [(r.n_links, r.n_best, r.count_sum) for r in got] == [(70_000, 1, 70_001), (1, 1, 2)]


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, "one two")], "doc_id long, text string")
    aligned = align_tokens(docs, BYTE_BPE, PIECE_BPE)
    rows = link_support(aligned, {"doc_id": F.col("doc_id"), "groups": F.col("groups")}).collect()
    assert len(rows) == 3 and len({r.groups for r in rows}) == 1 and all(set(r.link_counts) == {3} and all(r.link_best) for r in rows)


def test_common_ends_and_overlaps():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.choice([1, 5, 60, 2000])
        a, b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randrange(n)), n})) for _ in range(2))
        in_a, in_b, b_from, b_to = common_ends(a, b)
        assert a[in_a].tolist() == b[in_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        if n <= 60:
            for k in range(len(a)):
                start = a[k - 1] if k else 0
                touching = [j for j in range(len(b)) if (b[j - 1] if j else 0) < a[k] and b[j] > start]
                assert list(range(b_from[k], b_to[k])) == touching


def test_fast_ids_equal_those_of_the_tokenizer_file():
    own, plain_model = byte_bpe(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(1)
    parts = ["a", "Ab", " ", "  ", "\n", "\r\n", "\t", "é", "漢", "1", "'s", "'S", " 't", "_", "<|endoftext|>", "\xa0", "​", "😀", "́", "ſ", "\x00", "Ⅷ", "²", "\u0085"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randrange(30)))
        assert own.encode(text, special=True) == plain_model.encode(text, add_special_tokens=False).ids
    blank = " " * 1_000_000
    assert own.encode(blank) == plain_model.encode(blank, add_special_tokens=False).ids
    for text in ("a" * 300_000, "^" * 300_000, "12" * 150_000):
        assert own.encode(text) == plain_model.encode(text, add_special_tokens=False).ids


def test_aligner_writes_groups():
    own = Aligner(BYTE_BPE, PIECE_BPE)
    line = own.line(np.array([1, 2, 3]), np.array([4, 5, 6]), np.array([2, 3]), np.array([1, 3]))
    assert line == "1,2|4;3|5,6"
