"""Trie scores against a plain segmentation of each pre-token."""

import math

import pytest

from commentguard.llm.queries import VOCABULARY
from commentguard.llm.token_counts import TokenTrie, UNKNOWN, count_tokens, pre_tokens, unigram_scores


def brute(word, scores):
    """Tokens of the best segmentation, from a table over all cuts."""
    byte = min(scores.values()) - UNKNOWN
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        options = [
            (best[s][0] + scores[word[s:end]], -best[s][1] - 1) for s in range(end) if word[s:end] in scores
        ]
        if word[end - 1] not in scores:
            size = len(word[end - 1].encode())
            options.append((best[end - 1][0] + size * byte, -best[end - 1][1] - size))
        score, count = max(options)
        best[end] = (score, -count)
    return best[-1][1]


@pytest.fixture(scope="module")
def scores():
    return unigram_scores(VOCABULARY)


TEXTS = [None, "", " ", "\n", "Hello world", "naïve  Straße\tüber 日本語 😀", "a" * 700, "x" + "▁" * 5 + "y z" * 150, "The the THE thE " * 40]


def test_equals_plain_segmentation(spark, scores):
    sf = "/root/testdata/sf0.001/documents.parquet"
    texts = [*TEXTS, *[r.text for r in spark.read.parquet(sf).select("text").collect()]]
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    plain = {}
    for nodes in (200_000, 50):
        for row in count_tokens(docs, scores, max_nodes=nodes).collect():
            parts = pre_tokens(texts[row.doc_id])
            for p in set(parts) - set(plain):
                plain[p] = brute(p.replace(" ", "▁"), scores)
            assert (row.n_pretokens, row.n_tokens) == (len(parts), sum(plain[p] for p in parts))


def test_round_trip_of_pre_tokens():
    for text in TEXTS:
        assert "".join(pre_tokens(text)) == (" " + text if text else "")


def test_prefixes_are_scored_once(scores):
    trie = TokenTrie(scores)
    for token in ("abcde", "abcdf", "abcde"):
        trie[token]
    assert trie.nodes == 6


def test_empty_table(spark, scores):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(docs, scores).collect() == []
