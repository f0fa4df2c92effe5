"""Quality figures on awkward texts against plain counts; order and verdict of the cascade."""

import re
from collections import Counter

from pyspark.sql import functions as F

from commentguard.llm.quality_rules import METRICS, RULES, Rule, ordered_rules, quality_cascade, with_figures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "x " * 9, "\xa0   y",
    "l1\nl1\n \nl1 \n\nl1", "### *** $$$ &&& |||<>", "É È " * 30, "w " * 30_000, " ".join(f"u{k}" for k in range(20_000)) + " u1 u2 u3 u4 u5",
    "THE CAPS ARE LOUD " * 3 + " ".join(f"K{k}X" for k in range(30)), "x" * 40 + " " + " ".join("longwordlongword" + str(k) for k in range(20)),
]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_capitals": len(re.findall("[A-Z]", text)),
    }


def rejected(m):
    return (
        m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"]
        or m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 14 * m["n_words"]
        or (2 * m["n_dup_lines"] > m["n_lines"] and m["n_dup_lines"] >= 2) or 10 * m["n_capitals"] > 4 * m["word_chars"]
    )


def frame(spark):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")


def test_figures_equal_plain_counts(spark):
    together = with_figures(frame(spark), list(METRICS)).collect()
    alone = frame(spark).select("doc_id", *[m(F.col("text")).alias(n) for n, m in METRICS.items()]).collect()
    for rows in (together, alone):
        for r in rows:
            assert {n: r[n] for n in METRICS} == plain(TEXTS[r.doc_id]), TEXTS[r.doc_id] and TEXTS[r.doc_id][:40]


def test_verdicts_do_not_hang_on_the_order(spark):
    want = {k: not rejected(plain(t)) for k, t in enumerate(TEXTS)}
    for rules in (RULES, RULES[::-1]):
        got = quality_cascade(frame(spark), rules).collect()
        assert {r.doc_id: r.kept for r in got} == want
        assert all((r.failed is None) == r.kept and r.n_words == "clash" for r in got)


def test_more_rejections_for_the_cost_come_first(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    never, always = Rule("never", lambda m: F.lit(False)), Rule("always", lambda m: m("n_words") > 0)
    order = ordered_rules(docs, (never, always))
    assert [r.name for r, _, _ in order] == ["always", "never"] and [s for _, _, s in order] == [1.0, 0.0]
    assert quality_cascade(docs.limit(0)).count() == 0
