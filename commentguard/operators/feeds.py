"""Comment feeds: nested threads to rows, and what is worth moderating."""

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from commentguard import fixed_values as fv
from commentguard.functions import text as tx


_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"true|false|null|NaN|-?Infinity|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.A)


def parsed(text: str):
    """What ``json.loads`` gives, at any depth: open lists and objects are on a stack of its own."""
    whole: list = []
    stack, names, at = [whole], [None], 0

    def char() -> str:
        nonlocal at
        at = _BLANK.match(text, at).end()
        return text[at : at + 1]

    def name() -> str:
        nonlocal at
        if char() != '"':
            raise ValueError(f"no name at {at}")
        found, at = scanstring(text, at + 1, True)
        if char() != ":":
            raise ValueError(f"no colon at {at}")
        at += 1
        return found

    while True:
        c, opened = char(), None
        if c in ("{", "["):
            value = opened = {} if c == "{" else []
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _SCALAR.match(text, at):
            value, at = json.loads(m[0]), m.end()
        else:
            raise ValueError(f"no value at {at}")
        if isinstance(stack[-1], dict):
            stack[-1][names[-1]] = value
        else:
            stack[-1].append(value)
        if opened is not None:
            stack.append(opened)
            names.append(None)
            if char() != ("}" if c == "{" else "]"):
                names[-1] = name() if c == "{" else None
                continue
        # A value is complete: close what ends here, up to a comma.
        while len(stack) > 1:
            own, c = stack[-1], char()
            at += 1
            if c == ",":
                names[-1] = name() if isinstance(own, dict) else None
                break
            if c != ("}" if isinstance(own, dict) else "]"):
                raise ValueError(f"no end at {at}")
            stack.pop()
            names.pop()
        else:
            if char():
                raise ValueError(f"more text at {at}")
            return whole[0]


def _comments_of(root) -> list[tuple[str, int, int]]:
    """(body, score, depth) of the comments under a node, parents first."""
    found, waiting = [], [(root, 0)]
    while waiting:
        node, depth = waiting.pop()
        if not isinstance(node, dict):
            continue
        data = node.get("data") or {}
        if node.get("kind") == "t1":
            found.append((data.get("body") or "", int(data.get("score") or 0), depth))
        replies = data.get("replies")
        below = replies.get("data", {}).get("children", []) if isinstance(replies, dict) else []
        below = [*data.get("children", []), *below] if isinstance(data.get("children"), list) else below
        waiting.extend((child, depth + 1) for child in reversed(below))
    return found


def flatten_threads(df: DataFrame, json_column: str = "thread", key: str = "thread_id", any_depth: bool = False) -> DataFrame:
    """(key, position, depth, body, score) of every comment in nested threads.

    A thread is one JSON document, so the walk needs a stack; a small
    Arrow-batched helper does it next to the data.  Comment nodes and listing
    roots are both accepted; documents that do not parse give no rows.  One that
    is nested too deeply for ``json.loads`` gives a single row of nulls beside
    its key, so that it is not lost unseen, or with ``any_depth`` all its comments.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for thread_id, text in zip(batch[key], batch[json_column]):
                try:
                    root = json.loads(text)
                except (TypeError, ValueError):
                    continue
                except RecursionError:
                    if not any_depth:
                        rows.append((thread_id, None, None, None, None))
                        continue
                    try:
                        root = parsed(text)
                    except ValueError:
                        continue
                roots = root if isinstance(root, list) else [root]
                comments = [c for r in roots for c in _comments_of(r)]
                rows += [(thread_id, i, c[2], c[0], c[1]) for i, c in enumerate(comments)]
            out = pd.DataFrame(rows, columns=[key, "position", "depth", "body", "score"])
            yield out.astype({n: "Int64" for n in ("position", "depth", "score")})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, json_column).mapInPandas(
        walk, f"{key} {kind}, position long, depth long, body string, score long"
    )


def clean_feed(
    df: DataFrame, body: str = "body", order: str = "position", cap: int | None = None,
) -> DataFrame:
    """Readable comments, each text once (its first occurrence), cut to 1,000
    characters; ``cap`` keeps the first that many.

    The first of equal texts is a combining aggregate, so a text copied a
    million times costs one row per map task.
    """
    texts = df.withColumn("text", tx.plain_text(body)).filter(
        ~F.col("text").isin("", "[deleted]", "[removed]") & (F.length("text") >= 8)
    )
    rows = F.struct(*texts.columns)
    first = texts.groupBy(F.sha2("text", 256).alias("_h")).agg(F.min_by(rows, order).alias("_row"))
    out = first.select("_row.*").withColumn("text", F.substring("text", 1, fv.FEED_TEXT_CAP))
    return out.orderBy(order).limit(cap) if cap is not None else out


def upsert_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules with changes by id: given fields replace, unknown ids are added."""
    fields = [c for c in rules.columns if c != "id"]
    old, new = rules.alias("old"), changes.alias("new")
    return old.join(new, "id", "full_outer").select(
        "id", *[
            F.coalesce(F.col(f"new.{f}"), F.col(f"old.{f}")).alias(f) if f in changes.columns
            else F.col(f"old.{f}")
            for f in fields
        ],
    )
