"""Rows that every operator must take, and helpers."""

from __future__ import annotations

import random

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi", "su", "ta") for b in ("ra", "ne", "do", "ti") for c in ("", "n", "s", "lm")]


def prose(n: int, seed: int = 0, per_line: int = 12) -> str:
    r = random.Random(seed)
    words = [r.choice(_WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


def awkward() -> list[tuple]:
    """Nulls in every column, empty and blank texts, one word, one very long text, ties, repeated rows, odd characters."""
    long = prose(60_000, 9)
    return [
        (1, prose(80, 1), "en", "web", 1),
        (2, prose(80, 1), "en", "web", 1),
        (3, prose(80, 1).replace(" ", "  "), "en", "books", 1),
        (4, "", "en", "web", 0),
        (5, None, "en", "web", None),
        (6, " \t\n\r\x0b\x0c ", None, "web", 7),
        (7, "one", "en", None, 3),
        (8, long, "en", "web", len(long)),
        (8, long, "en", "web", len(long)),
        (None, prose(70, 2), "en", "web", 1),
        (None, None, None, None, None),
        (9, "tie tie tie", "en", "", 11),
        (10, "tie tie tie", "en", "", 11),
        (10, "tie tie tie", "en", "", 11),
        (11, "a b   café \U0001f600 \u0000 x", "fr", "we\u0000b", 9),
        (12, "A B C", "en", "web", 5),
        (13, "a b c", "en", "web", 5),
        (-14, prose(30, 3), "en", "\U0001f600", 1),
    ]


def docs(spark, rows=None, parts: int = 3):
    return spark.createDataFrame(awkward() if rows is None else rows, KIND).repartition(parts)


def of(spark, texts: dict, source: str = "web", parts: int = 3):
    """Documents by id and text."""
    return docs(spark, [(i, t, "en", source, len(t or "")) for i, t in texts.items()], parts)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality bigint, toxic bigint")


def clashing(df):
    """The same rows with further columns whose names differ in case alone, or are those that operators give."""
    from pyspark.sql import functions as F

    extra = {n: F.lit(x) for n, x in (("TEXT", "no"), ("Doc_Id", 5), ("size", 1), ("n", 2), ("k_", "x"), ("rank", 0.5), ("kept", None), ("fp", 7), ("copies", 3), ("copy", 1), ("digest", "z"), ("piece", 2), ("score", 9.0), ("a b.c", 1))}
    plain = df.select(*(F.col(c) for c in df.columns), *(c.alias(f"x{i}") for i, c in enumerate(extra.values())))
    return plain.toDF(*df.columns, *extra)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_with_clashes(df, run) -> None:
    """Other columns change nothing."""
    assert rows(run(clashing(df))) == rows(run(df))
