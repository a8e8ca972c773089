"""Tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns, no rows."""

from __future__ import annotations

import random

WORDS = "the of and to in that river stone house light over under morning evening silver garden winter summer paper window bridge".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + (f"{rnd.randrange(50)}" if rnd.random() < 0.5 else "") for _ in range(n))


LONG = prose(99, 30_000)
TEXTS = [
    (1, prose(1, 60)), (2, prose(1, 60).upper()), (3, prose(1, 60)), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "ONE  two"), (9, "one"), (10, LONG), (11, LONG + " end"), (12, prose(2, 80)),
    (12, prose(2, 80)), (13, prose(2, 80) + " tail of it"), (None, prose(3, 50)), (None, prose(1, 60)), (14, "é" * 50 + " \x0b日本語 \U0001f600"), (15, "a " * 400), (16, "x" * 5000), (17, "!!! ### $$$ %%%"),
]
SCHEMA = "doc_id long, text string"


def table(spark, rows=None):
    """With further columns, named like those that the operators use."""
    rows = TEXTS if rows is None else rows
    more = "lang string, source string, n_chars long, id long, digest string, n long, rank int, dropped_id string, lang_pred string, score string"
    full = [(i, t, "en" if k % 2 else None, "s", len(t or ""), 0, "d", 1, 2, "g", "zz", "0") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"{SCHEMA}, {more}")


def empty(spark):
    return table(spark, [])


def lowered(text: str | None) -> str:
    return (text or "").encode().lower().decode()
