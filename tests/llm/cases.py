"""Small tables with the awkward rows every operator must take."""

import random

WORDS = "the of and ing tion her that ent ion for hat tha nth int his ver all wit thi".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.5 else ""))
        if r.random() < 0.06:
            out[-1] += ".\n" if r.random() < 0.5 else "."
    return " ".join(out).replace("\n ", "\n")


def edited(text: str, seed: int, every: int) -> str:
    r = random.Random(seed)
    w = text.split(" ")
    for i in range(r.randrange(every), len(w), every):
        w[i] = "edit" + str(r.randrange(10**6))
    return " ".join(w)


def awkward() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with copies, near copies, nulls,
    empty and very long texts, ties and repeated rows."""
    base = prose(1, 300)
    rows = [
        (1, base),
        (2, base),  # exact copy
        (3, base.upper()),  # equal words
        (4, edited(base, 4, 60)),
        (5, edited(base, 5, 60)),
        (6, edited(base, 6, 25)),
        (7, edited(base, 7, 9)),
        (8, prose(8, 250)),
        (9, None),
        (10, ""),
        (11, " \n\t "),
        (12, "one"),
        (13, "two words"),
        (14, "two  Words"),
        (15, prose(15, 30_000)),  # very long
        (16, "é ü ß ñ Ünïcode 文字 \U0001f600 text " * 5),
        (17, prose(17, 40)),
        (17, prose(17, 40)),  # repeated row
        (18, "a b c d e f\n" * 50),
        (None, "a row without an id, " + prose(99, 60)),
        (None, None),
    ]
    rows += [(100 + i, edited(prose(2, 120), 100 + i, 40)) for i in range(30)]  # a group of near copies
    return [(i, t, "en", "src0", len(t) if t else 0) for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)


def clashing(df):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "id n key x row line digest bands hub a b k c at block tail page_id first score word band rep edge part label".split()
    return df.select("*", *[F.lit("clash").alias(n) for n in names if n not in df.columns])
