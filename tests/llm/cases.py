"""Small tables with the awkward cases, and frames over them."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n, per_line=12):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + r.choice(["", "", "s", "n"]))
        if i % per_line == per_line - 1:
            out[-1] += "."
            out.append("\n")
    return " ".join(out).replace(" \n ", "\n")


LONG = "\n".join(prose(100 + i, 40) for i in range(60))

#: null and empty texts, null ids, repeated rows, equal ids, copies, near copies, a long text
EDGE = [
    (1, prose(1, 120)), (2, prose(1, 120)), (3, prose(1, 120) + " one more tail"), (4, None), (5, ""), (6, "   \n \t"),
    (7, "short"), (7, "short"), (8, "two\nlines"), (9, LONG), (10, LONG + "\nand an end"), (None, prose(1, 120)), (None, None),
    (12, prose(2, 80)), (12, prose(3, 80)), (13, "a" * 700), (14, "a" * 120 + "b"), (15, "é😀ñ " * 60), (16, "\n".join(["same line here"] * 5)),
    (17, "one two three four"), (18, "ONE two\tthree  four"), (19, prose(4, 30) + "\n" + prose(2, 80)),
]


def frame(spark, rows, extra=True):
    """documents with columns whose names clash with those that the operators use inside."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for i, c in enumerate("d t b n row rid keys lines words score kept source c comp part x".split()):
            docs = docs.selectExpr("*", f"{i} AS {c}")
    return docs


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
