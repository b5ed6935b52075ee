"""Small tables with the cases every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd: random.Random, n: int) -> str:
    words = ["".join(rnd.choice(["an", "er", "on", "the", "tion", "re", "es", "ñ", "é"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]
    lines, line = [], []
    for w in words:
        line.append(w)
        if len(line) == 30:
            lines.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join(lines + ([" ".join(line) + "."] if line else []))


def sample_rows(seed: int = 1, n: int = 40) -> list[tuple]:
    """Prose with exact copies, copies in other white space, near copies and shared passages."""
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.randint(60, 160)) for _ in range(n)]
    passage = prose(rnd, 30).replace("\n", " ")
    texts += [texts[0], texts[1].replace(" ", "  "), texts[2].replace("\n", " \n")]
    for k in (3, 4, 5):
        words = texts[k].split(" ")
        for _ in range(1):
            words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(rnd, 40)} {passage} {prose(rnd, 40)}" for _ in range(4)]
    return [(10 + i, t, rnd.choice(["en", "fr"]), f"src{i % 3}", len(t)) for i, t in enumerate(texts)]


def odd_rows() -> list[tuple]:
    """Null and empty texts, null ids, repeats, ties, a very long text."""
    long_text = " ".join(f"w{i}" for i in range(30_000))
    return [
        (1, None, None, None, None), (2, "", "en", "src0", 0), (3, " \t\n ", "en", "src0", 4), (None, "no id here at all", "en", None, 17), (None, None, "fr", "src1", None),
        (4, "same text", "en", "src0", 9), (4, "same text", "en", "src0", 9), (5, "same text", "en", "src0", 9), (6, "x", "en", "src1", 1), (7, long_text, "en", "src1", len(long_text)),
        (8, "a " * 300, "en", "src1", 600), (9, "ok <|endoftext|> ok", "en", "src0", 19),
    ]


def frame(spark, rows, clash: bool = False):
    """The rows as documents; with clash, extra columns named as operators name their own."""
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for name in ("key", "digest", "bucket", "size", "label", "line", "id", "_key", "_keep", "_new_text", "grp", "start"):
            df = df.selectExpr("*", f"'{name}' as {name}")
    return df


def same(left, right) -> None:
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(tuple, left), key=key) == sorted(map(tuple, right), key=key)
