"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

from __future__ import annotations

import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, unit string, row int"


def prose(rng: random.Random, n: int, words: str = "") -> str:
    syllables = ["the", "of", "ti", "on", "er", "an", "re", "éa", "ou", "sch"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n)) + words


def texts() -> list[str | None]:
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(30, 160)) for _ in range(14)]
    passage = prose(rng, 70)
    near = base[0].split(" ")
    near[10] = "CHANGED"
    out: list[str | None] = [*base, base[0], " ".join(near), base[1].upper(), None, "", "   \n ", "one", "One", "two words", "x" * 5000, "ab" * 3000, prose(rng, 6000)]
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(4)]
    out += ["éé" * 200 + "z", "éé" * 200 + "y", base[2] + "\n" + base[2], " ".join(near[5:])]
    return out


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    t = texts()
    out = [(i, x, ["en", "fr", None][i % 3], [None, "s1"][i % 2], len(x) if x is not None else None, None, None, None, 1) for i, x in enumerate(t)]
    out.append(out[3])  # a repeated row
    out.append((5, "another text of doc five", "en", "s1", 24, True, 0.5, "u", 2))  # a repeated id
    out.append((None, t[4], "en", "s1", 3, None, None, None, None))
    out.append((None, "nobody's own text", None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None if i == 4 else i % 3 // 2) for i in range(30)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
