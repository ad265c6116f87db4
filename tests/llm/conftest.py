"""A table of documents with the odd cases that every operator must stand."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, mark string"


def prose(rng: random.Random, n: int, size: int = 400) -> str:
    words = [f"w{rng.randrange(size)}" for _ in range(n)]
    return "".join(w + (". " if rng.random() < 0.08 else " ") for w in words).strip()


def changed(rng: random.Random, text: str, share: float) -> str:
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    out: list[tuple[int | None, str | None]] = [(k, prose(rng, rng.choice((3, 12, 60, 200)))) for k in range(100)]
    base, common = [prose(rng, n) for n in (40, 80, 300)], prose(rng, 60)
    for k in range(60):
        out.append((1000 + k, changed(rng, base[k % 3], rng.choice((0.0, 0.01, 0.03, 0.06)))))
    for k in range(30):
        out.append((2000 + k, f"{prose(rng, rng.choice((5, 15, 40)))} {common}"))
    out += [(3000, None), (3001, ""), (3002, " \n\t "), (3003, "one two"), (3004, "one two"), (3005, "One TWO"), (3006, "ünï çødé 漢字 🙂 text " * 40)]
    out += [(3007, prose(rng, 6000)), (3008, "a " * 3000), (None, "no id at all"), (None, None), (7, "a repeated id"), (3003, "one two")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t) if t else None, 0.5, 1, "m") for i, t in rows], DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
