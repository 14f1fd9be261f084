"""Documents that hold the cases every operator must define: nulls, empty and very long texts, ties, repeated
rows, and extra columns whose names clash with those that operators use."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, block int, n long, key string"


def prose(rng: random.Random, n: int, stems: str) -> str:
    words = ["".join(rng.choice(stems.split()) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words)


def corpus() -> list[tuple]:
    rng = random.Random(11)
    stems = {"en": "th ing er on ea st wh", "fr": "eau ch on é è ou re", "de": "sch ung ei ß ä ver keit", "es": "ción ll ñ os a do ie"}
    rows = []
    for i in range(120):
        lang = list(stems)[i % 4]
        rows.append((i, prose(rng, rng.randint(4, 160), stems[lang]), lang))
    passage = prose(rng, 60, stems["en"])
    rows += [(200 + i, prose(rng, 30, stems["en"]) + " " + passage + "\n" + prose(rng, 30, stems["en"]), "en") for i in range(6)]
    base = prose(rng, 120, stems["en"]).split()
    for i in range(14):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        rows.append((300 + i, " ".join(w), "en"))
    rows += [(400 + i, rows[5][1].replace(" ", "  " if i % 2 else "\t"), "en") for i in range(8)]  # copies
    rows += [(500, None, "en"), (501, "", None), (502, " \n\t ", "de"), (503, "12 34 !! ..", None), (504, "Wort", "de")]
    rows += [(505, prose(rng, 30_000, stems["en"]), "en"), (506, "x" * 200_000, None), (507, "MIXED Case TEXT", None)]
    rows += [(508, "a b c d", "en"), (509, "A B C D", "en"), (510, "a b c d e", "en"), (None, "nothing known here about", None), (None, None, None)]
    rows += [rows[3], rows[3], rows[7]]  # repeated rows
    rows += [(600, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "en"), (601, "the gnu general public license apache license", "en")]
    rows += [(602, "write to ann.lee@mail.example.com or +1 (811) 555-3281 from 10.0.0.255, card 4111 1111 1111 1111 ok", "en")]
    rows += [(603, 'set token = "08813ad77930c5f691325605b62c9dfd1b407297" now', "en"), (604, "300.1.1.1 a@b +12 1234567890123456", "en")]
    return [(i, t, lang, f"src{k % 3}", len(t or ""), "clash", k, k, "clash") for k, (i, t, lang) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
