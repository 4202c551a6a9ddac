import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, fp long, run long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, near copies, a long text and a null id; extra columns clash."""
    shared, base = prose(1, 60), prose(2, 300)
    texts = {
        0: "", 1: None, 2: "  \t\n ", 3: "one", 4: base, 5: base, 6: base + " tail", 7: prose(3, 40) + " " + shared, 8: shared + " " + prose(4, 50),
        9: "word " * 200, 10: prose(5, 20_000), 11: "Mail a.b@mail.example.com or +1 (212) 555-0199, card 4111 1111 1111 1111 from 10.0.0.255.", 12: "é ñ ß 漢字   x",
    }
    out = [(i, t, "en" if i % 2 else "de", None if i == 3 else f"src{i % 20}", None if t is None else len(t)) for i, t in texts.items()]
    out += [(4, base, "de", "src4", len(base)), (None, base, None, None, len(base)), (None, "lost", "fr", "x", 4)]
    return [(*r, "clash", 7, 8, 9) for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), KIND).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(13)] + [(4, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
