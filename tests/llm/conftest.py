import random

import pytest

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in all columns, empty and blank texts, a very long one, repeated rows, and columns with names of the operators' own."""
    rows = [(1, "one  two\tthree", "x"), (2, "", "x"), (3, None, "x"), (None, "a b c d", "x"), (None, None, None), (4, " \n\n ", None), (5, prose(1, 30_000), "x"), (6, "dup dup dup", "x"), (6, "dup dup dup", "x"), (7, "▁ literal ▁▁ mark 🙂\x01", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string").selectExpr("*", "1 as n", "'c' as comp", "'k' as key", "'f' as fp")


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns with names of the operators' own, in either case."""
    names = "KD_KEY kd_covered kd_id kd_mark kd_gone kd_lines kd_removed kd_ids kd_text kd_tokens kd_score KD_words kd_labels kd_kept kd_base kd_of kd_host kd_wrapper kd_y".split()
    rows = [(i, prose(i % 3, 70) + "\n" + prose(9, 5), *["x"] * len(names)) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
