import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows():
    """Small documents with every awkward case: null, empty, white space, long, repeated rows, copies, near copies."""
    r = random.Random(11)
    words = [a + b for a in "ba ke lo mi nu ra si to".split() for b in "ten dor vel ing sha".split()]
    rows = []
    for i in range(60):
        n = r.choice([1, 3, 8, 40, 120])
        rows.append((i, " ".join(r.choice(words) for _ in range(n)), "en", f"src{i % 4}", None))
    base = " ".join(r.choice(words) for _ in range(200))
    for i in range(60, 70):
        near = base.split()
        near[i] = "changed"
        rows.append((i, " ".join(near), "en", "src0", 1))
    rows += [(i, base, "en", "src0", 1) for i in range(70, 76)]
    rows += [(80, None, None, None, None), (81, "", "en", "", 0), (82, " \t\n", "en", "src1", 3), (83, base.replace(" ", "\n ").upper(), "de", "src2", 9), (84, "x" * 30000 + " " + "y z " * 3000, "en", "src3", 1)]
    rows += [(85, "Grüße, Straße!  二重 spaces here", "de", "src9", 5), (86, "", "en", "src1", 0), (None, "no id here at all", "en", "src1", 4), (5, rows[5][1], "en", "src1", None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"row": F.lit("x"), "size": F.lit("y"), "fp": F.lit(1), "label": F.lit(2), "node": F.lit(3)}).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
