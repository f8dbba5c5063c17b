"""Places in a total order, with hot groups, ties and nulls."""

from pyspark.sql import functions as F

from auditlake.operators.ordering import indexed


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_places_follow_the_order(spark):
    # A group with most rows, a null group, ties, and columns whose names the helper would take.
    data = [("a", i * 7 % 101, "x") for i in range(400)] + [(None, 3, "y"), (None, None, "y"), ("b", 1, "z")]
    df = spark.createDataFrame(data, "grp string, v int, part string").repartition(7)
    got = rows_of(indexed(df, ["v"], ["grp"], "index", "n"))
    want = []
    for g in ("a", None, "b"):
        own = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        want += [(*r, i, len(own)) for i, r in enumerate(own)]
    assert sorted(g[3] for g in got if g[0] == "a") == list(range(400))
    # Rows that tie in the order may change places, so compare the values at each place.
    assert {(g[0], g[3], g[1], g[4]) for g in got} == {(w[0], w[3], w[1], w[4]) for w in want}


def test_falling_order_and_no_group(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    got = {r["k"]: r["place"] for r in indexed(df, [F.desc("k")], (), "place").collect()}
    assert got == {k: 999 - k for k in range(1000)}


def test_equal_rows_and_none(spark):
    same = spark.createDataFrame([(1,)] * 500, "k int").repartition(5)
    assert sorted(r["index"] for r in indexed(same, ["k"]).collect()) == list(range(500))
    assert indexed(spark.createDataFrame([], "k int"), ["k"], total="n").count() == 0
