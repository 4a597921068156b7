"""Small filters and choices."""

from argosift.operators import relational as R


def test_errors_absent_small(spark):
    df = spark.createDataFrame([(1, None, "claim", 0), (2, " ", "Not Present ", 0), (3, "bad", "x", 1), (4, "", None, -1)], "row_index long, error string, claim string, cluster_id int")
    assert sorted(r.row_index for r in R.drop_errors(df).collect()) == [1, 2, 4]
    assert R.drop_errors(df.drop("error")).count() == 4
    assert sorted(r.row_index for r in R.drop_absent(df, "claim").collect()) == [1, 3, 4]
    assert sorted(r.row_index for r in R.drop_small(df, least=2).collect()) == [1, 2]


def test_picks_are_stable(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "row_index long, g string")
    one, two = (sorted(map(tuple, R.pick_rows(x, ["g"], 5).collect())) for x in (df, df.repartition(7)))
    assert one == two and len(one) == 10
    assert len(R.pick_rows(df, ["g"], 100).collect()) == 40


def test_available(spark):
    df = spark.createDataFrame([(1.0, None, float("nan"))], "a double, b double, c double")
    assert R.available(df, ["a", "b", "c", "d"]) == ["a"] and R.available(df, ["d"]) == []
