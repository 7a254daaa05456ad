from statloom.operators import literature


def test_first_records_with_ties_nulls_and_a_key_of_many(spark):
    rows = [(k, None, "The same long title") for k in range(5, 3000)] + [(None, None, "the SAME long title"), (1, "10.1/A ", "First by its DOI"), (2, "10.1/a", "Second by its DOI"), (3, None, None), (4, None, "brief"), (4, "", "Told twice at one time"), (4, " ", "Told twice at one time")]
    works = spark.createDataFrame(rows, "id int, doi string, title string").selectExpr("*", "id as `a.b`").repartition(5)
    got = literature.dedupe(works, "id")
    assert got.columns == works.columns
    assert sorted((r["id"] or 0, r["title"]) for r in got.collect()) == [(0, "the SAME long title"), (1, "First by its DOI"), (4, "Told twice at one time")]
    assert literature.dedupe(works.limit(0), "id").count() == 0
