from tidewell.llm import places


def test_null_and_repeated_keys(spark):
    """Rows without a key, and rows that share one, are each resolved by their own context, and equal rows all come out."""
    reference = spark.createDataFrame(
        [(1, "admin_1", "Karimata", None, None), (2, "admin_1", "Wolindra", None, None), (3, "admin_2", "Kabupaten Belu", 1, None), (4, "admin_2", "Kabupaten Belu", 2, None)],
        "place_id long, place_level string, place_name string, parent_id long, aliases string",
    )
    rows = [(None, "karimata", "Kab. Belu", None), (None, "wolindra", "Kab. Belu", None), (7, "wolindra", "Kab. Belu", None), (7, "karimata", "Kab. Belu", None), (None, "karimata", "Kab. Belu", None)]
    df = spark.createDataFrame(rows, "silver_observation_id long, admin_1 string, admin_2 string, facility_name string")
    got = sorted((r.silver_observation_id or 0, r.field_name, r.place_id) for r in places.map_places(df, reference).collect())
    assert got == sorted([(0, "admin_1", 1), (0, "admin_2", 3), (0, "admin_1", 2), (0, "admin_2", 4), (7, "admin_1", 2), (7, "admin_2", 4), (7, "admin_1", 1), (7, "admin_2", 3), (0, "admin_1", 1), (0, "admin_2", 3)])
