from tessellar.plans import catalogue


def test_truncated_vectors_keep_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    rows = [(1, [-1e-7, 1e-7, -0.0, 0.0, -2.5, 0.1234567, float("inf"), float("nan"), 9.0]), (2, [-0.5]), (3, []), (4, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.memory_id: r.head for r in catalogue.queries()["q_mrl_truncate"](spark, str(tmp_path)).collect()}
    assert {k: repr(v) for k, v in got.items()} == {1: "[-0.0, 0.0, -0.0, 0.0, -2.5, 0.123457, inf, nan]", 2: "[-0.5]", 3: "[]", 4: "None"}
