from textloom.plans.catalogue import QUERIES


def test_ranks_of_two_bit_patterns(spark, tmp_path):
    bits = [0, 0, 0, 1, 1, 0, 1, 1, 1, 0]
    spark.createDataFrame([(i, "click" if b else "view") for i, b in enumerate(bits)], "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["i"]: (r["rank00"], r["rank10"], r["rank11"]) for r in QUERIES["bit_rank_patterns"](spark, str(tmp_path)).collect()}
    pairs = list(zip(bits, bits[1:]))
    assert got == {i: tuple(pairs[: max(i - 1, 0)].count(p) for p in ((0, 0), (1, 0), (1, 1))) for i in range(len(bits))}
