"""json_violations judges the body of every turn, with NaN as a word beside it or not."""

import __spark_entry__ as entry


def test_bodies_with_a_word_are_judged_whole(spark, tmp_path):
    rows = [(4, turn, "user", f"words of turn {turn}") for turn in range(10)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.violation for r in entry.queries()["json_violations"](spark, str(tmp_path)).collect()}
    # turn 4 has a body that is cut
    assert got == {turn: "invalid_json" if turn == 4 else "none" for turn in range(10)}
