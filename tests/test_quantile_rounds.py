"""Exact quantiles go over their numbers several times, over what lies before them once."""

import pytest

from offerloom.operators import ordered, profile


@pytest.mark.parametrize("report", [profile.describe, lambda df, c: ordered.quantiles(df, c, {"q50": 0.5})])
def test_rounds_of_quantiles_read_staged_numbers(spark, frame, report):
    """What lies before the numbers runs once, not once per round."""
    seen = spark.sparkContext.accumulator(0)

    def watched(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    df = frame([(i % 7 if i % 9 else None, i % 11 / 2) for i in range(900)], "n int, x double")
    report(df.mapInArrow(watched, "n int, x double"), ["n", "x"]).collect()
    assert seen.value == 900
