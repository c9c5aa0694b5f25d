"""Stored dictionaries: old codes stay, new levels come behind, unknown ones follow the stated policy."""

import pytest

from offerloom.operators import dictionary

SCHEMA = "a string, b int, _level string"


def codes(df, column):
    return {r.level: r.code for r in df.where(df.column_name == column).collect()}


def test_old_codes_stay_and_unknown_levels_are_counted(spark, tmp_path):
    path = str(tmp_path / "levels")
    first = spark.createDataFrame([("x", 10, "q"), ("m", 9, "q"), (None, 100, "q"), ("x", None, "q")], SCHEMA)
    later = spark.createDataFrame([("b", 10, "q"), ("z", 2, "q"), ("b", 2, "q"), (None, None, "q"), ("x", 9, "q")], SCHEMA)
    with pytest.raises(ValueError):
        dictionary.read_dictionary(spark, path)
    assert dictionary.fit_dictionary(first, ["a", "b"], path) == 1
    old = dictionary.read_dictionary(spark, path)
    assert codes(old, "a") == {"m": 0, "x": 1} and codes(old, "b") == {"9": 0, "10": 1, "100": 2}
    unknown = {r.column_name: (r.n_levels, r.n_rows) for r in dictionary.unknown_levels(later, ["a", "b"], path).collect()}
    assert unknown == {"a": (2, 3), "b": (1, 2)}

    def encoded(df, **policy):
        rows = dictionary.encode(df.drop("_level"), {"a": "a_code", "b": "b_code"}, path, **policy).collect()
        return sorted(((r.a, r.b, r.a_code, r.b_code) for r in rows), key=repr)

    before = encoded(first)
    assert encoded(later) == sorted([("b", 10, None, 1), ("z", 2, None, None), ("b", 2, None, None), (None,) * 4, ("x", 9, 1, 0)], key=repr)
    assert encoded(later, unknown="other").count(("b", 2, -1, -1)) == 1
    with pytest.raises(Exception, match="has no code for"):
        encoded(later, unknown="error")
    assert dictionary.append_levels(later, ["a", "b"], path) == 2
    new = dictionary.read_dictionary(spark, path)
    assert codes(new, "a") == {"m": 0, "x": 1, "b": 2, "z": 3} and codes(new, "b")["2"] == 3
    assert encoded(first) == before and encoded(first, unknown="error") == before
    assert ("b", 2, 2, 3) in encoded(later, unknown="error")
    assert ("b", 2, None, None) in encoded(later, version=1)
    assert dictionary.append_levels(later, ["a", "b"], path) == 2  # nothing new, nothing written
    assert {r.column_name: (r.n_levels, r.n_rows) for r in dictionary.unknown_levels(later, ["a"], path).collect()} == {"a": (0, 0)}
    with pytest.raises(ValueError):
        dictionary.fit_dictionary(later, ["a"], path)
    with pytest.raises(ValueError):
        dictionary.read_dictionary(spark, path, 3)


def test_an_unfinished_version_is_written_over(spark, tmp_path):
    path = tmp_path / "levels"
    df = spark.createDataFrame([("a", 1, "")], SCHEMA)
    dictionary.fit_dictionary(df, ["a"], str(path))
    (path / "version=2").mkdir()
    (path / "version=2" / "part-0.parquet").write_text("cut off")
    assert dictionary.latest_version(spark, str(path)) == 1
    assert dictionary.append_levels(spark.createDataFrame([("0", 1, "")], SCHEMA), ["a"], str(path)) == 2
    assert codes(dictionary.read_dictionary(spark, str(path)), "a") == {"a": 0, "0": 1}
    assert dictionary.append_levels(df.limit(0), ["a"], str(path)) == 2
