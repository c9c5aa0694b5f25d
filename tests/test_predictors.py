"""The stated predictors, whatever levels the data have."""

import pytest

from offerloom.plans.modelling import BASE_PREDICTORS, OPTIONAL_DUMMIES, STATED_PREDICTORS, predictors, with_absent_levels


def table(frame, *more):
    names = [c for c in BASE_PREDICTORS if c not in OPTIONAL_DUMMIES] + list(more)
    return frame([(1,) * len(names)], ", ".join(f"{c} int" for c in names))


def test_stated_predictors_are_48_names_in_one_order():
    assert len(STATED_PREDICTORS) == len(set(STATED_PREDICTORS)) == 48
    assert STATED_PREDICTORS[:15] == BASE_PREDICTORS
    assert STATED_PREDICTORS[15] == "categ_code_1" and STATED_PREDICTORS[-1] == "no_child_code_3"


def test_absent_levels_are_zero_and_do_not_shorten_the_list(frame):
    whole = with_absent_levels(table(frame, "income_code_11", "family_code_2", "income_code_3"), stated=True)
    assert predictors(whole, stated=True) == STATED_PREDICTORS
    row = whole.first().asDict()
    assert {c for c in STATED_PREDICTORS[15:] if row[c]} == {"income_code_11", "family_code_2", "income_code_3"}
    assert {row[c] for c in OPTIONAL_DUMMIES} == {0}


def test_levels_beyond_the_stated_ones_and_missing_names_are_refused(frame):
    with pytest.raises(ValueError, match="income_code_12"):
        predictors(with_absent_levels(table(frame, "income_code_12"), stated=True), stated=True)
    with pytest.raises(ValueError, match="family_code_1"):
        predictors(with_absent_levels(table(frame)), stated=True)


def test_without_the_list_the_dummies_of_the_table_are_taken(frame):
    whole = with_absent_levels(table(frame, "income_code_12", "categ_code_1"))
    assert predictors(whole) == [*BASE_PREDICTORS, "categ_code_1", "income_code_12"]
