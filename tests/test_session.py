import os
from functools import partial

import pytest

from datalathe.operators.impute import preview_imputation
from datalathe.session import cut_lineage, fresh_path, scratch, shared_folder, together


def _tables(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("datalathe-")}


def test_the_shared_folder_works_on_a_plain_session(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_scratch_tables_go_with_their_scope(spark, column):
    before = _tables(spark)
    kept = cut_lineage(column([1.0, 2.0]))
    with scratch(spark):
        cut_lineage(column([3.0])).count()
        together(spark, {str(i): partial(cut_lineage, column([float(i)])) for i in range(3)})
    assert len(_tables(spark) - before) == 1 and kept.count() == 2
    with pytest.raises(ValueError), scratch(spark):
        cut_lineage(column([3.0]))
        raise ValueError
    assert len(_tables(spark) - before) == 1


def test_a_preview_leaves_nothing_behind(spark, column):
    before = _tables(spark)
    shown = preview_imputation(column([1.0, None, 3.0]), "x", "forward_fill")
    assert shown["sample_after"] == [1.0]
    assert _tables(spark) == before
