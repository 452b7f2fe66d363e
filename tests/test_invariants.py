import pytest

from sparkloom.operators import invariants

FINE = {name: [("1", "src/a.ts"), ("2", "src/b.ts")] for name in invariants.FAMILIES}


def tables(spark, **changed):
    return {k: spark.createDataFrame(v, "id string, path string") for k, v in (FINE | changed).items()}


def test_a_sound_report_passes(spark):
    """Equal ids in different families are no problem."""
    invariants.checked(tables(spark), "/home/p")
    invariants.checked(tables(spark, routes=[]))
    invariants.checked({"nodes": tables(spark)["nodes"]})


@pytest.mark.parametrize("family", invariants.FAMILIES)
def test_an_id_that_repeats_in_a_family(spark, family):
    with pytest.raises(invariants.InvalidReport, match=f"^{family}: duplicate id '1'$"):
        invariants.checked(tables(spark, **{family: [("1", "src/a.ts"), ("2", "b"), ("1", "c")]}), "/p")


@pytest.mark.parametrize("path", ["", "a//b.ts", "a\\b.ts", None, "//a"])
def test_a_path_that_is_not_normal(spark, path):
    got = invariants.problems(tables(spark, files=[("1", "fine.ts"), ("2", path)])).collect()
    assert [tuple(r) for r in got] == [(invariants.PATH, "files", path, 1)]
    if path is not None:
        with pytest.raises(invariants.InvalidReport, match="root"):
            invariants.checked(tables(spark), path)


def test_null_ids_and_one_shuffle(spark):
    got = invariants.problems(tables(spark, hooks=[(None, "a"), (None, "b"), ("3", "c")]))
    assert [tuple(r) for r in got.where("code = 'duplicate id'").collect()] == [(invariants.DUPLICATE, "hooks", None, 2)]
    plan = invariants.problems({k: v for k, v in tables(spark).items() if k != "files"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
