"""Stores whose tables change at once, and the background kept up load by load."""

import random

import pytest
from pyspark.sql import functions as F

from oddspark.plans import background as B
from oddspark.plans import deltas
from oddspark.sources.versions import ConcurrentChange, Store

ROW = "k string, v long"


def frame(spark, *rows):
    return spark.createDataFrame(rows, ROW)


def test_a_reader_keeps_its_version_and_a_failed_write_is_invisible(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path / "s"))
    assert rows(store.read("t", frame(spark, ("a", 1)).schema)) == []
    store.overwrite("t", frame(spark, ("a", 1), ("b", 1)))
    before = store.read("t")
    fails = frame(spark, ("c", 3)).withColumn("v", F.raise_error(F.lit("lost")).cast("long"))
    for write in (store.overwrite, store.append):
        with pytest.raises(Exception, match="lost"):
            write("t", fails)
        assert rows(store.read("t")) == [("a", 1), ("b", 1)] and len(store.numbers()) == 1
    half = store.change().put("t", frame(spark, ("x", 9))).put("u", frame(spark, ("y", 9)))
    assert rows(store.read("t")) == rows(before) and "u" not in store.manifest().tables
    half.commit()
    assert rows(store.read("t")) == [("x", 9)] and rows(store.read("u")) == [("y", 9)]
    assert rows(before) == rows(store.read("t", version=1)) == [("a", 1), ("b", 1)]


def test_second_runs_change_nothing(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path / "s"))
    data = frame(spark, ("a", 1), (None, 2), (None, 3))
    assert store.append("log", data, load="one") and not store.append("log", data, load="one")
    assert store.append("log", data, load="two") and store.read("log").count() == 6
    assert store.insert_ignore("t", data, ["k"], ["v"])
    assert rows(store.read("t")) == [("a", 1), (None, 2)]
    for again in (data, data.withColumn("v", F.col("v") + 5)):
        assert not store.insert_ignore("t", again, ["k"], ["v"])
    n = len(store.numbers())
    for _ in range(3):
        store.upsert("t", frame(spark, (None, 7), ("c", 1)), ["k"])
        assert rows(store.read("t")) == [("a", 1), ("c", 1), (None, 7)]
    assert len(store.numbers()) == n + 3


def test_of_two_writers_one_wins_and_added_rows_are_kept(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path / "s"))
    store.overwrite("t", frame(spark, ("a", 1)))
    one = store.change().put("t", frame(spark, ("b", 2)))
    two = store.change().put("t", frame(spark, ("c", 3)))
    one.commit()
    with pytest.raises(ConcurrentChange):
        two.commit()
    assert rows(store.read("t")) == [("b", 2)]
    real, calls = store.manifest, []

    def late(number=None):
        calls.append(1)
        # Another append comes in between the first look and the commit.
        found = real(number)
        if len(calls) == 1:
            Store(spark, store.path).append("t", frame(spark, ("d", 4)))
        return found

    store.manifest = late
    assert store.append("t", frame(spark, ("e", 5)))
    assert rows(Store(spark, store.path).read("t")) == [("b", 2), ("d", 4), ("e", 5)]


def test_parts_are_replaced_alone_and_old_versions_go(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path / "s"))
    store.overwrite("t", frame(spark, ("q 1/x", 1), ("q2", 2), (None, 3)), by="k")
    old = store.manifest().tables["t"]["folders"]
    store.change().replace("t", frame(spark, ("q 1/x", 9)), "k", ["q 1/x", None]).commit()
    assert rows(store.read("t")) == [("q 1/x", 9), ("q2", 2)]
    assert len(set(old) & set(store.manifest().tables["t"]["folders"])) == 1
    store.change().replace("t", frame(spark).limit(0), "k", ["q2"]).commit()
    assert rows(store.read("t")) == [("q 1/x", 9)] and rows(store.read("t", version=1))[0] == ("q 1/x", 1)
    assert store.vacuum() == 2 and store.numbers() == [3] and rows(store.read("t")) == [("q 1/x", 9)]
    store.overwrite("t", frame(spark).limit(0))
    assert store.read("t").count() == 0 and store.read("t").columns == ["k", "v"]
    with pytest.raises(KeyError):
        store.read("other")


def made_up_load(spark, seed, cases=12):
    rng = random.Random(seed)
    quarter = lambda: rng.choice(["Q1", "Q2", "Q3", None] if seed == 2 else ["Q1", "Q2", "Q3"])
    reports = [(rng.randrange(40), rng.choice([*range(cases), None]), rng.choice([1, 2, 3, None]), quarter()) for _ in range(14)]
    keys = [(p, q) for p, _, _, q in reports] + [(rng.randrange(40), quarter()) for _ in range(8)]
    drugs = [(p, rng.choice("ABC"), "", rng.choice(["PS", "SS", "C"]), q) for p, q in keys for _ in range(2)]
    events = [(p, rng.choice(["x", "y", "z", None]), q) for p, q in keys for _ in range(2)]
    return (
        spark.createDataFrame(reports, "primaryid long, caseid long, caseversion int, faers_quarter string"),
        spark.createDataFrame(drugs, "primaryid long, drugname string, prod_ai string, role_cod string, faers_quarter string"),
        spark.createDataFrame(events, "primaryid long, pt string, faers_quarter string"),
    )


@pytest.mark.parametrize("scope, tied", [("all", True), ("quarter", True), ("all", False)])
def test_loads_one_by_one_equal_all_at_once(spark, tmp_path, rows, scope, tied):
    path, together = str(tmp_path / "b"), None
    for seed in (1, 4):
        load = made_up_load(spark, seed)
        if not tied:
            load = (load[0], load[1].drop("faers_quarter"), load[2].drop("faers_quarter"))
        together = load if together is None else [a.unionByName(b) for a, b in zip(together, load, strict=True)]
        kept = deltas.apply_load(spark, path, *load, scope=scope)
        want = B.build_background(*together, scope=scope)
        for table in B.TABLES:
            columns = getattr(want, table).columns
            assert rows(getattr(kept, table), *columns) == rows(getattr(want, table), *columns), (seed, table)
    again = deltas.apply_load(spark, path, *load, scope=scope)
    for table in B.TABLES:
        assert rows(getattr(again, table)) == rows(getattr(kept, table))


def test_a_moved_case_takes_its_old_pairs_back(spark, tmp_path, rows):
    demo = spark.createDataFrame([(11, 1, 1, "Q1"), (12, 2, 1, "Q1"), (13, 1, 2, "Q2")],
                                 "primaryid long, caseid long, caseversion int, faers_quarter string")
    drug = spark.createDataFrame([(i, d, d, "PS") for i, d in [(11, "A"), (12, "B"), (13, "C")]],
                                 "primaryid long, drugname string, prod_ai string, role_cod string")
    reac = spark.createDataFrame([(i, "Ileus") for i in (11, 12, 13)], "primaryid long, pt string")
    path = str(tmp_path / "b")
    first, second = ([df.where(c) for df in (demo, drug, reac)] for c in ("primaryid < 13", "primaryid = 13"))
    one = deltas.apply_load(spark, path, *first)
    two = deltas.apply_load(spark, path, *second)
    pair = ["drug_key", "event_pt", "faers_quarter", "n_reports"]
    assert rows(one.drug_event_counts, *pair) == [("a", "Ileus", "Q1", 1), ("b", "Ileus", "Q1", 1)]
    assert rows(two.drug_event_counts, *pair) == [("b", "Ileus", "Q1", 1), ("c", "Ileus", "Q2", 1)]
    assert rows(deltas.read_loads(spark, path, 1).quarter_totals, "faers_quarter", "n_reports") == [("Q1", 2)]


def test_counts_merge_in_any_grouping(spark, rows):
    parts = [spark.createDataFrame(r, "k string, n_reports long") for r in ([("a", 2), ("b", 1)], [("a", -2)], [("b", 3), ("c", -1)])]
    whole = rows(deltas.merged_counts(*parts))
    assert whole == [("b", 4), ("c", -1)]
    assert rows(deltas.merged_counts(deltas.merged_counts(parts[2], parts[1]), parts[0])) == whole
    assert rows(deltas.merged_counts(*parts, *[deltas.negated(p) for p in parts])) == []
