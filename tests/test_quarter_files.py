"""From raw quarter files to signals, against counts made by hand in Python."""

import itertools

import pytest
from pyspark.sql import functions as F

from oddspark.plans import background as B
from oddspark.plans import cohort as H
from oddspark.plans import dashboard as D
from oddspark.plans import signals as G
from oddspark.sources import delimited, tables
from oddspark.sources.fixtures import inline_dictionary

HEADERS = {
    "DEMO": "PRIMARYID$CASEID$CASEVERSION$EVENT_DT$FDA_DT$AGE$AGE_COD$SEX$REPORTER_COUNTRY$"
            "OCCR_COUNTRY$REPT_COD",
    "DRUG": "PRIMARYID$DRUG_SEQ$ROLE_COD$DRUGNAME$PROD_AI$ROUTE$DOSE_AMT$DOSE_UNIT",
    "REAC": "PRIMARYID$PT$DRUG_REC_ACT",
    "OUTC": "PRIMARYID$OUTC_COD",
    "INDI": "PRIMARYID$INDI_DRUG_SEQ$INDI_PT",
    "RPSR": "PRIMARYID$RPSR_COD",
}

# Report 101 is replaced by 102 in the same quarter; 103 is the same case in the next one.
FILES = {
    ("2024Q1", "DEMO"): [
        "101$1$1$20240101$20240105$40$YR$F$US$US$EXP",
        "102$1$2$20240231$20240106$40$YR$F$US$US$EXP$surplus$cells",
        "201$2$$202401$20240107$6$DEC$M$US$GB$DIR",
        "301$3$1$$20240108$abc$YR$$FR$FR$EXP",
        "401$4$1$2024$20240109$24$mon$F",
        "501$5$1$20240110$20240110$70$$M$US$US$EXP",
    ],
    ("2024Q1", "DRUG"): [
        "101$1$PS$OZEMPIC$SEMAGLUTIDE$SC$1$MG",
        "102$1$PS$OZEMPIC$SEMAGLUTIDE$SC$1$MG",
        "102$2$SS$Ozempic 1 mg$SEMAGLUTIDE$SC$x$MG",
        '102$3$C$"ASPIRIN ""X\\Y"""$ASPIRIN$PO$100$MG',
        "201$1$PS$METFORMIN 500 MG TABLET$$PO$500$MG",
        "201$2$I$WEGOVY$$SC$$",
        "301$1$PS$SOLIQUA$INSULIN GLARGINE\\LIXISENATIDE$SC$1$MG",
        "401$x$PS$METFORMIN$METFORMIN$PO$5$MG",
        "501$1$SS$ASPIRIN$ASPIRIN$PO$5$MG",
    ],
    ("2024Q1", "REAC"): [
        "101$Nausea$", "102$Nausea$", "102$Nausea$", "102$Vomiting$", "201$Nausea$", "301$Ileus$",
        "401$$", "401$Headache$", "501$Nausea$",
    ],
    ("2024Q1", "OUTC"): ["102$HO", "102$DE", "201$OT", "301$DS", "401$RI", "501$CA"],
    ("2024Q1", "INDI"): ["102$1$Diabetes", "301$y$Obesity"],
    ("2024Q1", "RPSR"): ["102$CSM"],
    ("2024Q2", "DEMO"): ["103$1$3$20240401$20240402$40$YR$F$US$US$EXP"],
    ("2024Q2", "DRUG"): ["103$1$PS$OZEMPIC$SEMAGLUTIDE$SC$1$MG"],
    ("2024Q2", "REAC"): ["103$Nausea$", "103$Ileus$"],
    ("2024Q2", "OUTC"): ["103$LT"],
    ("2024Q2", "INDI"): ["103$1$Diabetes"],
}

VALID = {"102": "2024Q1", "201": "2024Q1", "301": "2024Q1", "401": "2024Q1", "501": "2024Q1",
         "103": "2024Q2"}
DRUGS = {("102", "semaglutide"), ("201", "metformin"),
         ("301", "insulin glargine\\lixisenatide"), ("401", "metformin"), ("501", "aspirin"),
         ("103", "semaglutide")}
EVENTS = {("102", "Nausea"), ("102", "Vomiting"), ("201", "Nausea"), ("301", "Ileus"),
          ("401", "Headache"), ("501", "Nausea"), ("103", "Nausea"), ("103", "Ileus")}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for (quarter, table), lines in FILES.items():
        folder = root / quarter / "ascii"
        folder.mkdir(parents=True, exist_ok=True)
        name = f"{table}{quarter[2:4]}{quarter[4:]}.txt"
        (folder / name).write_text("\n".join([HEADERS[table], *lines]) + "\n")
    return str(root), delimited.parse_quarters(spark, str(root))


@pytest.fixture(scope="module")
def stored(spark, parsed, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("parquet"))
    for name, df in parsed[1].items():
        tables.write_parquet(df, f"{root}/{name}")
    return tables.scan_parquet(spark, root)


@pytest.fixture(scope="module")
def inputs(stored):
    return stored


def test_discovery(spark, parsed, rows):
    found = delimited.discover_table_files(spark, parsed[0])
    assert rows(found, "table_name", "faers_quarter") == sorted(
        (t, q) for q, t in FILES)
    assert set(parsed[1]) == {"demo", "drug", "reac", "outc", "indi", "rpsr"}


def test_ragged_and_empty_cells(parsed, rows):
    demo = parsed[1]["demo"]
    assert demo.columns[0] == "primaryid" and demo.columns[-1] == "faers_quarter"
    found = {r["primaryid"]: r for r in demo.collect()}
    assert len(found) == 7
    assert found[102]["rept_cod"] == "EXP" and found[102]["caseversion"] == 2
    assert found[401]["rept_cod"] is None and found[301]["sex"] is None
    assert parsed[1]["drug"].filter("drug_seq = '3'").first()["drugname"] == 'ASPIRIN "X\\Y"'
    assert found[103]["faers_quarter"] == "2024Q2" and found[201]["caseversion"] is None


def test_profile(parsed):
    profile = {(r["table_name"], r["faers_quarter"]): r
               for r in delimited.profile_source(parsed[1]).collect()}
    assert profile[("demo", "2024Q1")]["n_rows"] == 6
    assert profile[("drug", "2024Q2")]["n_columns"] == 8
    assert profile[("reac", "2024Q1")]["first_columns"] == ["primaryid", "pt", "drug_rec_act"]


def test_quarter_filter_prunes(spark, stored):
    one = stored["demo"].filter("faers_quarter = '2024Q2'")
    assert "PartitionFilters: [isnotnull" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1


def brute_counts():
    pairs = {}
    for (p, d), (p2, e) in itertools.product(DRUGS, EVENTS):
        if p == p2:
            key = (d, e, VALID[p])
            pairs[key] = pairs.get(key, 0) + 1
    return pairs


@pytest.fixture(scope="module")
def background(inputs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("background"))
    return B.write_background(inputs["demo"], inputs["drug"], inputs["reac"], path)


def test_background(background, inputs, rows):
    lazy = B.build_background(inputs["demo"], inputs["drug"], inputs["reac"])
    want = sorted(((*k, n) for k, n in brute_counts().items()), key=repr)
    for bg in (background, lazy):
        columns = ("drug_key", "event_pt", "faers_quarter", "n_reports")
        assert rows(bg.drug_event_counts, *columns) == want
        assert rows(bg.quarter_totals, "faers_quarter", "n_reports") == [
            ("2024Q1", 5), ("2024Q2", 1)]
        assert rows(bg.drug_totals.filter("faers_quarter = '2024Q1'"), "drug_key", "n_reports") == [
            ("aspirin", 1), ("insulin glargine\\lixisenatide", 1), ("metformin", 2),
            ("semaglutide", 1)]
        assert rows(bg.event_totals.filter("faers_quarter = '2024Q1'"), "event_pt", "n_reports") \
            == [("Headache", 1), ("Ileus", 1), ("Nausea", 3), ("Vomiting", 1)]


def test_background_can_be_rerun(background, inputs, spark, tmp_path):
    path = str(tmp_path)
    for _ in range(2):
        again = B.write_background(inputs["demo"], inputs["drug"], inputs["reac"], path)
    assert again.drug_event_counts.count() == len(brute_counts())
    second = inputs["demo"].filter("faers_quarter = '2024Q2'")
    B.write_background(second, inputs["drug"], inputs["reac"], path)
    assert B.read_background(spark, path).drug_event_counts.count() == len(brute_counts())


def cells_by_hand(drug, event, quarters=None):
    valid = {p for p, q in VALID.items() if not quarters or q in quarters}
    with_drug = {p for p, d in DRUGS if d == drug} & valid
    with_event = {p for p, e in EVENTS if e == event} & valid
    a = len(with_drug & with_event)
    return (a, len(with_drug) - a, len(with_event) - a, len(valid - with_drug - with_event))


def test_cells_of_every_pair(spark, background, rows):
    drugs = sorted({d for _, d in DRUGS} | {"never"})
    events = sorted({e for _, e in EVENTS} | {"never"})
    pairs = spark.createDataFrame(list(itertools.product(drugs, events)),
                                  "drug_key string, event_pt string")
    for quarters in (None, ["2024Q1"], ["2024Q2"], ["2030Q1"]):
        found = G.contingency(background, pairs, quarters)
        assert rows(found, "drug_key", "event_pt", "a", "b", "c", "d") == sorted(
            ((d, e, *cells_by_hand(d, e, quarters)) for d in drugs for e in events), key=repr)


def test_scan_compare_and_single_pair_agree(background, rows):
    scan = G.scan_signals(background, ["semaglutide"], min_cases=1)
    scanned = {r["event_pt"]: r for r in scan.collect()}
    assert set(scanned) == {"Nausea", "Vomiting", "Ileus"}
    events = ["Ileus", "Nausea", "never"]
    compared = G.compare_drugs(background, ["semaglutide", "never"], events).collect()
    assert [(r["drug_key"], r["event_pt"]) for r in compared] == [
        (d, e) for d in ("semaglutide", "never") for e in events]
    for row in compared[:2]:
        assert row["ror"] == scanned[row["event_pt"]]["ror"]
        assert row["a"] == scanned[row["event_pt"]]["a"]
    one = G.compute_signal(background, "semaglutide", "Ileus").first()
    assert one["ic"] == scanned["Ileus"]["ic"]
    unknown = compared[3]
    assert unknown["a"] == 0 and not unknown["is_signal_ema"] and not unknown["is_signal_bcpnn"]


def test_empty_scan_keeps_its_columns(background):
    empty = G.scan_signals(background, ["never"])
    assert empty.columns == G.SIGNAL_COLUMNS and empty.count() == 0
    quarter = G.scan_signals(background, quarters=["2024Q2"], min_cases=1)
    assert {r["a"] for r in quarter.collect()} == {1}


def test_stored_signals_with_live_answer(spark, background, tmp_path, rows):
    path = str(tmp_path / "signals")
    for _ in range(2):
        stored = G.precompute_signals(background, ["semaglutide"], path, min_cases=1)
    assert stored.count() == 3
    both = G.precomputed_or_live(stored, background, ["semaglutide", "metformin"], 1)
    assert rows(both, "drug_key", "event_pt") == [
        ("metformin", "Headache"), ("metformin", "Nausea"), ("semaglutide", "Ileus"),
        ("semaglutide", "Nausea"), ("semaglutide", "Vomiting")]
    marked = stored.withColumn("prr", F.lit(-1.0))
    kept = G.precomputed_or_live(marked, background, ["semaglutide"], 1)
    assert {r["prr"] for r in kept.collect()} == {-1.0}
    shown = G.signal_explorer(stored, background, "semaglutide", 1)
    assert shown["counts"].first()["n_scanned"] == 3
    with pytest.raises(ValueError):
        G.detect_signals(stored, background, "semaglutide", min_cases=2)
    with pytest.raises(ValueError):
        G.detect_signals(stored, background, "semaglutide", top_n=51)
    with pytest.raises(ValueError):
        G.compare_drugs(background, ["semaglutide"], ["Nausea"])
    assert G.detect_signals(stored, background, "semaglutide", 3).columns == G.TOOL_COLUMNS


@pytest.fixture(scope="module")
def cohort(spark, inputs, tmp_path_factory):
    return H.write_cohort(**inputs, dictionary=inline_dictionary(spark),
                          path=str(tmp_path_factory.mktemp("cohort")))


def test_cohort(cohort, inputs, spark, rows):
    lazy = H.build_cohort(**inputs, dictionary=inline_dictionary(spark))
    for c in (cohort, lazy):
        assert rows(c.ids, "primaryid") == [(102,), (103,), (201,), (301,)]
        reports = {r["primaryid"]: r for r in c.reports.collect()}
        assert set(reports) == {102, 103, 201, 301}
        assert reports[201]["age"] == 60.0 and reports[301]["age"] is None
        assert reports[102]["event_dt"] is None and str(reports[102]["fda_dt"]) == "2024-01-06"
        assert reports[201]["occur_country"] == "GB" and reports[201]["serious"] is False
        assert rows(c.drugs, "primaryid", "drug_seq", "is_glp1", "dose_amt") == sorted([
            (102, 1, True, 1.0), (102, 2, True, None), (102, 3, False, 100.0),
            (103, 1, True, 1.0), (201, 1, False, 500.0), (201, 2, True, None),
            (301, 1, True, 1.0)], key=repr)
        assert c.reactions.count() == 3 + 2 + 1 + 1
        assert rows(c.indications) == sorted(
            [(102, 1, "Diabetes"), (103, 1, "Diabetes"), (301, None, "Obesity")], key=repr)
        assert c.outcomes.count() == 5


def test_cohort_figures(cohort, rows):
    assert tuple(D.cohort_overview(cohort).first()) == (4, 5, 7, 3, 3)
    assert rows(D.reports_by_quarter(cohort.reports)) == [("2024Q1", 3), ("2024Q2", 1)]
    assert rows(D.demographics(cohort.reports)) == [
        ("40-59", "F", 2), ("60-74", "M", 1), ("Unknown", "Unknown", 1)]
    wide = D.demographics_pivot(D.demographics(cohort.reports), ["F", "M", "Unknown"])
    assert rows(wide) == [("40-59", 2, 0, 0), ("60-74", 0, 1, 0), ("Unknown", 0, 0, 1)]
    assert D.demographics_pivot(D.demographics(cohort.reports)).columns == [
        "age_group", "F", "M", "Unknown"]
    top = D.drug_distribution(cohort.drugs).collect()
    assert tuple(top[0]) == ("OZEMPIC", 2)


def test_cohort_events(cohort, rows, spark):
    def events(**filters):
        return rows(D.query_cohort_events(cohort, **filters))

    assert events() == [("Ileus", 2), ("Nausea", 3), ("Vomiting", 1)]
    assert events(drug_key="OZEMP%") == [("Ileus", 1), ("Nausea", 2), ("Vomiting", 1)]
    assert events(drug_key="aspirin") == []
    assert events(event_pts=["Ileus"]) == [("Ileus", 2)]
    assert events(event_pts=spark.createDataFrame([("Ileus",)], "pt string")) == [("Ileus", 2)]
    assert events(age_min=50) == [("Nausea", 1)]
    assert events(age_max=50, sex="F") == [("Ileus", 1), ("Nausea", 2), ("Vomiting", 1)]
    assert events(serious_only=True) == [("Ileus", 2), ("Nausea", 2), ("Vomiting", 1)]
    assert events(top_n=1) == [("Nausea", 3)]
    with pytest.raises(ValueError):
        D.query_cohort_events(cohort, top_n=0)


def test_star_join_counts_repeats(cohort):
    joined = D.star_join(cohort.reports.select("primaryid"),
                         cohort.drugs.select("primaryid", "drugname"),
                         cohort.reactions.select("primaryid", "pt"))
    assert joined.agg(F.sum("n_rows")).first()[0] == 3 * 3 + 2 + 2 + 1


def test_row_counts(cohort, inputs, rows):
    from oddspark.operators.dedupe import valid_reports

    counts = dict(rows(H.load_row_counts(
        inputs["demo"], inputs["drug"], cohort, valid_reports(inputs["demo"]))))
    assert counts["demo_read"] == 7 and counts["demo_deduplicated"] == 6
    assert counts["drugs"] == 7 and counts["cohort_ids"] == 4
