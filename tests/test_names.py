import random

from pyspark.sql import functions as F

from oddspark import fixed_values as V
from oddspark.functions import names as N
from oddspark.operators.matching import (
    add_class_member,
    add_member_by_name,
    class_names,
    gram_length,
    gram_postings,
    matched_names,
    with_grams,
)
from oddspark.sources.fixtures import inline_dictionary, list_dictionary

CLEANED = {
    "OZEMPIC 1 MG": "ozempic",
    "Semaglutide inj.": "semaglutide .",
    "WEGOVY (SEMAGLUTIDE)": "wegovy",
    "ozempic 1mg pen": "ozempic pen",
    "GLUCOSE 5% SOLUTION": "glucose 5%",
    "5%x": "x",
    "INSULIN GLARGINE\\LIXISENATIDE": "insulin glargine\\lixisenatide",
    "ozempic (1 (2) mg)": "ozempic mg)",
    "1.5 MG/ML sol": "/ml",
    "1,000 UNITS heparin": "1, heparin",
    "(X)": None,
    "": None,
    "   ": None,
    " Ozempic ": "ozempic",
    "ÉCLAIR er CREAM": "éclair",
}


def test_cleaned_names(spark):
    df = spark.createDataFrame([(n,) for n in CLEANED] + [(None,)], "n string")
    found = {r[0]: r[1] for r in df.select("n", N.normalize_drug_name(F.col("n"))).collect()}
    assert found == {**CLEANED, None: None}


def test_formulation_words_are_found_as_without_the_first_letter_check(spark):
    words = "injection inj tablet tab capsule cap solution sol suspension susp cream ointment " \
            "patch xr er sr cr er. xer érx sol-x tabs éer cŕ x".split()
    rng = random.Random(3)
    texts = ["".join(rng.choice(words) + rng.choice([" ", "-", "", "é", "_"]) for _ in range(6))
             for _ in range(2000)]
    plain = V.NAME_FORMULATION.replace("(?=[itcsopxe])", "")
    assert plain != V.NAME_FORMULATION
    differ = spark.createDataFrame([(t,) for t in texts], "t string").filter(
        F.regexp_replace("t", V.NAME_FORMULATION, "") != F.regexp_replace("t", plain, "")
    )
    assert differ.count() == 0


def test_drug_key_prefers_a_nonempty_ingredient(spark):
    df = spark.createDataFrame(
        [("SEMAGLUTIDE", "Ozempic"), ("", "Ozempic 1 mg"), (None, "WEGOVY"), (None, None)],
        "prod_ai string, drugname string",
    )
    keys = [r[0] for r in df.select(N.drug_key(F.col("prod_ai"), F.col("drugname"))).collect()]
    assert keys == ["semaglutide", "ozempic", "wegovy", None]


def test_matcher_of_the_class(spark):
    matcher = N.build_matcher(inline_dictionary(spark))
    assert matcher.count() == 19
    first = matcher.orderBy("dict_pos", "name_pos").first()
    assert (first["variant"], first["active"]) == ("semaglutide", "semaglutide")


def test_repeated_variant_keeps_place_and_takes_the_last_ingredient(spark, rows):
    members = [("Alpha", ["ONE"], "x"), ("Beta", ["two", "one"], "y")]
    matcher = N.build_matcher(inline_dictionary(spark, members))
    assert rows(matcher) == sorted(
        [("Alpha", "Alpha", 0, 0), ("Beta", "Beta", 1, 0), ("one", "Beta", 0, 1),
         ("two", "Beta", 1, 1)], key=repr)


MENTIONS = [
    (1, "OZEMPIC 1 MG", None, "semaglutide"),
    (2, "insulin glargine / lixisenatide", "x", "lixisenatide"),
    (3, "unknown", "TIRZEPATIDE", "tirzepatide"),
    (4, "Soliqua with Victoza", None, "liraglutide"),
    (5, None, "Bydureon", "exenatide"),
    (6, "aspirin", "acetylsalicylic acid", None),
    (7, None, None, None),
    (8, "(ozempic)", "byetta", "exenatide"),
    (9, "mounjaro", "ozempic", "tirzepatide"),
]


def test_members_inline_and_joined(spark, rows):
    drug = spark.createDataFrame([m[:3] for m in MENTIONS],
                                 "primaryid long, drugname string, prod_ai string")
    matcher = N.build_matcher(inline_dictionary(spark))
    want = sorted(((m[0], m[3]) for m in MENTIONS), key=repr)
    for inline in (200, 0):
        flagged = add_class_member(drug, matcher, inline)
        assert flagged.columns == ["primaryid", "drugname", "prod_ai", "active_ingredient"]
        assert rows(flagged, "primaryid", "active_ingredient") == want
        by_name = add_member_by_name(drug, class_names(drug, matcher, inline))
        assert by_name.columns == flagged.columns
        assert rows(by_name, "primaryid", "active_ingredient") == want


def test_substring_join_agrees_with_containment(spark, rows):
    rng = random.Random(5)
    names = list({"".join(rng.choice("ab c") for _ in range(rng.randint(0, 9)))
                  for _ in range(200)})
    variants = ["ab", "ba", "c a", "aaa", "b", "abc", "zz"]
    matcher = spark.createDataFrame(
        [(v, v.upper(), 0, i) for i, v in enumerate(variants)],
        "variant string, active string, dict_pos int, name_pos int",
    )
    want = {n: next((v.upper() for v in variants if v in n), None) for n in names}
    found = matched_names(spark.createDataFrame([(n,) for n in names], "name string"), matcher)
    assert rows(found, "name", "active") == sorted(
        ((n, a) for n, a in want.items() if a), key=repr)


def test_dictionary_listing(spark):
    listed = [r[0] for r in list_dictionary(inline_dictionary(spark)).collect()]
    assert listed == ["dulaglutide", "exenatide", "liraglutide", "lixisenatide", "semaglutide",
                      "tirzepatide"]


def test_postings_find_what_containment_finds_at_any_size(spark, rows):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcd éß") for _ in range(n))
    names = sorted({text(rng.randint(0, 14)) for _ in range(300)})
    for n_variants, shortest, gram in ((0, 1, 4), (3, 5, 4), (400, 2, 4), (400, 0, 3), (60, 4, 2)):
        variants = sorted({text(rng.randint(shortest, 6)) for _ in range(n_variants)})
        rng.shuffle(variants)
        matcher = spark.createDataFrame(
            [(v, f"active {i}", i // 3, i % 3) for i, v in enumerate(variants)],
            "variant string, active string, dict_pos int, name_pos int")
        found = matched_names(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), matcher, gram)
        first = {n: next((f"active {i}" for i, v in enumerate(variants) if v in n), None) for n in names}
        assert rows(found, "name", "active") == sorted(((n, a) for n, a in first.items() if a), key=repr)


def test_a_name_makes_no_more_rows_than_letters_and_a_variant_one(spark):
    length = gram_length(spark.sql("SELECT 'semaglutide' AS variant"))
    for name in ("", "abc", "abcd", "insulin glargine"):
        n = with_grams(spark.createDataFrame([(name,)], "t string"), "t", length).count()
        assert n == max(0, len(name) - 3) <= len(name)
    matcher = N.build_matcher(inline_dictionary(spark))
    posted = gram_postings(matcher).collect()
    assert len(posted) == matcher.count() == len({r["variant"] for r in posted})
    assert all(r["variant"][r["into"]:].startswith(r["gram"]) and len(r["gram"]) == 4 for r in posted)
