"""Recognition of class members in free-text product names, by postings of letter groups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.functions.names import normalize_drug_name

#: Letters of a group. A dictionary with a shorter variant has shorter groups.
GRAM = 4


def add_class_member(drug: DataFrame, matcher: DataFrame, gram: int = GRAM) -> DataFrame:
    """Add ``active_ingredient``: the class member named by ``drugname``, else by ``prod_ai``.

    A name matches when it contains a variant; of several the first in dictionary order wins.
    """
    return add_member_by_product(drug, class_products(drug, matcher, gram))


def class_products(drug: DataFrame, matcher: DataFrame, gram: int = GRAM) -> DataFrame:
    """The distinct pairs of raw names in ``drug`` that name a class member: ``drugname, prod_ai, active_ingredient``."""
    pairs = drug.select("drugname", "prod_ai").distinct()
    return add_member_by_name(pairs, class_names(pairs, matcher, gram)).filter("active_ingredient is not null")


def add_member_by_product(drug: DataFrame, products: DataFrame) -> DataFrame:
    """``add_class_member`` by equality with the pairs found by ``class_products``.

    Rows are joined once, on both names. An empty or missing ingredient, which a large part of all rows may
    share, is no key of its own, so these rows don't meet in one task.
    """
    known = products.select(*[F.col(c).alias(f"_{c}") for c in ("drugname", "prod_ai")], "active_ingredient")
    same = F.col("drugname").eqNullSafe(F.col("_drugname")) & F.col("prod_ai").eqNullSafe(F.col("_prod_ai"))
    return drug.join(known, same, "left").select(*drug.columns, "active_ingredient")


def class_names(drug: DataFrame, matcher: DataFrame, gram: int = GRAM) -> DataFrame:
    """The raw names in ``drug`` that name a class member: ``name, active``.

    Each distinct name is cleaned and matched once, however many rows carry it. Only names that
    match are kept, so the table is small where the class is a small part of all products.
    """
    raw = drug.select(F.explode(F.array("drugname", "prod_ai")).alias("name"))
    names = raw.filter("name is not null").distinct()
    return _matched(names.withColumn("text", normalize_drug_name(F.col("name"))), matcher, gram)


def add_member_by_name(drug: DataFrame, names: DataFrame) -> DataFrame:
    """``add_class_member`` by equality with the names found by ``class_names``.

    For names that are stored the planner knows their size, and broadcasts them or not accordingly.
    """
    def lookup(column: str, found: str) -> DataFrame:
        return names.select(F.col("name").alias(column), F.col("active").alias(found))

    return (
        drug.join(lookup("drugname", "_by_name"), "drugname", "left")
        .join(lookup("prod_ai", "_by_ai"), "prod_ai", "left")
        .withColumn("active_ingredient", F.coalesce("_by_name", "_by_ai"))
        .select(*drug.columns, "active_ingredient")
    )


def matched_names(names: DataFrame, matcher: DataFrame, gram: int = GRAM) -> DataFrame:
    """Distinct names that contain a variant, with the ingredient of the first: ``name, active``."""
    return _matched(names.select("name", F.col("name").alias("text")), matcher, gram)


def gram_length(matcher: DataFrame, gram: int = GRAM) -> Column:
    """How many letters a group has: ``gram``, or as many as the shortest variant. A scalar subquery."""
    shortest = matcher.filter("variant <> ''").agg(F.min(F.length("variant"))).scalar()
    return F.greatest(F.lit(1), F.least(F.lit(gram), shortest))


def with_grams(df: DataFrame, text: str, length: Column) -> DataFrame:
    """A row ``at, gram`` for every group of letters of a text, so at most one for each letter."""
    starts = F.when(F.length(text) >= F.col("_length"), F.sequence(F.lit(1), F.length(text) - F.col("_length") + 1))
    placed = df.withColumn("_length", length).withColumn("at", F.explode(starts))
    return placed.withColumn("gram", F.col(text).substr(F.col("at"), F.col("_length"))).drop("_length")


def gram_postings(matcher: DataFrame, gram: int = GRAM) -> DataFrame:
    """The inverted index of a dictionary: ``gram, into, variant, active, place``.

    Every variant is posted under one of its groups, the one that the fewest variants hold, with how far
    into the variant it stands. A name that contains the variant contains that group.
    """
    variants = matcher.filter("variant <> ''").select(
        "variant", "active", F.struct("dict_pos", "name_pos").alias("place"))
    found = with_grams(variants, "variant", gram_length(matcher, gram))
    shared = found.groupBy("gram").agg(F.count_distinct("variant").alias("n_variants"))
    rarest = F.min(F.struct("n_variants", "at", "gram")).alias("rarest")
    return found.join(shared, "gram").groupBy("variant", "active", "place").agg(rarest).select(
        F.col("rarest.gram").alias("gram"), (F.col("rarest.at") - 1).alias("into"), "variant", "active", "place")


def _matched(names: DataFrame, matcher: DataFrame, gram: int) -> DataFrame:
    """``name, active`` for the names whose ``text`` contains a variant; the first in dictionary order wins.

    Names meet the postings by their groups of letters, and what is posted there is verified in
    its place. So a name of n letters makes at most n rows at any size of the dictionary, and no
    variant travels to the driver. An empty variant is contained in every text.
    """
    pieces = with_grams(names.select("name", "text"), "text", gram_length(matcher, gram))
    start = F.col("at") - F.col("into")
    in_place = (start >= 1) & (F.col("text").substr(start, F.length("variant")) == F.col("variant"))
    found = pieces.join(gram_postings(matcher, gram), "gram").filter(in_place)
    everywhere = matcher.filter("variant = ''").select(
        F.struct(F.struct("dict_pos", "name_pos").alias("place"), "active").alias("hit"))
    anyway = names.filter("text is not null").select(
        "name", everywhere.agg(F.min("hit")).scalar().alias("hit")).filter("hit is not null")
    hits = found.select("name", F.struct("place", "active").alias("hit")).unionByName(anyway)
    return hits.groupBy("name").agg(F.min("hit").alias("hit")).select("name", F.col("hit.active").alias("active"))
