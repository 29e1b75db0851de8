"""Product names: cleaning, and recognition of the members of a drug class."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark import fixed_values as V


def normalize_drug_name(name: Column) -> Column:
    """Lower case, without parentheses, dosage and formulation words; null when nothing is left.

    The spaces at both ends go with the last two steps: no earlier step looks at them.
    """
    text = F.lower(name)
    for pattern in (V.NAME_PARENTHESES, V.NAME_DOSAGE, V.NAME_FORMULATION):
        text = F.regexp_replace(text, pattern, "")
    return F.nullif(F.trim(F.regexp_replace(text, V.NAME_SPACES, " ")), F.lit(""))


def coalesce_nonempty(first: Column, second: Column) -> Column:
    """``first`` unless it is null or empty, else ``second``."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def drug_key(prod_ai: Column, drugname: Column) -> Column:
    """The key under which a product is counted: the cleaned ingredient, else the cleaned name."""
    return normalize_drug_name(coalesce_nonempty(prod_ai, drugname))


def build_matcher(dictionary: DataFrame) -> DataFrame:
    """Name variants of a class dictionary: ``variant, active, dict_pos, name_pos``.

    The ingredient stands first and keeps its case; brands follow in lower case. A variant named
    twice keeps its first position and takes the last ingredient.
    """
    variants = dictionary.select(
        "active_ingredient",
        F.col("position").alias("dict_pos"),
        F.posexplode(
            F.concat(
                F.array("active_ingredient"),
                F.transform(F.coalesce("brand_names", F.array().cast("array<string>")), F.lower),
            )
        ).alias("name_pos", "variant"),
    )
    place = F.struct("dict_pos", "name_pos")
    return (
        variants.groupBy("variant")
        .agg(F.max_by("active_ingredient", place).alias("active"), F.min(place).alias("place"))
        .select("variant", "active", "place.dict_pos", "place.name_pos")
    )


def first_variant_in(name: Column, variants: list[tuple[str, str]]) -> Column:
    """The ingredient of the first of ``variants`` (variant, active) contained in ``name``."""
    hit = F.lit(None).cast("string")
    for variant, active in reversed(variants):
        hit = F.when(F.contains(name, F.lit(variant)), F.lit(active)).otherwise(hit)
    return hit
