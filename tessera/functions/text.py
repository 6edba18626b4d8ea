"""Normalisation, tokens and n-grams as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fixed import STOP_WORDS


def no_strings() -> Column:
    return F.array().cast("array<string>")


def clean_text(c: Column) -> Column:
    """Lower-case; every run outside a-z and 0-9 becomes one space; trimmed.  Null gives an empty string."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(""))


def tokens(c: Column) -> Column:
    """The words of a cleaned text; none for an empty one."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def core_tokens(words: Column) -> Column:
    """Words without business stop words; all of them if nothing else is left."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    core = F.filter(words, lambda t: ~F.array_contains(stop, t))
    return F.when(F.size(core) == 0, words).otherwise(core)


def acronym(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")


def numeric_tokens(c: Column) -> Column:
    """Runs of decimal digits of any script, in order, repeats kept."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\p{Nd}+)"), F.lit(1))


def country_key(c: Column) -> Column:
    """Lower-cased without white space of any kind at its ends."""
    return F.coalesce(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), F.lit(""))


name_key = country_key


def normalize(df: DataFrame) -> DataFrame:
    """``df`` with every normalised column of its business_name, business_address and country."""
    out = df.withColumns({"name_raw": F.coalesce("business_name", F.lit("")), "address_raw": F.coalesce("business_address", F.lit("")), "country_raw": F.coalesce("country", F.lit(""))})
    out = out.withColumns({"name_basic": clean_text(F.col("name_raw")), "address_basic": clean_text(F.col("address_raw")), "country_normalized": country_key(F.col("country_raw")), "numeric_tokens": numeric_tokens(F.concat_ws(" ", "name_raw", "address_raw"))})
    out = out.withColumns({"name_tokens": core_tokens(tokens(F.col("name_basic"))), "address_tokens": tokens(F.col("address_basic"))})
    return out.withColumns({"name_core": F.array_join("name_tokens", " "), "name_acronym": acronym(F.col("name_tokens"))})


def search_text() -> Column:
    """What the n-gram retrievers look at."""
    return F.concat_ws(" ", "name_basic", "address_basic")


def lexical_text() -> Column:
    """What the BM25 retriever looks at."""
    return F.concat_ws(" ", "name_basic", "address_basic", F.array_join("numeric_tokens", " "), "country_normalized")


def dense_text() -> Column:
    """What an embedding model looks at."""
    return F.concat_ws(" ", "name_basic", "address_basic", "country_normalized")


def prefix5(c: Column) -> Column:
    return F.when(F.length(c) >= 5, F.substring(c, 1, 5))


def char_grams(c: Column) -> Column:
    """3- and 4-grams inside each word padded with a space on both sides; a padded word of three characters gives one gram."""

    def of_word(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        three = F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))
        four = F.when(F.length(p) > 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 3, F.lit(1))), lambda i: F.substr(p, i, F.lit(4)))).otherwise(no_strings())
        return F.concat(three, four)

    return F.flatten(F.transform(tokens(c), of_word))


def word_grams(c: Column) -> Column:
    """Words of two characters or more and pairs of neighbouring ones."""
    words = F.filter(tokens(c), lambda t: F.length(t) >= 2)
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))).otherwise(no_strings())
    return F.concat(words, pairs)
