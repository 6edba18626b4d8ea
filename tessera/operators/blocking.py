"""Candidate pairs from shared keys: exact name, acronym, rare word, number, name prefix.

An entity is a normalised row with entity_id, src and ord; (src, ord) is the
order of arrival.  Keys are long tables (entity_id, src, ord, country, key_type,
key), so every block is one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.text import prefix5
from tessera.sources.shared import settle, spread_tasks

#: Lists of more ids than this go to every task.
LONG_LIST = 1000


def key_table(df: DataFrame, types: tuple[str, ...] = ("exact", "acr", "tok", "num", "pfx")) -> DataFrame:
    """One row for each key of each entity; a repeated word or number of a row stays repeated."""
    keys: dict[str, Column] = {
        "exact": F.array("name_basic"),
        "acr": F.when(F.length("name_acronym") >= 2, F.array("name_acronym")),
        "tok": F.col("name_tokens"),
        "num": F.filter("numeric_tokens", lambda t: F.length(t) >= 3),
        "pfx": F.when(F.length("name_core") >= 5, F.array(prefix5(F.col("name_core")))),
    }

    def typed(name: str) -> Column:
        return F.transform(keys[name], lambda k: F.struct(F.lit(name).alias("key_type"), k.alias("key")))

    every = F.flatten(F.array_compact(F.array(*map(typed, types))))
    return df.select("entity_id", "src", "ord", F.col("country_normalized").alias("country"), F.explode(every).alias("k")).select("entity_id", "src", "ord", "country", "k.key_type", "k.key")


def occurrences(keys: DataFrame) -> DataFrame:
    """How often each key stands in ``keys``; repeats inside a row count."""
    return keys.groupBy("key_type", "key").agg(F.count("*").alias("n"))


def rare(keys: DataFrame, counted: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Keys whose count is within the limit of their type; types without one stay."""
    limit = F.coalesce(*[F.when(F.col("key_type") == t, F.lit(n)) for t, n in limits.items()])
    limited = keys.filter(F.col("key_type").isin(*limits))
    return limited.join(counted, ["key_type", "key"]).filter(F.col("n") <= limit).drop("n").unionByName(keys.filter(~F.col("key_type").isin(*limits)).select(limited.columns))


def bucket_cap(keys: DataFrame, cap: int = fixed.BUCKET_ROWS, by: tuple[str, ...] = ("key_type", "key"), order: tuple[str, ...] = ("src", "ord")) -> DataFrame:
    """The first ``cap`` rows of each key's bucket in order of arrival."""
    w = Window.partitionBy(*by).orderBy(*order)
    return keys.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap).drop("rn")


def purge(keys: DataFrame, most: int = fixed.PURGE_IDS, by: tuple[str, ...] = ("country", "key_type", "key"), entity: str = "entity_id") -> DataFrame:
    """Keys that more than ``most`` different entities have are dropped."""
    counted = keys.groupBy(*by).agg(F.countDistinct(entity).alias("ids")).filter(F.col("ids") <= most).drop("ids")
    return keys.join(counted, list(by), "left_semi")


def inverted_index(keys: DataFrame, by: tuple[str, ...] = ("country", "key_type", "key")) -> DataFrame:
    """(by, entity_ids): the different entities of each key in order of arrival, for reports; joins use the long table."""
    return keys.groupBy(*by).agg(F.transform(F.array_sort(F.collect_set(F.struct("src", "ord", F.col("entity_id").alias("id")))), lambda x: x["id"]).alias("entity_ids"))


def pairs(query: DataFrame, index: DataFrame, same_country: bool = True) -> DataFrame:
    """(s1_id, c_id, src, ord) of entities that share a key; each pair once."""
    on = ["key_type", "key", *(["country"] if same_country else [])]
    q = query.select(*on, F.col("entity_id").alias("s1_id")).distinct()
    return q.join(index.select(*on, F.col("entity_id").alias("c_id"), "src", "ord"), on).select("s1_id", "c_id", "src", "ord").distinct()


def structural_lookup(query: DataFrame, index: DataFrame, same_country: bool = True) -> DataFrame:
    """Pairs by rare word, rare number, acronym or prefix; buckets hold their first 200 rows.

    Rarity counts a country's index rows, as the index is built a country at a time.
    Entities with a blank country have no pairs.
    """
    query, index = query.filter("country_normalized <> ''"), index.filter("country_normalized <> ''")
    keys = key_table(index, ("acr", "tok", "num", "pfx"))
    counted = keys.filter("key_type IN ('tok', 'num')").groupBy("country", "key_type", "key").agg(F.count("*").alias("n"))
    counted = counted.filter(((F.col("key_type") == "tok") & (F.col("n") <= fixed.RARE_TOKEN_INDEX)) | ((F.col("key_type") == "num") & (F.col("n") <= fixed.RARE_NUMBER_INDEX))).drop("n")
    on = ["country", "key_type", "key"]
    kept = keys.filter("key_type IN ('acr', 'pfx')").unionByName(keys.filter("key_type IN ('tok', 'num')").join(counted, on, "left_semi").select(keys.columns))
    return pairs(key_table(query, ("acr", "tok", "num", "pfx")), bucket_cap(kept, by=tuple(on)), same_country)


def running_frequency(index: DataFrame) -> DataFrame:
    """Word keys of the index whose running count in their country, up to and with their own row, is at most 500.

    A row counts one at least, so only a word's first 500 rows can pass: each
    task keeps that many of a frequent word before they meet.
    """
    words = key_table(index, ("tok",))
    per_row = words.groupBy("country", "key_type", "key", "entity_id", "src", "ord").agg(F.count("*").alias("n"))
    w = Window.partitionBy("country", "key").orderBy("src", "ord")
    first = per_row.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= fixed.RARE_RUNNING)
    return first.withColumn("seen", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter(F.col("seen") <= fixed.RARE_RUNNING).drop("n", "seen", "place")


def streamed_structural(query: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of the streamed stage: running word frequency; a query entity's own country does not matter, but the index holds only countries that some query entity has."""
    places = query.filter("country_normalized <> ''").select("country_normalized").distinct()
    index = index.join(places, "country_normalized", "left_semi")
    other = key_table(index, ("acr", "num", "pfx"))
    return pairs(key_table(query, ("acr", "tok", "num", "pfx")), other.unionByName(running_frequency(index).select(other.columns)), same_country=False)


def lookup_keys(query: DataFrame) -> DataFrame:
    """The first source's lookup keys: exact name, acronym and rare words of rows with a country, without purged keys."""
    keys = key_table(query, ("exact", "acr", "tok"))
    counted = occurrences(keys.filter("key_type = 'tok'"))
    return purge(rare(keys, counted, {"tok": fixed.RARE_TOKEN_QUERY}).filter("country <> ''"))


def first_arrivals(found: DataFrame, cap: int = fixed.ARRIVALS) -> DataFrame:
    """The first ``cap`` candidates of each entity in order of arrival."""
    w = Window.partitionBy("s1_id").orderBy("src", "ord")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def arrival_candidates(query: DataFrame, index: DataFrame, cap: int = fixed.ARRIVALS) -> DataFrame:
    """(s1_id, c_id, src, ord, rank): the first 50 candidates of each entity by exact name, acronym or rare word."""
    found = pairs(lookup_keys(query), key_table(index.filter("country_normalized <> ''"), ("exact", "acr", "tok")))
    return first_arrivals(found, cap)


def exact_match(query: DataFrame, index: DataFrame, allow_empty: bool = True) -> DataFrame:
    """(s1_id, c_ids) by equal trimmed, lower-cased name and country; entities without a match have none."""
    from tessera.functions.text import country_key, name_key

    keyed = lambda df: df.select("entity_id", "src", "ord", name_key(F.col("business_name")).alias("k_name"), country_key(F.col("country")).alias("k_country"))
    q, x = keyed(query), keyed(index)
    if not allow_empty:
        x = x.filter("k_name <> ''")
    on = ["k_name", "k_country"]
    # each list is made once; pairs are never moved
    lists = settle(x.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "ord", F.col("entity_id").alias("id")))), lambda h: h["id"]).alias("c_ids")))
    long, short = lists.filter(F.size("c_ids") > LONG_LIST), lists.filter(F.size("c_ids") <= LONG_LIST)
    names = F.broadcast(long.select(on))
    keys = q.select("entity_id", *on).withColumn("rows", F.count("*").over(Window.partitionBy("entity_id")))
    one = keys.filter("rows = 1").drop("rows")
    # long lists go to every task, and the entities that have one are spread
    spread = one.join(names, on, "left_semi").repartition(spread_tasks(query.sparkSession), "entity_id").join(F.broadcast(long), on)
    rest = one.join(names, on, "left_anti").join(short, on, "left")
    # repeated ids are one entity with all its rows' lists
    order = x.select(*on, F.struct("src", "ord", F.col("entity_id").alias("id")).alias("hit"))
    more = keys.filter("rows > 1").join(order, on, "left").groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list("hit")), lambda h: h["id"]).alias("c_ids"))
    found = spread.select("entity_id", "c_ids").unionByName(rest.select("entity_id", "c_ids")).unionByName(more)
    return found.select(F.col("entity_id").alias("s1_id"), F.coalesce("c_ids", F.array().cast("array<string>")).alias("c_ids"))
