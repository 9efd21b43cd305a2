"""Grain: which columns are keys and measures, what one row of a table stands for, the backbone of entities, fineness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrigraph.functions import scalars as S
from metrigraph.functions.similarity import name_similarity
from metrigraph.operators.scoring import rank_by

# Words and suffixes that tell kinds of tables, columns and entities.
EVENT_WORDS = ("event", "log", "activity", "clickstream", "telemetry", "sensor", "alert")
TRANSACTION_WORDS = ("transaction", "txn", "payment", "posting", "journal", "line")
TIME_WORDS = ("date", "time", "calendar", "period", "month", "fiscal", "day", "week", "quarter", "year", "timestamp")
LOAD_WORDS = ("staging", "stg", "batch", "load", "etl", "landing", "raw", "archive", "temp", "tmp", "work")
KEY_WORDS = ("key", "identifier", "surrogate", "id", "sk", "pk")
TABLE_WORDS = ("fct", "fact", "dim", "ref", "stg", "v", "vw", "tbl", "agg")
NAME_WORDS = ("fct", "dim", "ref", "fact", "v", "stg", "tbl")
KEY_SUFFIX = r"_(key|id|sk)$"
NO_MEASURE_SUFFIX = r"_(key|id|code|date|ts|flag)$"
NUMERIC = "number|decimal|numeric|float|double|int|real|money"
DEFAULT_BACKBONE = ("Customer", "Account", "Premise", "Service Point", "Meter")
STAGING, TRANSACTION_RANK, EVENT_RANK, OUTSIDE_RANK = "Staging", 8, 9, 6
MATCH, SURROGATE = 0.9, 0.85


def _has(words: Column, table: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, table)))


def _named(words: Column) -> Column:
    return F.initcap(F.array_join(words, " "))


def is_entity_key(name: Column) -> Column:
    return F.lower(name).rlike(KEY_SUFFIX)


def is_measure_like(name: Column, data_type: Column, primary: Column, foreign: Column) -> Column:
    """A number that is neither key nor code, date or flag."""
    return ~(primary | (F.coalesce(foreign, F.lit("")) != "")) & ~F.lower(name).rlike(NO_MEASURE_SUFFIX) & F.lower(F.coalesce(data_type, F.lit(""))).rlike(NUMERIC)


def entity_of_key(name: Column) -> Column:
    """What a key identifies: its words but those for key, capitalised; empty if none is left."""
    return _named(F.filter(S.tokens(name), lambda w: ~w.isin(*KEY_WORDS)))


def is_load_step(name: Column) -> Column:
    return _has(S.tokens(name), LOAD_WORDS)


def is_time_entity(entity: Column) -> Column:
    return _has(S.tokens(entity), TIME_WORDS)


def is_no_business(grain: Column) -> Column:
    return (grain == STAGING) | is_load_step(grain)


def backbone_chain(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(entity, tables, wins, rank): entities that key a dimension and that at least two fact tables refer to.

    columns: (table_fqn, column, primary_key); tables: (table_fqn, table_name, measure_count). An entity is above
    another if its key travels with the other's more often than the reverse.
    """
    t = tables.where(~is_load_step(F.col("table_name"))).select("table_fqn", (F.col("measure_count") >= 2).alias("fact"))
    keys = columns.where(is_entity_key(F.col("column"))).select("table_fqn", "primary_key", entity_of_key(F.col("column")).alias("entity")).where("entity <> ''").join(t, "table_fqn")
    named = keys.where("not fact and primary_key").where(~is_time_entity(F.col("entity")) & ~is_load_step(F.col("entity"))).select(F.lower("entity").alias("key"), "entity").groupBy("key").agg(F.min("entity").alias("entity"))
    refs = keys.where("fact").select(F.lower("entity").alias("key"), "table_fqn").distinct().join(F.broadcast(named.select("key")), "key", "left_semi")  # entities of one catalog
    sizes = refs.groupBy("key").agg(F.count("*").alias("tables")).where("tables >= 2")
    refs = refs.join(F.broadcast(sizes), "key")
    both = refs.alias("a").join(refs.alias("b"), (F.col("a.table_fqn") == F.col("b.table_fqn")) & (F.col("a.key") != F.col("b.key"))).groupBy(F.col("a.key").alias("key"), F.col("b.key").alias("other"), F.col("a.tables").alias("own"), F.col("b.tables").alias("others")).agg(F.count("*").alias("shared"))
    wins = both.groupBy("key").agg(F.count_if(F.col("shared") / F.col("others") > F.col("shared") / F.col("own")).alias("wins"))
    out = sizes.join(wins, "key", "left").join(named, "key").select("entity", "tables", F.coalesce("wins", F.lit(0)).alias("wins"), "key")
    return rank_by(out, F.struct("wins", "tables"), "key").drop("key")


def backbone(columns: DataFrame, tables: DataFrame, declared: tuple[str, ...] = ()) -> tuple[list[str], str]:
    """Entities in order, and how they were found: declared, inferred from keys, or the default."""
    if declared:
        return list(declared), "declared"
    found = [r["entity"] for r in backbone_chain(columns, tables).orderBy("rank").collect()]  # a handful of entities
    return (found, "inferred") if found else (list(DEFAULT_BACKBONE), "default (no primary-key chain in the catalog)")


def fineness(grain: Column, chain: list[str]) -> Column:
    """Place in the backbone; beyond it transactions and events, below both other entities, unknown 0."""
    at = F.array_position(F.array(*map(F.lit, chain)), grain).cast("int") if chain else F.lit(0)
    return F.when(at > 0, at).when(grain == "Event", EVENT_RANK).when(grain == "Transaction", TRANSACTION_RANK).when(grain == "unknown", 0).otherwise(OUTSIDE_RANK)


def finest(grains: DataFrame, keys: list[str], grain: str, chain: list[str]) -> DataFrame:
    """(keys, grain): the finest known business grain of each group, the first by name on a tie; unknown if none."""
    known = (F.col(grain) != "") & (F.col(grain) != "unknown") & ~is_no_business(F.col(grain))
    best = F.min(F.when(known, F.struct((-fineness(F.col(grain), chain)).alias("f"), F.col(grain).alias("g"))))
    return grains.groupBy(*keys).agg(best.alias("b")).select(*keys, F.coalesce("b.g", F.lit("unknown")).alias("grain"))


def ambiguity(members: DataFrame, key: str, grain: str) -> DataFrame:
    """(key, ambiguity): share of members that aren't at the modal grain; 1 if no grain is known."""
    n = members.groupBy(key, F.coalesce(F.nullif(F.col(grain), F.lit("")), F.lit("unknown")).alias("g")).agg(F.count("*").alias("n"))
    out = n.groupBy(key).agg(F.sum("n").alias("all"), F.max(F.when(F.col("g") != "unknown", F.col("n"))).alias("modal"))
    return out.select(key, F.when(F.col("modal").isNull(), 1.0).otherwise((F.col("all") - F.col("modal")) / F.col("all")).alias("ambiguity"))


def table_grains(columns: DataFrame, tables: DataFrame, chain: list[str]) -> DataFrame:
    """(table_fqn, grain, source) by the first rule that holds: load step, event with a timestamp, primary key,
    finest backbone entity referred to, words of the name, the name itself.

    columns: (table_fqn, column, data_type, primary_key); tables: (table_fqn, table_name, measure_count).
    """
    c = columns.select("table_fqn", "column", F.lower(F.coalesce("data_type", F.lit(""))).alias("type"), "primary_key", entity_of_key(F.col("column")).alias("entity"), is_entity_key(F.col("column")).alias("is_key"))
    match = F.array(*[F.when(name_similarity(F.col("entity"), F.lit(b)) >= MATCH, F.lit(b)) for b in chain]) if chain else F.array().cast("array<string>")
    entities = c.where("entity <> '' and (primary_key or is_key)").select("entity").distinct().withColumn("matched", F.get(F.filter(match, lambda m: m.isNotNull()), 0))
    c = c.join(entities, "entity", "left")
    t = tables.select("table_fqn", "table_name", "measure_count", S.tokens(F.col("table_name")).alias("words"))
    own = _named(F.filter("words", lambda w: ~w.isin(*TABLE_WORDS)))
    pk = F.when(F.col("primary_key") & (F.col("entity") != ""), F.struct("column", "entity", "matched"))
    facts = c.groupBy("table_fqn").agg(
        F.bool_or(F.col("type").contains("timestamp") | F.col("column").endswith("_ts")).alias("stamped"),
        F.bool_or(F.col("primary_key") & is_load_step(F.col("entity"))).alias("loads"),
        F.array_sort(F.collect_list(pk)).alias("keys"),
        F.min(F.when(F.col("is_key") & F.col("matched").isNotNull(), F.struct((-fineness(F.col("matched"), chain)).alias("f"), "matched"))).alias("ref"),
    )
    out = t.join(facts, "table_fqn", "left")
    surrogate = lambda e: (F.col("measure_count") >= 2) & (e["similar"] >= SURROGATE)
    # Similarity of each key with the table's own name, one row a key: a table has few.
    named = out.select("table_fqn", "measure_count", own.alias("own"), F.explode("keys").alias("k")).select("table_fqn", "k.*", name_similarity(F.col("k.entity"), F.col("own")).alias("similar"))
    keyed = named.groupBy("table_fqn").agg(F.array_sort(F.collect_list(F.struct("column", "entity", "matched", "similar"))).alias("named"))
    out = out.join(keyed, "table_fqn", "left")
    usable = F.get(F.filter(F.coalesce("named", F.array().cast("array<struct<column:string,entity:string,matched:string,similar:double>>")), lambda k: k["matched"].isNotNull() | ~surrogate(k)), 0)
    words = F.col("words")
    rest = _named(F.filter(words, lambda w: ~w.isin(*NAME_WORDS)))
    pick = lambda g, s: F.struct(g.alias("grain"), F.lit(s).alias("source"))
    grain = F.coalesce(
        F.when(_has(words, LOAD_WORDS) | F.coalesce("loads", F.lit(False)), pick(F.lit(STAGING), "load step; not inherited by metrics")),
        F.when(F.coalesce("stamped", F.lit(False)) & _has(words, EVENT_WORDS), pick(F.lit("Event"), "timestamp finer than a day")),
        F.when(usable.isNotNull(), pick(F.coalesce(usable["matched"], usable["entity"]), "catalog primary key")),
        F.when(F.col("ref").isNotNull(), pick(F.col("ref.matched"), "foreign key to the backbone")),
        F.when(_has(words, TRANSACTION_WORDS), pick(F.lit("Transaction"), "table name")),
        F.when(_has(words, EVENT_WORDS), pick(F.lit("Event"), "table name")),
        F.when(rest != "", pick(rest, "table name")),
        pick(F.lit("unknown"), "unknown"),
    )
    return out.select("table_fqn", grain.alias("g")).select("table_fqn", "g.grain", "g.source")
