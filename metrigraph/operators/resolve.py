"""Entity resolution: the cascade of rules that binds a metric's reference to a catalog column.

References are resolved once for each distinct spelling. Every rule is an equi-join on a key of the catalog; rules
that compare names see only what the exact rules left, within the reference's own table. Where several columns fit,
the last by name wins for full names and keys, the first for table.column, as a later row replaces an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrigraph.functions.scalars import normalize_identifier, token_key, tokens
from metrigraph.functions.similarity import blend, token_similarity, token_vector
from metrigraph.storage import together

CONFIDENCE = {"ER-0": 1.0, "ER-1": 1.0, "ER-2": 0.95, "ER-3": 0.90, "ER-4": 0.80, "ER-5": 0.70, "ER-6": 0.60}
FUZZY, EMBEDDED, NEAREST, PROBABLE = 0.92, 0.85, 0.6, 0.80
REF = ("source_system", "database", "schema", "table", "column", "query_item", "kpi_label", "tool", "storage_mode")


def _key(*parts: str) -> Column:
    return normalize_identifier(F.concat_ws(".", *[F.coalesce(F.col(f"`{p}`"), F.lit("")) for p in parts]))


def _catalog(columns: DataFrame) -> DataFrame:
    return columns.select(
        "column_fqn", "table_fqn", "definition", "business_term", F.col("column").alias("name"), normalize_identifier(F.col("column_fqn")).alias("k_fqn"), _key("schema").alias("k_schema"), _key("table").alias("k_table"), _key("column").alias("k_column"),
        token_key(F.col("column")).alias("k_tokens"), token_key(F.col("business_term")).alias("k_term"), tokens(F.col("column")).alias("name_words"), tokens(_texts("column", "business_term", "definition")).alias("words"),
    ).withColumn("vector", token_vector(F.col("words")))


def _texts(*cs: str) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(x), F.lit("")) for x in cs])


def resolve(refs: DataFrame, columns: DataFrame, lineage: DataFrame, manual: DataFrame | None = None, keep=lambda df: df) -> DataFrame:
    """refs (with REF) and (column_fqn, er_rule, confidence, reason, nearest) of each.

    columns, lineage: typed extracts; manual: (raw_reference, column_fqn) confirmed by reviewers, which outrank every rule.
    reason says why nothing was found; nearest is the best column or table short of a threshold.
    keep: stores the tables that several rules read (distinct references, keyed catalog, what each step leaves).
    """
    r = refs.select(*REF).distinct()
    r = r.select("*", F.xxhash64(*REF).alias("ref"), _key("source_system", "database", "schema", "table", "column").alias("k_fqn"), _key("schema").alias("k_schema"), _key("table").alias("k_table"), _key("column").alias("k_column"), token_key(F.col("column")).alias("k_alias"), token_key(F.col("query_item")).alias("k_item"))
    own = F.concat_ws(" ", F.coalesce(F.nullif(F.col("query_item"), F.lit("")), F.col("column")), F.nullif(F.col("kpi_label"), F.lit("")))
    r = r.withColumn("own_name_words", tokens(F.col("column"))).withColumn("own_words", tokens(own))
    r, c = together(keep, r, _catalog(columns))
    there = (F.col("k_table") != "") & (F.col("k_column") != "")
    usable = r.where(there)
    fit = lambda df, rule, rank, table="": df.select("ref", F.lit(rule).alias("rule"), F.lit(rank).alias("rank"), (F.col("table_fqn") if table else F.lit("")).alias("order"), "column_fqn")

    by_fqn = c.groupBy("k_fqn").agg(F.max("column_fqn").alias("column_fqn"))
    by_schema = c.groupBy("k_schema", "k_table", "k_column").agg(F.max("column_fqn").alias("column_fqn"))
    by_table = c.groupBy("k_table", "k_column").agg(F.min("column_fqn").alias("column_fqn"))
    found = fit(usable.join(by_fqn, "k_fqn"), "ER-1", 10).union(fit(usable.join(by_schema, ["k_schema", "k_table", "k_column"]), "ER-1", 11)).union(fit(usable.join(by_table, ["k_table", "k_column"]), "ER-1", 12))
    if manual is not None:
        said = manual.groupBy(normalize_identifier(F.col("raw_reference")).alias("k_fqn")).agg(F.max("column_fqn").alias("column_fqn")).join(columns.select("column_fqn").distinct(), "column_fqn", "left_semi")
        short = said.withColumnRenamed("k_fqn", "k_short")
        found = found.union(fit(usable.join(said, "k_fqn"), "ER-0", 0)).union(fit(usable.withColumn("k_short", _key("table", "column")).join(short, "k_short"), "ER-0", 1))

    aliased = c.groupBy("k_table", "table_fqn", "k_tokens").agg(F.max("column_fqn").alias("column_fqn"))
    for rank, key in ((20, "k_alias"), (21, "k_item")):
        found = found.union(fit(usable.where(F.col(key) != "").join(aliased.withColumnRenamed("k_tokens", key), ["k_table", key]), "ER-2", rank, "t"))

    tables = c.select("k_table", "table_fqn").distinct()
    at = usable.join(tables, "k_table").withColumn("k_target", normalize_identifier(F.concat_ws(".", "table_fqn", "column")))
    edges = lineage.where("level = 'column'").select(normalize_identifier(F.col("tgt_fqn")).alias("k_target"), "src_fqn").groupBy("k_target").agg(F.count("*").alias("n"), F.min("src_fqn").alias("column_fqn")).where("n = 1")
    known = c.select("column_fqn").distinct()
    found = found.union(fit(at.join(edges, "k_target").join(known, "column_fqn", "left_semi"), "ER-3", 30, "t"))
    above = lineage.where("level = 'table'").select(normalize_identifier(F.col("tgt_fqn")).alias("k_tgt"), F.col("src_fqn").alias("above"))
    through = at.withColumn("k_tgt", normalize_identifier(F.col("table_fqn"))).join(above, "k_tgt").withColumn("column_fqn", F.concat_ws(".", "above", "column"))
    found = found.union(fit(through.join(known, "column_fqn", "left_semi"), "ER-3", 31, "t"))
    exact = found.groupBy("ref").agg(F.min(F.struct(F.col("rank").bitwiseAND(~1), "order", "rank", "rule", "column_fqn")).alias("b"))
    exact = keep(exact)

    left = usable.join(exact, "ref", "left_anti").join(c.drop("k_fqn", "k_schema", "k_column"), "k_table")
    left = keep(left.withColumn("own_vector", token_vector(F.col("own_words"))))
    named = left.select("ref", "column_fqn", "table_fqn", token_similarity(F.col("own_name_words"), F.col("name_words")).alias("s")).where(F.col("s") >= FUZZY)
    fuzzy = keep(named.groupBy("ref").agg(F.min(F.struct((-F.col("s")).alias("s"), "column_fqn")).alias("b")).select("ref", "b.column_fqn"))
    left = left.join(fuzzy.select("ref"), "ref", "left_anti")
    termed = left.where("k_term <> ''").select("ref", "table_fqn", "column_fqn", F.when(F.col("k_item") == F.col("k_term"), 0).when(F.col("k_alias") == F.col("k_term"), 1).alias("rank")).where("rank is not null")
    termed = termed.groupBy("ref").agg(F.min(F.struct("table_fqn", "rank", "column_fqn")).alias("b")).select("ref", "b.column_fqn")
    left = left.join(termed.select("ref"), "ref", "left_anti")
    meant = left.select("ref", "column_fqn", blend(F.col("own_vector"), F.col("vector"), F.col("own_words"), F.col("words")).alias("s")).groupBy("ref").agg(F.min(F.struct((-F.col("s")).alias("s"), "column_fqn")).alias("b"))
    meant = meant.select("ref", F.col("b.column_fqn").alias("column_fqn"), (-F.col("b.s")).alias("s"))

    out = r.join(exact.select("ref", F.col("b.column_fqn").alias("x_fqn"), F.col("b.rule").alias("x_rule")), "ref", "left")
    for name, df in (("fuzzy", fuzzy), ("term", termed)):
        out = out.join(df.withColumnRenamed("column_fqn", name), "ref", "left")
    out = out.join(meant.withColumnRenamed("column_fqn", "meant"), "ref", "left").join(tables.select("k_table").distinct().withColumn("known", F.lit(True)), "k_table", "left")
    enough = F.col("s") >= EMBEDDED
    rule = F.coalesce("x_rule", F.when(F.col("fuzzy").isNotNull(), "ER-4"), F.when(F.col("term").isNotNull(), "ER-5"), F.when(enough, "ER-6"))
    reason = (
        F.when(rule.isNotNull(), F.lit(None).cast("string"))
        .when(~there, "MISSING_REFERENCE")
        .when(F.col("known").isNull(), F.when((F.col("tool") == "powerbi") & (F.lower("storage_mode") == "import"), "MODEL_TERMINUS").otherwise("NO_CATALOG_TABLE"))
        .when(F.col("s") > 0, "LOW_CONFIDENCE")
        .otherwise("NO_CATALOG_COLUMN")
    )
    score = F.coalesce(*[F.when(rule == k, F.lit(v)) for k, v in CONFIDENCE.items()])
    out = out.select("ref", F.coalesce("x_fqn", "fuzzy", "term", F.when(enough, F.col("meant"))).alias("column_fqn"), rule.alias("er_rule"), score.alias("confidence"), reason.alias("reason"), F.when(reason == "LOW_CONFIDENCE", F.col("meant")).alias("nearest"))
    return refs.withColumn("ref", F.xxhash64(*REF)).join(out, "ref", "left").drop("ref")


def nearest_table(names: DataFrame, columns: DataFrame) -> DataFrame:
    """(table, nearest, score): the catalog table most like a name that the catalog lacks, from NEAREST on.

    names: (table). Distinct unknown names meet distinct catalog names; lengths and first letters rule most out first.
    """
    wanted = names.select("table").distinct().withColumn("tw", tokens(F.col("table")))
    have = columns.groupBy(F.col("table").alias("name")).agg(F.min("table_fqn").alias("table_fqn")).withColumn("nw", tokens(F.col("name")))
    pairs = wanted.crossJoin(have).select("table", "table_fqn", token_similarity(F.col("tw"), F.col("nw")).alias("score")).where(F.col("score") >= NEAREST)
    best = pairs.groupBy("table").agg(F.min(F.struct((-F.col("score")).alias("s"), "table_fqn")).alias("b"))
    return best.select("table", F.col("b.table_fqn").alias("nearest"), (-F.col("b.s")).alias("score"))


def extend_upstream(resolved: DataFrame, columns: DataFrame, lineage: DataFrame, hops: int = 4) -> DataFrame:
    """resolved (column_fqn, er_rule, confidence, ...) walked up to a system of record.

    While the column's table isn't one, and exactly one upstream column is of one, the walk goes there; the rule becomes
    ER-3 and the confidence at most its.
    """
    record = columns.groupBy("table_fqn").agg(F.bool_or("system_of_record").alias("sor"))
    of = columns.select("column_fqn", "table_fqn").distinct().join(record, "table_fqn").select("column_fqn", "sor")
    up = lineage.where("level = 'column'").select(F.col("tgt_fqn").alias("at"), F.col("src_fqn").alias("column_fqn")).distinct().join(of.where("sor"), "column_fqn")
    up = up.groupBy(normalize_identifier(F.col("at")).alias("at")).agg(F.count("*").alias("n"), F.min("column_fqn").alias("up")).where("n = 1").select("at", "up")
    start = resolved.where("column_fqn is not null").select(F.col("column_fqn").alias("from")).distinct()
    walk = start.select("from", F.col("from").alias("to"))
    for _ in range(hops):
        here = walk.join(of.select(F.col("column_fqn").alias("to"), "sor"), "to", "left").withColumn("at", normalize_identifier(F.col("to"))).join(up, "at", "left")
        walk = here.select("from", F.when(F.coalesce("sor", F.lit(False)) | F.col("up").isNull(), F.col("to")).otherwise(F.col("up")).alias("to"))
    out = resolved.join(walk, F.col("column_fqn") == F.col("from"), "left")
    moved = F.col("to") != F.col("from")
    new = {"column_fqn": F.coalesce("to", "column_fqn"), "er_rule": F.when(moved, "ER-3").otherwise(F.col("er_rule")), "confidence": F.when(moved, F.least(F.col("confidence"), F.lit(CONFIDENCE["ER-3"]))).otherwise(F.col("confidence"))}
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in resolved.columns])


def latest_mappings(mappings: DataFrame) -> DataFrame:
    """(raw_reference, column_fqn): the latest confirmation of each reference; mappings: (mapping_id, raw_reference, column_fqn)."""
    return mappings.groupBy("raw_reference").agg(F.max_by("column_fqn", "mapping_id").alias("column_fqn"))
