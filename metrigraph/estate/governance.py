"""Review: states and transitions, reasons, overrides, decisions as an append-only chained ledger, carry-forward between runs."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from metrigraph.functions import scalars as S

# The state machine, what may be carried to a new run, reasons of each decision, what may be overridden.
STATUS_ORDER = ("Blocked", "Exploratory", "Proposed", "Accepted", "Rejected", "Merged", "Deferred")
TRANSITIONS = {
    ("Proposed", "Accept"): "Accepted", ("Exploratory", "Accept"): "Accepted", ("Deferred", "Accept"): "Accepted",
    ("Exploratory", "AcceptWithException"): "Accepted", ("Deferred", "AcceptWithException"): "Accepted",
    ("Proposed", "Reject"): "Rejected", ("Exploratory", "Reject"): "Rejected", ("Blocked", "Reject"): "Rejected", ("Deferred", "Reject"): "Rejected",
    ("Proposed", "Merge"): "Merged", ("Exploratory", "Merge"): "Merged", ("Blocked", "Merge"): "Merged", ("Deferred", "Merge"): "Merged",
    ("Proposed", "Defer"): "Deferred", ("Exploratory", "Defer"): "Deferred", ("Blocked", "Defer"): "Deferred",
    ("Proposed", "Split"): None, ("Exploratory", "Split"): None, ("Blocked", "Split"): None,
    ("Proposed", "Override"): None, ("Exploratory", "Override"): None, ("Blocked", "Override"): None, ("Deferred", "Override"): None, ("Accepted", "Override"): None,
    ("Accepted", "Reverse"): "Rejected", ("Rejected", "Reverse"): "Proposed", ("Merged", "Reverse"): "Proposed", ("Deferred", "Reverse"): "Proposed",
}
CARRIED = {"Proposed": ("Accepted", "Rejected", "Merged", "Deferred"), "Exploratory": ("Accepted", "Rejected", "Merged", "Deferred"), "Blocked": ("Rejected", "Merged", "Deferred")}
REASONS = {
    "Accept": ("value_clear", "retires_reports", "resolves_conflicts", "strategic", "accept_with_open_dependencies", "other"),
    "AcceptWithException": ("gate_waived", "other"),
    "Reject": ("no_named_consumer", "duplicate_of_existing", "too_small", "wrong_boundary", "source_not_viable", "already_planned", "other"),
    "Merge": ("same_decision", "same_grain_and_sources", "duplicate_candidate", "other"),
    "Split": ("mixed_grain", "mixed_consumers", "scope_too_broad", "other"),
    "Defer": ("awaiting_source_migration", "awaiting_steward", "capacity", "awaiting_privacy", "other"),
    "Override": ("wrong_archetype", "wrong_tier", "wrong_name", "wrong_owner", "wrong_grain", "consumer_confirmed", "decision_critical", "conflict_resolved", "name_accepted", "other"),
    "Reverse": ("decided_in_error", "new_evidence", "consumer_withdrawn", "source_changed", "other"),
    "CarryForward": ("carried_from_previous_run",),
}
OVERRIDES = {
    "archetype": ("Entity Master", "Reference Data", "Event Stream", "Metric / KPI", "Feature Store", "Insight / Recommendation"),
    "tier": ("Source-aligned", "Aggregate", "Consumer-aligned"),
    "name_status": ("AI_DRAFT", "ACCEPTED"),
    **dict.fromkeys(("proposed_name", "grain", "owner_candidate", "steward_candidate", "domain"), ()),
}
LONGEST_VALUE = 200
DECISION = "decision_id long, run_id string, candidate_id string, decision string, reason_code string, note string, reviewer string, previous_status string, new_status string, decided_at string, prev_hash string, row_hash string"


class Refused(ValueError):
    pass


def next_status(status: str, decision: str, carried: str = "") -> str | None:
    """The state a decision leads to; None if it stays."""
    if status not in STATUS_ORDER:
        raise Refused(f"unknown status {status!r}")
    if decision == "CarryForward":
        if carried not in CARRIED.get(status, ()):
            raise Refused(f"{carried!r} can't be carried onto {status}")
        return carried
    if (status, decision) not in TRANSITIONS:
        raise Refused(f"{decision} isn't allowed from {status}: " + ", ".join(sorted(d for s, d in TRANSITIONS if s == status)))
    return TRANSITIONS[status, decision]


def transitions(spark: SparkSession) -> DataFrame:
    """The state machine as rows."""
    rows = [(s, d, t or s) for (s, d), t in TRANSITIONS.items()] + [(s, "CarryForward", t) for s, ts in CARRIED.items() for t in ts]
    return spark.createDataFrame(rows, "from_status string, decision string, to_status string")


def next_statuses(rows: DataFrame) -> DataFrame:
    """rows (status, decision, ...) with new_status; null where the decision isn't allowed."""
    t = F.broadcast(transitions(rows.sparkSession).where("decision <> 'CarryForward'").select(F.col("from_status").alias("status"), "decision", F.col("to_status").alias("new_status")))  # 28 rows
    return rows.join(t, ["status", "decision"], "left")


def validate_reason(decision: str, code: str, note: str = "") -> str:
    """The code, if it is one of the decision's; only Accept may do without, and `other` needs a note."""
    if decision not in REASONS:
        raise Refused(f"unknown decision {decision!r}")
    code = (code or "").strip()
    if not code and decision == "Accept":
        return ""
    if code not in REASONS[decision]:
        raise Refused(f"{decision} needs one of " + ", ".join(REASONS[decision]))
    if code == "other" and not (note or "").strip():
        raise Refused("`other` needs a note")
    return code


def validate_override(field: str, value: str) -> tuple[str, str]:
    value = (value or "").strip()
    if field not in OVERRIDES:
        raise Refused(f"{field!r} can't be overridden")
    if not value or len(value) > LONGEST_VALUE:
        raise Refused(f"an override needs 1 to {LONGEST_VALUE} characters")
    if OVERRIDES[field] and value not in OVERRIDES[field]:
        raise Refused(f"{field} is one of " + ", ".join(OVERRIDES[field]))
    return field, value


def check_gates(status: str, failed: tuple[str, ...], decision: str, waived: tuple[str, ...] = (), reason: str = "", second: str = "", reviewer: str = "") -> None:
    """Acceptance: not with G4 failed; other failed gates need a waiver with a reason and a second approver."""
    if decision not in ("Accept", "AcceptWithException") or not failed:
        return
    if "g4" in failed or status == "Blocked":
        raise Refused("a source in sunset without a successor can't be accepted")
    if decision == "Accept":
        raise Refused("failed gates need AcceptWithException: " + ", ".join(failed))
    if set(failed) - set(waived) or not reason.strip():
        raise Refused("an exception waives every failed gate, with a reason")
    if not second.strip() or second == reviewer:
        raise Refused("a second approver, other than the reviewer, must agree")


def normalize_timestamp(text: str) -> str:
    """ISO text, with or without an offset, as UTC seconds."""
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC).replace(microsecond=0, tzinfo=None).isoformat()


def canonical_json(payload: object) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def row_hash(fields: dict, before: str) -> str:
    return hashlib.sha256((before + canonical_json(fields)).encode()).hexdigest()


def stable_key(*parts: object) -> str:
    return hashlib.sha256("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:16].upper()


class Ledger:
    """Decisions in a folder of Parquet files, one file an append; a single writer chains them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(DECISION).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], DECISION)

    def append(self, run_id: str, candidate_id: str, decision: str, reviewer: str, status: str, at: str, reason: str = "", note: str = "", carried: str = "", failed: tuple[str, ...] = (), **waiver) -> dict:
        """Checks reason, gates and transition, then appends."""
        code = validate_reason(decision, reason, note)
        check_gates(status, failed, decision, reviewer=reviewer, **waiver)
        new = next_status(status, decision, carried)
        last = self.rows().agg(F.max_by("row_hash", "decision_id").alias("h"), F.max("decision_id").alias("i")).first()
        fields = {"decision_id": (last["i"] or 0) + 1, "run_id": run_id, "candidate_id": candidate_id, "decision": decision, "reason_code": code, "note": note, "reviewer": reviewer, "previous_status": status, "new_status": new or status, "decided_at": normalize_timestamp(at)}
        row = fields | {"prev_hash": last["h"] or "", "row_hash": row_hash(fields, last["h"] or "")}
        self.spark.createDataFrame([tuple(row[f.split()[0]] for f in DECISION.split(", "))], DECISION).coalesce(1).write.mode("append").parquet(self.path)
        return row

    def verify(self) -> DataFrame:
        return verify(self.rows())


def verify(rows: DataFrame) -> DataFrame:
    """One row: the first decision whose hash or link doesn't hold, null if all do, and how many there are.

    Links are compared with the row before in order of ids, dealt in ranges of ids; hashes are recomputed in place.
    """
    fields = [f.split()[0] for f in DECISION.split(", ")][:-2]

    @F.pandas_udf(StringType())
    def again(body: pd.Series, before: pd.Series) -> pd.Series:
        return body.combine(before, lambda b, p: row_hash(json.loads(b), p))

    body = F.to_json(F.struct("decision_id", *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields[1:]]))
    order = Window.orderBy("decision_id")  # one ledger: a row a human decision
    x = rows.withColumn("now", again(body, F.col("prev_hash"))).withColumn("was", F.coalesce(F.lag("row_hash").over(order), F.lit("")))
    broken = (F.col("now") != F.col("row_hash")) | (F.col("was") != F.col("prev_hash"))
    return x.agg(F.min(F.when(broken, F.col("decision_id"))).alias("first_break"), F.count("*").alias("decisions"))


def latest(rows: DataFrame, key: str = "candidate_id", order: str = "decision_id") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(order).alias(order), F.max_by(F.struct(*rest), order).alias("r")).select(key, order, *[f"r.{c}" for c in rest])


def orphan_statuses(statuses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviewed states that no decision stands behind."""
    return statuses.where(F.col("status").isin("Accepted", "Rejected", "Merged", "Deferred")).join(decisions, "candidate_id", "left_anti")


def lineage_id(fingerprints: Column, grain: Column) -> Column:
    """What stays of a candidate over runs: its distinct fingerprints and its grain."""
    text = F.concat(F.array_join(F.array_sort(F.array_distinct(fingerprints)), "|"), F.lit("||"), grain)
    return F.concat(F.lit("LIN-"), F.upper(F.substring(F.sha2(text, 256), 1, 12)))


def conflict_key(a: Column, b: Column) -> Column:
    """The same for a pair of fingerprints whichever comes first."""
    return F.upper(F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, 16))


def match_runs(current: DataFrame, previous: DataFrame, least: float = 0.6) -> DataFrame:
    """(current_id, previous_id, score, kind) of candidates (candidate_id, lineage_id, metric_ids) of two runs.

    Equal lineage matches with 1. Of the rest, pairs that share metrics match one to one, best Jaccard first, from
    `least` on: in rounds, each taking the pairs that are best for both of their sides. What is left is added or removed.
    """
    c, p = current.select(F.col("candidate_id").alias("current_id"), "lineage_id", F.col("metric_ids").alias("cm")), previous.select(F.col("candidate_id").alias("previous_id"), "lineage_id", F.col("metric_ids").alias("pm"))
    same = c.join(p, "lineage_id").groupBy("previous_id").agg(F.min("current_id").alias("current_id")).groupBy("current_id").agg(F.min("previous_id").alias("previous_id")).select("current_id", "previous_id", F.lit(1.0).alias("score"), F.lit("lineage").alias("kind"))
    x = c.join(same, "current_id", "left_anti").select("current_id", "cm", F.explode("cm").alias("metric"))
    y = p.join(same, "previous_id", "left_anti").select("previous_id", "pm", F.explode("pm").alias("metric"))
    pairs = x.join(y, "metric").select("current_id", "previous_id", S.jaccard(F.col("cm"), F.col("pm")).alias("score")).distinct().where(F.col("score") >= least)
    out = same
    for _ in range(32):
        order = [F.desc("score"), "previous_id", "current_id"]
        best = pairs.withColumn("a", F.row_number().over(Window.partitionBy("current_id").orderBy(*order))).withColumn("b", F.row_number().over(Window.partitionBy("previous_id").orderBy(*order))).where("a = 1 and b = 1").select("current_id", "previous_id", "score", F.lit("similar").alias("kind"))
        rows = [tuple(r) for r in best.collect()]  # candidates of one run: tens to hundreds
        if not rows:
            break
        taken = pairs.sparkSession.createDataFrame(rows, "current_id string, previous_id string, score double, kind string")
        out = out.union(taken)
        pairs = pairs.join(F.broadcast(taken.select("current_id")), "current_id", "left_anti").join(F.broadcast(taken.select("previous_id")), "previous_id", "left_anti")
    none = F.lit(None).cast("string")
    added = c.join(out, "current_id", "left_anti").select("current_id", none.alias("previous_id"), F.lit(0.0).alias("score"), F.lit("added").alias("kind"))
    gone = p.join(out, "previous_id", "left_anti").select(none.alias("current_id"), "previous_id", F.lit(0.0).alias("score"), F.lit("removed").alias("kind"))
    return out.union(added).union(gone)


def carry_forward(matches: DataFrame, reviewed: DataFrame, current: DataFrame) -> DataFrame:
    """(candidate_id, status, carried) of current candidates: a matched candidate's reviewed state where it may be carried."""
    allowed = matches.sparkSession.createDataFrame([(s, t) for s, ts in CARRIED.items() for t in ts], "status string, carried string")
    x = current.join(matches.where("previous_id is not null").select(F.col("current_id").alias("candidate_id"), "previous_id"), "candidate_id", "left").join(reviewed.select(F.col("candidate_id").alias("previous_id"), F.col("status").alias("carried")), "previous_id", "left")
    return x.join(F.broadcast(allowed.withColumn("ok", F.lit(True))), ["status", "carried"], "left").select("candidate_id", F.when(F.col("ok"), F.col("carried")).otherwise(F.col("status")).alias("status"), F.coalesce("ok", F.lit(False)).alias("carried"))


def acceptance(decisions: DataFrame, heads: DataFrame) -> DataFrame:
    """(by, value, accepted, decided, rate) of the last terminal decisions by domain and reviewer."""
    last = latest(decisions.where(F.col("decision").isin("Accept", "AcceptWithException", "Reject", "Merge"))).join(heads.select("candidate_id", "domain"), "candidate_id")
    rows = F.array(F.struct(F.lit("domain").alias("by"), F.col("domain").alias("value")), F.struct(F.lit("reviewer").alias("by"), F.col("reviewer").alias("value")))
    x = last.select(F.explode(rows).alias("r"), F.col("decision").startswith("Accept").alias("yes")).select("r.*", "yes")
    return x.groupBy("by", "value").agg(F.count_if("yes").alias("accepted"), F.count("*").alias("decided"), F.avg(F.col("yes").cast("int")).alias("rate"))


def weight_vector_hash(weights: DataFrame) -> DataFrame:
    """One row: a hash of (dimension, feature, weight) rows in whatever order."""
    row = F.concat_ws("|", "dimension", "feature", F.format_string("%.6f", "weight"))
    return weights.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ";"), 256).alias("hash"))
