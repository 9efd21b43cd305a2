"""Exports of a run: workbook, documents as Markdown and HTML, seeds as YAML, JSON and CSV. Registers people read are
collected; each is bounded by `most` rows in a fixed order, and says so where it was cut."""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame

from metrigraph.sources.tabular import write_workbook

TABS = {
    "Candidates": ("candidate", "candidate_id"), "Scores": ("score", "candidate_id"), "Metrics": ("metric", "metric_id"), "Conflicts": ("conflict", "conflict_id"),
    "Consumers": ("consumer", "candidate_id"), "Sources": ("source", "candidate_id"), "Reports": ("report", "candidate_id"), "Effort": ("effort", "candidate_id"), "Quarantine": ("quarantine", "kpi_id"),
}


def plain(value: object) -> object:
    """Dates as ISO text, sets sorted, rows as dictionaries."""
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(map(plain, value), key=str)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def to_json(payload: object, indent: int = 2) -> str:
    return json.dumps(plain(payload), indent=indent, ensure_ascii=False)


def to_yaml(data: object, depth: int = 0) -> str:
    """Block style; texts that YAML could read as something else are quoted as JSON."""
    pad = "  " * depth
    data = plain(data)
    if isinstance(data, dict):
        return "".join(f"{pad}{_key(k)}:" + (f"\n{to_yaml(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {_scalar(v)}\n") for k, v in data.items())
    if isinstance(data, list):
        out = ""
        for v in data:
            if isinstance(v, (dict, list)) and v:
                body = to_yaml(v, depth + 1)
                out += f"{pad}- {body[len(pad) + 2 :]}"
            else:
                out += f"{pad}- {_scalar(v)}\n"
        return out
    return f"{pad}{_scalar(data)}\n"


def _key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z_][\w-]*", k) else json.dumps(k, ensure_ascii=False)


def _scalar(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, (bool, int, float)):
        return json.dumps(v)
    if v == {} or v == []:
        return json.dumps(v)
    text = str(v)
    safe = re.fullmatch(r"[A-Za-z][\w ./()%-]*", text) and not text.endswith(" ") and text.lower() not in ("true", "false", "yes", "no", "on", "off", "null")
    return text if safe else json.dumps(text, ensure_ascii=False)


@dataclass
class Document:
    """A title and blocks: ('heading', text), ('text', text), ('list', [texts]), ('table', header, rows)."""

    title: str
    blocks: list[tuple] = field(default_factory=list)

    def heading(self, text: str) -> Document:
        self.blocks.append(("heading", text))
        return self

    def text(self, text: str) -> Document:
        self.blocks.append(("text", text))
        return self

    def points(self, texts: list[str]) -> Document:
        self.blocks.append(("list", texts))
        return self

    def table(self, df: DataFrame, order: list[str], most: int = 200) -> Document:
        rows = df.orderBy(*order).limit(most + 1).collect()
        self.blocks.append(("table", df.columns, [[plain(v) for v in r] for r in rows[:most]]))
        return self.text(f"The first {most} rows.") if len(rows) > most else self


def markdown(doc: Document) -> str:
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    out = [f"# {doc.title}"]
    for kind, *body in doc.blocks:
        if kind == "heading":
            out.append(f"## {body[0]}")
        elif kind == "text":
            out.append(body[0])
        elif kind == "list":
            out.append("\n".join(f"- {x}" for x in body[0]))
        else:
            out.append("\n".join([f"| {' | '.join(map(cell, body[0]))} |", f"|{' --- |' * len(body[0])}", *[f"| {' | '.join(map(cell, r))} |" for r in body[1]]]))
    return "\n\n".join(out) + "\n"


def to_html(doc: Document) -> str:
    e = lambda v: html.escape(str("" if v is None else v))
    out = []
    for kind, *body in doc.blocks:
        if kind == "heading":
            out.append(f"<h2>{e(body[0])}</h2>")
        elif kind == "text":
            out.append(f"<p>{e(body[0])}</p>")
        elif kind == "list":
            out.append(f"<ul>{''.join(f'<li>{e(x)}</li>' for x in body[0])}</ul>")
        else:
            rows = "".join(f"<tr>{''.join(f'<td>{e(v)}</td>' for v in r)}</tr>" for r in body[1])
            out.append(f"<table><tr>{''.join(f'<th>{e(c)}</th>' for c in body[0])}</tr>{rows}</table>")
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{e(doc.title)}</title></head><body><h1>{e(doc.title)}</h1>{"".join(out)}</body></html>'


def workbook(tables: dict[str, DataFrame], most: int = 10_000) -> bytes:
    """One tab a register."""
    sheets = {}
    for tab, (name, order) in TABS.items():
        if name in tables:
            df = tables[name]
            rows = df.orderBy(order, *[c for c, t in df.dtypes if c != order and t in ("string", "bigint")]).limit(most).collect()
            sheets[tab] = [df.columns, *[[v if isinstance(v := plain(x), (int, float, str, type(None))) else json.dumps(v, ensure_ascii=False) for x in r] for r in rows]]
    return write_workbook(sheets)


def summary(tables: dict[str, DataFrame], as_of: str) -> Document:
    """The run at a glance: ranking, blocked candidates, conflicts, unresolved lineage."""
    c, s = tables["candidate"].select("candidate_id", "proposed_name", "domain"), tables["score"].select("candidate_id", "archetype", "composite", "band", "status")
    both = c.join(s, "candidate_id")
    doc = Document(f"Summary as of {as_of}").heading("Candidates").table(both.orderBy("composite"), ["candidate_id"], 50)
    doc.heading("Status").table(s.groupBy("status").count(), ["status"])
    doc.heading("Conflicts").table(tables["conflict"].groupBy("pattern").count(), ["pattern"])
    return doc.heading("Unresolved lineage").table(tables["quarantine"].groupBy("reason").count(), ["reason"])


def dossier(tables: dict[str, DataFrame], candidate_id: str) -> Document:
    """Everything on one candidate."""
    own = {n: tables[n].where(tables[n]["candidate_id"] == candidate_id) for n in ("candidate", "score", "consumer", "source", "report", "member")}
    doc = Document(f"Candidate {candidate_id}")
    doc.heading("Score").table(own["score"].select("archetype", "tier", "composite", "band", "status", "g1", "g2", "g3", "g4"), ["composite"])
    doc.heading("Consumers").table(own["consumer"].drop("candidate_id", "top_reports"), ["business_unit"])
    doc.heading("Sources").table(own["source"].select("table_fqn", "share_of_metrics", "lifecycle_status"), ["table_fqn"])
    metrics = own["member"].join(tables["metric"].select("metric_id", "canonical_name", "aggregation", "grain", "steward"), "metric_id").drop("candidate_id")
    return doc.heading("Metrics").table(metrics, ["canonical_name", "metric_id"]).heading("Reports").table(own["report"].select("report_id", "coverage", "disposition", "users"), ["report_id"], 100)


def semantic_model(tables: dict[str, DataFrame], candidate_id: str, most: int = 500) -> str:
    """Entities, dimensions and metrics of one candidate as YAML; all names are drafts."""
    members = tables["member"].where(tables["member"]["candidate_id"] == candidate_id)
    m = members.join(tables["metric"], "metric_id").select("canonical_name", "aggregation", "grain", "operand_columns", "filter_columns", "definition").orderBy("canonical_name").limit(most).collect()
    tabs = sorted({c.rsplit(".", 1)[0] for r in m for c in r["operand_columns"]})
    return to_yaml({
        "candidate": candidate_id, "status": "draft",
        "entities": [{"table": t} for t in tabs],
        "dimensions": sorted({c for r in m for c in r["filter_columns"]}),
        "metrics": [{"name": r["canonical_name"], "aggregation": r["aggregation"], "grain": r["grain"], "columns": r["operand_columns"], "definition": r["definition"], "name_status": "AI_DRAFT"} for r in m],
    })


def catalog_payload(tables: dict[str, DataFrame], candidate_id: str, status: str, synthetic: bool, most: int = 500) -> dict:
    """A proposal for the catalog, and what keeps it from being imported."""
    members = tables["member"].where(tables["member"]["candidate_id"] == candidate_id)
    names = [r["canonical_name"] for r in members.join(tables["metric"], "metric_id").select("canonical_name").orderBy("canonical_name").limit(most).collect()]
    blocked = ([] if not synthetic else ["synthetic run"]) + ([f"{len(names)} names are drafts"] if names else []) + ([] if status == "Accepted" else [f"status is {status}"])
    return {"candidate_id": candidate_id, "terms": [{"name": n, "status": "Draft"} for n in names], "import_blocked_by": blocked}
