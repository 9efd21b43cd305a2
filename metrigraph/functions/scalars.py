"""Scalar functions over columns: identifiers, coercions, vocabularies, scores. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of business names and what they stand for, and words without meaning.
ABBREVIATIONS = {
    "acct": "account", "acc": "account", "cust": "customer", "custm": "customer",
    "no": "number", "num": "number", "nbr": "number", "id": "identifier",
    "amt": "amount", "qty": "quantity", "dt": "date", "ts": "timestamp",
    "desc": "description", "cd": "code", "cde": "code", "typ": "type",
    "flg": "flag", "ind": "indicator", "pct": "percent", "avg": "average",
    "bal": "balance", "txn": "transaction", "trx": "transaction",
    "addr": "address", "prem": "premise", "mtr": "meter", "svc": "service",
    "pmt": "payment", "pymt": "payment", "inv": "invoice", "org": "organization",
    "emp": "employee", "prod": "product", "rev": "revenue", "yr": "year",
    "mth": "month", "mo": "month", "dtl": "detail", "hdr": "header",
    "src": "source", "tgt": "target", "ref": "reference", "seq": "sequence",
}
STOP_WORDS = ("the", "of", "a", "an", "and", "for", "to", "in", "by")
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1", "x"), ("false", "f", "no", "n", "0", "")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MMM-yyyy")
DISPOSITIONS = {"retire": "Retire", "decommission": "Retire", "merge": "Merge", "consolidate": "Merge", "keep": "Keep", "migrate": "Migrate", "convert": "Migrate"}
SENSITIVITY = {
    "public": "Public", "open": "Public", "unclassified": "Public", "internal": "Internal", "internal use only": "Internal",
    "company confidential": "Confidential", "confidential": "Confidential", "sensitive": "Confidential", "pii": "Confidential",
    "restricted": "Restricted", "highly confidential": "Restricted", "secret": "Restricted",
}
SENSITIVITY_RANK = {"public": 0.0, "internal": 0.35, "confidential": 0.7, "restricted": 1.0}
CADENCE_MONTHS = {"monthly": 1, "quarterly": 3, "semi-annual": 6, "annual": 12, "yearly": 12}
HALF_LIFE_MONTHS, DAYS_A_MONTH, UNKNOWN_MONTHS = 6.0, 30.44, 24.0


def let(x: Column, then) -> Column:
    """then(x), with x worked out once however often it is used: the lambda's variable is a value."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks; other characters stay."""
    marked = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
    return F.translate(c, marked, plain)


def normalize_identifier(c: Column) -> Column:
    """Trimmed, without outer quotes, brackets and backticks (in this order), lower case, no accents."""
    out = F.trim(strip_accents(c))
    for quote in ('"', "'", "[", "]", "`"):
        out = F.trim(out, F.lit(quote))
    return F.lower(out)


def tokens(c: Column) -> Column:
    """Lower-case words split at camel case and punctuation, abbreviations expanded, stop words dropped."""
    text = F.regexp_replace(strip_accents(F.coalesce(c.cast("string"), F.lit(""))), "(?<=[a-z0-9])(?=[A-Z])", " ")
    words = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.coalesce(_lookup(ABBREVIATIONS, F.lower(w)), F.lower(w)))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def token_key(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def snake_case(c: Column) -> Column:
    joined = F.array_join(tokens(c), "_")
    return F.when(joined == "", "unnamed").otherwise(joined)


def title_case(c: Column) -> Column:
    """Words capitalised; a text without words stays as it is."""
    joined = F.initcap(F.array_join(tokens(c), " "))
    return F.when(joined == "", c).otherwise(joined)


# Words whose last s is no plural's.
PLURAL_KEEP = ("days", "sales", "series", "status", "basis", "analysis", "process")


def label_key(c: Column) -> Column:
    """token_key with plural s folded; days is day."""
    fold = lambda w: F.when(w == "days", "day").when(w.endswith("s") & (F.length(w) > 3) & ~w.endswith("ss") & ~w.isin(*PLURAL_KEEP), F.regexp_replace(w, "s$", "")).otherwise(w)
    return F.array_join(F.array_sort(F.transform(tokens(c), fold)), " ")


def stable_id(prefix: str, *parts: Column, length: int = 10) -> Column:
    """prefix and the first hex digits of SHA-256 over the parts, null as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(text, 256), 1, length)))


def as_str(c: Column, default: str = "") -> Column:
    text = F.regexp_replace(F.trim(c.cast("string")), r"^(-?\d+)\.0$", "$1")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def as_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.regexp_replace(F.trim(c.cast("string")), "[,%]", "").try_cast("double"), F.lit(default))


def as_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double").cast("long"), F.lit(default))


def as_bool(c: Column, default: bool = False) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False).otherwise(default)


def as_date(c: Column) -> Column:
    """Six text formats in order, then the first ten characters as ISO, then a spreadsheet's day number."""
    text = F.trim(c.cast("string"))
    serial = F.when(text.rlike(r"^\d{1,6}(\.\d+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), text.try_cast("double").cast("int")))
    return F.coalesce(*[F.try_to_date(text, f) for f in DATE_FORMATS], F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), serial)


def disposition(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(*[F.when(low.startswith(k), F.lit(v)) for k, v in DISPOSITIONS.items()], F.lit("Keep"))


def sensitivity(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low == "", "Internal").otherwise(F.coalesce(_lookup(SENSITIVITY, low), F.initcap(low)))


def lifecycle(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin("sunset", "retiring", "end of life", "eol", "deprecated", "decommissioned"), "sunset").otherwise("active")


def glossary_status(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(low == "", "none")
        .when(low.isin("approved", "certified", "published", "accepted", "active"), "approved")
        .when(low.isin("deprecated", "retired", "obsolete", "rejected", "archived"), "retired")
        .otherwise("draft")
    )


def months_since(last: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, last)
    return F.coalesce(F.greatest(F.lit(0.0), days / DAYS_A_MONTH), F.lit(UNKNOWN_MONTHS))


def recency_decay(last: Column, as_of: Column, half_life: Column | float = HALF_LIFE_MONTHS) -> Column:
    half = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return F.pow(F.lit(0.5), months_since(last, as_of) / half)


def cadence_months(frequency: Column) -> Column:
    return F.coalesce(_lookup(CADENCE_MONTHS, F.lower(F.element_at(F.split(F.trim(frequency), " "), 1))), F.lit(1))


def log_ratio(value: Column, most: Column) -> Column:
    """min(1, ln(1+v) / ln(1+max)); 0 if either isn't positive."""
    return F.when((value > 0) & (most > 0), F.least(F.lit(1.0), F.log(1 + value) / F.log(1 + most))).otherwise(0.0)


def quality_unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c > 1, c / 100).otherwise(c)))


def composite_band(c: Column) -> Column:
    return F.when(c >= 75, "Strong").when(c >= 60, "Good").when(c >= 45, "Moderate").otherwise("Weak")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def is_hold(name: Column, critical: Column) -> Column:
    """Reports that mustn't be retired: decision-critical, or regulatory by name."""
    return F.coalesce(critical, F.lit(False)) | F.coalesce(name, F.lit("")).rlike(r"\b(Regulatory|Statutory|Filing|Submission|(Compliance|Statutory|Regulatory) Return)\b")
