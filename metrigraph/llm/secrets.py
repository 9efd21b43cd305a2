"""Secret scans with corpus-wide ownership frequency, as DataFrame expressions only.

Base kinds (assign, access, hex) are fixed patterns and always stay. A wider pattern finds other
key-like tokens: by length, by how often letters of either case and digits alternate (as they do in random strings,
and not in words, paths and slugs), by the number of different characters, and by context: a token that a base span
overlaps is none. Whether such a token is a secret is decided by who owns it: candidate hashes are aggregated over
the whole corpus by distinct repositories (documents) and owners (sources). A value that EXAMPLE_OWNERS owners or
EXAMPLE_REPOS repositories hold is a copied example; any other is live-looking and becomes a span of kind
"live". Base spans carry the same verdict in n_live and n_example.

Positions come from two passes of the same pattern: the gaps of split() and the hits of
regexp_extract_all() alternate, so running sums of their lengths are code-point offsets. Running sums are made in
blocks of about the square root of their number, and texts are cut in blocks of PIECE code points, so that a text of
very many hits takes time nearly in proportion to its length.

Defined results: null text is empty and has no spans; null owners or repositories count as one owner or
repository; repeated rows count once per repository; ties (spans that start together) are ordered as kinds are listed;
very long texts are scanned whole; extra columns of any name are kept by `redact`; an empty table gives no rows. Only
candidate hashes leave a row, never values. Hot values are aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrigraph.functions.scalars import let
from metrigraph.storage import keep


_WORDS = ("password", "passwd", "secret", "token")
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = "(" + "|".join([*map(_either, _WORDS), f"{_either('api')}_?{_either('key')}"]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
#: Key-like tokens beyond the base kinds.
WIDE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Where letters of one case, letters of the other and digits meet.
_TURN = "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
#: Longest key; least share of places where the kind of character turns; least number of different characters.
LONGEST, TURNS, DIFFERENT = 512, 0.2, 8
KINDS = ("assign", "access", "hex", "live")
#: Owners, and repositories, from which on a value counts as a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 50
#: Code points of the blocks that a text is cut into, so that no substring is looked for from its start.
PIECE = 4096
_NONE = "array<struct<start:int,kind:int,end:int,hash:bigint>>"


def running(x: Column) -> Column:
    """Running sums of an array<int>."""

    def plain(y: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(y, start, lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + v)).alias("out")), lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), plain(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, base: F.transform(b, lambda v: v + base)))

    def sums(y: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(y))).cast("int")
        return let(let(width, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(y) / w).cast("int") - 1), lambda k: plain(F.slice(y, k * w + 1, w)))), joined)

    return let(x, lambda y: F.when(F.size(y) > 0, sums(y)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, pattern: str, kind: int, value: int = 0, least: int = 1, most: int | None = None) -> Column:
    """array<struct<start, kind, end, hash, hit, n>> of the hits whose value (a group) has `least` to `most` code points."""
    own = (lambda h: F.regexp_extract(h, pattern, value)) if value else (lambda h: h)

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        ends = running(F.zip_with(hits, gaps, lambda h, g: F.length(h) + F.length(g)))
        return F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), F.xxhash64(own(h)).alias("hash"), h.alias("hit"), F.length(own(h)).alias("n")))

    found = F.filter(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), lambda s: (s["n"] >= least) & (s["n"] <= most if most else F.lit(True)))
    return F.when(text.rlike(pattern), found)


def _bare(spans: Column) -> Column:
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["hash"].alias("hash")))
    return F.coalesce(plain, F.array().cast(_NONE))


def looks_random(token: Column) -> Column:
    """Whether a token is like a generated key: digits and letters, kinds that alternate, many different characters."""
    turns = F.size(F.split(F.regexp_replace(token, "[^A-Za-z0-9]", ""), _TURN, -1)) - 1
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (turns >= TURNS * (F.length(token) - 1)) & (F.size(F.array_distinct(F.split(token, ""))) >= DIFFERENT)


def scan(text: Column) -> tuple[Column, Column]:
    """Base spans in order, and wider candidates, which base spans may still overlap."""
    base = F.concat(_bare(_spans(text, ASSIGN, 0, 2, 6)), _bare(_spans(text, ACCESS, 1, 0, 20)), _bare(_spans(text, HEX, 2, 0, 24)))
    wide = F.filter(_spans(text, WIDE, 3, 0, 20, LONGEST), lambda s: looks_random(s["hit"]))
    return F.array_sort(base), _bare(wide)


def spans(df: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, *carry, base, spans, n_live, n_example) of every row; spans: base and live ones in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, wide = scan(text)
    rows = keep(df.select(F.struct(*carry).alias("carried") if carry else F.lit(0).alias("carried"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), base.alias("base"), wide.alias("wide")).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "owner", "repo", F.explode(F.concat("base", "wide")).alias("s"))
    # Spans of a text in order: a base span overlaps what follows up to its end, and what precedes from its start.
    upto, onward = Window.partitionBy("row").orderBy("s.start", "s.kind"), Window.partitionBy("row").orderBy(F.desc("s.start"), F.desc("s.kind"))
    ended, begins = F.max(F.when(F.col("s.kind") < 3, F.col("s.end"))).over(upto), F.min(F.when(F.col("s.kind") < 3, F.col("s.start"))).over(onward)
    free = (F.col("s.kind") < 3) | (F.coalesce(ended <= F.col("s.start"), F.lit(True)) & F.coalesce(begins >= F.col("s.end"), F.lit(True)))
    each = each.withColumn("free", free).where("free").drop("free")
    owned = each.groupBy(F.col("s.hash").alias("hash")).agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS)
    judged = each.join(owned, each["s.hash"] == owned["hash"]).select("row", "s", example.alias("example"))
    live = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("s.kind") == 3) & ~F.col("example"), F.col("s"))).alias("live"),
        F.count_if(~F.col("example")).alias("n_live"),
        F.count_if(F.col("example")).alias("n_example"),
    )
    all_ = F.array_sort(F.concat("base", F.coalesce("live", F.array().cast(_NONE))))
    out = rows.join(live, "row", "left")
    return out.select("row", *[F.col(f"carried.`{c}`") for c in carry], "base", all_.alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mark: str = "[secret]", chars_col: str | None = None) -> DataFrame:
    """df with every span of its texts replaced by the mark; overlapping spans are one. Other texts stay as they are.

    chars_col, if given, becomes the new length where a text changed. Texts that no pattern hits aren't dealt out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hit = F.lit(False)
    for pattern in (ASSIGN, ACCESS, HEX, WIDE):
        hit |= text.rlike(pattern)
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), F.col(text_col).alias("text"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), hit.alias("hit"))
    some = own.where("hit").withColumn("key", F.md5("text"))
    found = spans(some.select("key", "owner", "repo", "text"), "text", "owner", "repo", ("key",)).where(F.size("spans") > 0)
    found = found.groupBy("key").agg(F.first("spans").alias("s")).select("key", F.explode("s").alias("s"))  # equal texts have equal spans
    order = Window.partitionBy("key").orderBy("s.start", "s.end")
    begins = F.coalesce(F.max("s.end").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("s.start"), F.lit(True))
    found = found.withColumn("begins", begins).withColumn("run", F.count_if("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = found.groupBy("key", "run").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"))
    merged = merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def piece(a: Column, b: Column) -> Column:
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        at = lambda k: F.coalesce(F.try_element_at("blocks", k + 1), F.lit(""))
        inside = F.substring(at(i), a - i * PIECE + 1, b - a)
        across = F.concat(F.substring(at(i), a - i * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice("blocks", i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(at(j), F.lit(1), b - j * PIECE))
        return F.when(i == j, inside).otherwise(across)

    from_, to = F.concat(F.array(F.lit(0)), F.col("spans.end")), F.concat(F.col("spans.start"), F.array(F.length("text")))
    joined = some.join(merged, "key", "left").withColumn("blocks", F.when(F.col("spans").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    joined = joined.withColumn("new", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(from_, to, piece), mark)))
    put = {text_col: F.col("new")}
    if chars_col:
        put[chars_col] = F.when(F.col("new") == F.col("text"), F.col(f"own.`{chars_col}`")).otherwise(F.length("new").cast(df.schema[chars_col].dataType))
    changed = joined.select(*[put.get(c, F.col(f"own.`{c}`")).alias(c) for c in df.columns])
    return own.where("not hit").select(*[F.col(f"own.`{c}`") for c in df.columns]).union(changed)


def op8(spark, sf_dir: str) -> DataFrame:
    s = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=("doc_id",))
    n = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")
    return s.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), "n_live", "n_example")
