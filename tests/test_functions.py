import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from metrigraph.functions import expressions as X
from metrigraph.functions import scalars as S
from metrigraph.functions import similarity as M
from metrigraph.operators import community, resolve
from metrigraph.sources import contracts, tabular


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def two(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]


def test_coercions(spark):
    assert [one(spark, v, S.as_int) for v in ("1,234", "3.9", "x", None)] == [1234, 3, 0, 0]
    assert [one(spark, v, S.as_float) for v in ("12.5%", "1,000.5", "")] == [12.5, 1000.5, 0.0]
    assert [one(spark, v, S.as_bool) for v in ("Yes", "n", "maybe")] == [True, False, False]
    assert [one(spark, v, S.as_date) for v in ("2024-03-01", "31/12/2023", "2024-03-01T10:00:00", "45352", "soon")] == [dt.date(2024, 3, 1), dt.date(2023, 12, 31), dt.date(2024, 3, 1), dt.date(2024, 3, 1), None]
    assert [one(spark, v, S.disposition) for v in ("retire soon", "Consolidate", None)] == ["Retire", "Merge", "Keep"]
    assert [one(spark, v, S.sensitivity) for v in ("PII", "secret", "", "own class")] == ["Confidential", "Restricted", "Internal", "Own Class"]


def test_names(spark):
    assert one(spark, "custAcct_No of the", S.token_key) == "account customer number"
    assert one(spark, "Net Revenues", S.label_key) == one(spark, "revenue, net", S.label_key)
    assert [one(spark, v, S.label_key) for v in ("60 days", "sales")] == ["60 day", "sales"]
    assert one(spark, ' "[Órder]" ', S.normalize_identifier) == "order"
    assert one(spark, "`[x]`", S.normalize_identifier) == "[x]"  # quotes go in one order, once
    assert [one(spark, v, S.title_case) for v in ("net_amt", "--")] == ["Net Amount", "--"]


def test_similarity(spark):
    assert M.jaro("martha", "marhta") == (1 + 1 + 5 / 6) / 3
    assert two(spark, "martha", "marhta", M.jaro_winkler) == pytest.approx(17 / 18 + 3 * 0.1 / 18)
    assert two(spark, "cust_no", "customer number", M.name_similarity) == 1.0
    assert two(spark, "net revenue", "revenue net", M.embedding_similarity) == pytest.approx(1.0)
    assert 0 <= two(spark, "net revenue", "gross cost", M.embedding_similarity) < 0.6
    assert two(spark, "", "gross cost", M.embedding_similarity) == 0.0
    assert two(spark, "Net Revenues", "Revenue, Net", M.label_similarity) == 1.0
    assert two(spark, "abcd", "abzz", M.jaro_winkler_most) >= two(spark, "abcd", "abzz", M.jaro_winkler)


def test_word_vectors_are_signed_hashes(spark):
    import hashlib

    want = [0.0] * 64
    for w in ("net", "revenue"):
        digest = hashlib.sha256(w.encode()).digest()
        for k in range(4):
            want[digest[k] % 64] += 1.0 if digest[k + 4] % 2 == 0 else -1.0
    norm = sum(v * v for v in want) ** 0.5
    assert one(spark, "Net revenue", M.word_vector) == pytest.approx([v / norm for v in want])


#: (expression, status, aggregation, operands)
GOLDEN = [
    ("total([Sales].[Orders].[Amount])", "PARSED", "SUM", "orders.amount"),
    ("count(distinct [S].[Dim].[Key])", "PARSED", "COUNT DISTINCT", "dim.key"),
    ("DIVIDE(SUM('T'[a]), SUM('T'[b]), 0)", "PARSED", "RATIO", "t.a,t.b"),
    ("case when [T].[s] = 'open' then [T].[n] else 0 end", "PARSED", "NONE", "t.n,t.s"),
    ("#sql('select 1')#", "PARSE_FAIL", "NONE", ""),
    ("", "PARSE_FAIL", "NONE", ""),
    ("sum([T].[a]", "PARSE_FAIL", "NONE", ""),
    ("total([T].[a] for [T].[g])", "PARSE_FAIL", "NONE", ""),
    ("total([T].[a]) for [T].[g]", "PARSED", "SUM", "t.a,t.g"),
    ("average([T].[d]) + average([T].[c])", "PARSED", "AVG", "t.c,t.d"),
    ("TOTALYTD(SUM('T'[a]), 'Cal'[Date])", "PARSED", "SUM", "cal.date,t.a"),
    ("sum([T].[a]) > ?limit?", "PARSE_FAIL", "SUM", "t.a"),
    ("not [T].[a] is null and [T].[b] between 1 and 5", "PARSED", "NONE", "t.a,t.b"),
    ("[T].[k] in (1, 2, 3)", "PARSED", "NONE", "t.k"),
    ("stddev([T].[a])", "PARSED", "STDDEV", "t.a"),
]


@pytest.mark.parametrize(("text", "status", "aggregation", "operands"), GOLDEN)
def test_golden_expressions(text, status, aggregation, operands):
    p = X.parse(text)
    assert (p["status"], p["aggregation"], ",".join(p["operands"])) == (status, aggregation, operands)


def test_expressions():
    same = lambda a, b: X.parse(a)["fingerprint"] == X.parse(b)["fingerprint"]
    assert same("total([S].[T].[x])", "SUM('T'[x])")
    assert same("CALCULATE(SUM('T'[x]))", "SUM('T'[x])")
    assert same("[T].[a] + [T].[b]", "[T].[b] + [T].[a]")
    assert not same("[T].[a] / [T].[b]", "[T].[b] / [T].[a]")
    assert not same("case when [T].[a] > 60 then 1 end", "case when [T].[a] > 59 then 1 end")
    assert not same("int([d]/30)", "[d]/30")
    assert not same("#one#", "#two#")
    assert X.parse("CALCULATE(SUM('T'[x]), SAMEPERIODLASTYEAR('C'[d]))")["time_modifier"] == "PY"
    assert X.parse("(" * 5000)["status"] == "PARSE_FAIL"


def test_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(4) for j in range(i + 1, 4)]
    edges = [*clique("a"), *clique("b"), ("a0", "b0", 0.1)]
    got = community.louvain(edges)
    assert len(set(got.values())) == 2 and got == community.louvain(edges)
    df = spark.createDataFrame([*edges, *clique("c")], "a string, b string, weight double")
    found = community.communities(df, "a", "b", "weight")
    assert {r["node"]: r["community"] for r in found.collect()} == {f"{p}{i}": f"{p}0" for p in "abc" for i in range(4)}
    assert community.modularity(df, found).first()[0] > 0.5


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(200) if i % 17] + [(f"m{rng.randint(0, 60)}", f"m{rng.randint(0, 60)}") for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in community.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {n: find(n) for n in parent}


def refs(spark, rows):
    return spark.createDataFrame([(*r, "", "", "") if len(r) == 6 else r for r in rows], ", ".join(f"{c} string" for c in resolve.REF))


def test_fuzzy_rules_and_reasons(spark):
    """The rules that SQL can't say: names and meaning; and what is said when nothing fits."""
    names = ("db.s.orders.shipping_date_planned", "db.s.orders.cost", "db.s.base.number")
    columns = spark.createDataFrame([(n, n.rsplit(".", 1)[0], "s", n.split(".")[2], n.rsplit(".", 1)[1], "", "the total gross cost" if n.endswith("cost") else "", True) for n in names], "column_fqn string, table_fqn string, schema string, table string, column string, business_term string, definition string, system_of_record boolean")
    lineage = spark.createDataFrame([], "level string, src_fqn string, tgt_fqn string")
    got = refs(spark, [("", "", "", "orders", "shipping_date_planed", ""), ("", "", "", "orders", "total gross cost", ""), ("", "", "", "nowhere", "x", ""), ("", "", "", "orders", "", ""), ("", "", "", "nowhere", "x", "", "", "powerbi", "Import"), ("", "", "", "base", "zq", "")])
    out = {(r["table"], r["column"], r["tool"]): r for r in resolve.resolve(got, columns, lineage).collect()}
    assert out["orders", "shipping_date_planed", ""]["er_rule"] == "ER-4"
    assert out["orders", "total gross cost", ""]["er_rule"] in ("ER-4", "ER-6", None)
    assert out["nowhere", "x", ""]["reason"] == "NO_CATALOG_TABLE" and out["nowhere", "x", "powerbi"]["reason"] == "MODEL_TERMINUS"
    assert out["orders", "", ""]["reason"] == "MISSING_REFERENCE" and out["base", "zq", ""]["reason"] in ("NO_CATALOG_COLUMN", "LOW_CONFIDENCE")
    manual = spark.createDataFrame([(1, "base.zq", names[0]), (2, "base.zq", names[2])], "mapping_id int, raw_reference string, column_fqn string")
    (row,) = [r for r in resolve.resolve(got, columns, lineage, resolve.latest_mappings(manual)).collect() if r["column"] == "zq"]
    assert (row["er_rule"], row["column_fqn"]) == ("ER-0", names[2])
    near = resolve.nearest_table(spark.createDataFrame([("order",), ("zzz",)], "table string"), columns).collect()
    assert [(r["table"], r["nearest"]) for r in near] == [("order", "db.s.orders")]


def test_contracts(spark, tmp_path):
    assert contracts.suggest(["Term", "Definition", "Steward", "Status"])[0] == "business_glossary"
    assert contracts.suggest(["system", "schema_name", "table_name", "column_name", "steward", "domain"], "Collibra_Metadata")[0] == "collibra_metadata"
    assert contracts.suggest(["anything"], "Read Me") == ("", 0.0)
    assert contracts.map_headers("cognos_rationalization", ["ID", "Name", "BU"]) == {"report_id": "ID", "report_name": "Name", "business_unit": "BU"}
    assert "owner" in contracts.missing("cognos_rationalization", ["ID"])
    (tmp_path / "g.csv").write_text("Term,Meaning,Description\nRevenue,, money in \n")
    df = contracts.bind(tabular.load(spark, str(tmp_path / "g.csv")), "business_glossary", {"definition": "Meaning"})
    assert df.select("term", "definition", "steward").first() == ("Revenue", "money in", None)  # a blank mapped header falls back
    told = contracts.describe(df.select("term", "definition"), "Business_Glossary")
    assert told["contract"] == "business_glossary" and contracts.bindable([told]) == [told]
    assert {c for _, c, _ in contracts.coverage({"business_glossary"})} == {"MISSING_REQUIRED_INPUT", "NO_CATALOG_INPUT", "MISSING_RECOMMENDED_INPUT"}


def test_workbooks(spark, tmp_path):
    book = tabular.write_workbook({"One": [["Term", "n", "ok"], ["a <b>", 1, True], [None, 2.5, None]], "Two & more": [["x"]]})
    assert tabular.read_workbook(book)["One"] == [["Term", "n", "ok"], ["a <b>", "1", "true"], [None, "2.5", None]]
    (tmp_path / "b.xlsx").write_bytes(book)
    assert tabular.load(spark, str(tmp_path / "b.xlsx"), "One").collect()[0].asDict() == {"term": "a <b>", "n": "1", "ok": "true"}
