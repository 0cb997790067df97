import datetime as dt
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as X
from clausewright.functions import versioning as V
from clausewright.mining import html as H
from clausewright.mining import parsers as P
from clausewright.operators import content as C
from clausewright.operators import glossary as G
from clausewright.operators import lineage as L
from clausewright.operators import maintenance as M
from clausewright.operators import relations as R
from clausewright.operators.evaluation import gate, macro_mean, metrics, query_metrics
from clausewright.operators.snapshots import snapshot_changes
from clausewright.retrieval import arms as A
from clausewright.sources import files

CLAUSE = "chunk_id long, spec_id string, release string, version string, clause_path string, heading string, text string, is_normative boolean, embedding array<float>, embedding_hash string"


def clauses(spark, rows):
    """(chunk_id, spec, release, version, path, heading, text) as clauses."""
    return spark.createDataFrame([(*r, True, None, None) for r in rows], CLAUSE)


# --- snapshots ---------------------------------------------------------------------------


def changes(df):
    out = snapshot_changes(df, "spec_id", "version", F.trim("clause_path"), {"text": F.coalesce("text", F.lit("")), "heading": F.col("heading")}, [V.version_part("v", n) for n in (1, 2, 3)], "chunk_id")
    return sorted((r.spec_id, r.key, r.from_version, r.to_version, r.change_kind, tuple(r.columns or ())) for r in out.collect())


def test_snapshot_changes(spark):
    rows = [
        (1, "s", "r", "1.2.0", "4", "h", "a"),
        (2, "s", "r", "1.10.0", "4 ", "h", "b"),  # 1.2 -> 1.10 by number, path cleaned
        (3, "s", "r", "1.2.0", "5", "h", "x"),
        (4, "s", "r", "2.0.0", "4", "g", "b"),
        (5, "s", "r", "2.0.0", "5", "h", None),
        (6, "s", "r", "2.0.0", None, "h", "y"),
        (7, "s", "r", "2.0.0", "", "h", "y"),
        (8, "s", "r", "1.2.0", "4", "h", "b"),  # a late correction holds
        (9, None, "r", "1.0.0", "4", "h", "z"),
        (10, "t", "r", "1.0.0", "1", "h", "only"),
        (8, "s", "r", "1.2.0", "4", "h", "b"),
    ]
    assert changes(clauses(spark, rows)) == [
        ("s", "4", "1.10.0", "2.0.0", "changed", ("heading",)),
        ("s", "5", "1.10.0", "2.0.0", "added", ()),
        ("s", "5", "1.2.0", "1.10.0", "removed", ()),
    ]
    assert changes(clauses(spark, rows).limit(0)) == []


def test_a_snapshot_without_keys_still_counts(spark):
    rows = [(1, "s", "r", "1.0.0", "4", "h", "a"), (2, "s", "r", "2.0.0", None, "h", "a"), (3, "s", "r", "3.0.0", "4", "h", "a")]
    assert changes(clauses(spark, rows)) == [("s", "4", "1.0.0", "2.0.0", "removed", ()), ("s", "4", "2.0.0", "3.0.0", "added", ())]


def test_snapshot_text_hash_is_of_the_whole_value(spark):
    long = "x" * 300_000
    rows = [(1, "s", "r", "1.0.0", "4", "h", long + "a"), (2, "s", "r", "2.0.0", "4", "h", long + "b")]
    assert changes(clauses(spark, rows))[0][4:] == ("changed", ("text",))


# --- content addressing (a round trip) ------------------------------------------------------


def test_content_round_trip(spark):
    texts = [("23.501", "Rel-17", "AMF registration", "para one\n\npara two"), ("23.501", "Rel-18", "AMF registration", "para one\n\npara two"), ("23.501", "Rel-19", "AMF registration", "para one\n\npara three"), ("23.502", "Rel-18", "Other heading", "para one\n\npara two"), ("23.503", "Rel-18", "Blank runs", "a\n\n\n\nb"), ("23.504", "Rel-18", "Trailing", "x\n\n"), ("23.505", "Rel-18", "Empty body", ""), ("23.506", "Rel-18", None, "single line only"), ("23.507", "Rel-18", "", "single line only"), ("23.508", "Rel-18", "h", None)]
    df = clauses(spark, [(i, s, r, "18.0.0", "5.2", h, t) for i, (s, r, h, t) in enumerate(texts)])
    c = C.content_tables(df)
    assert c.bodies.count() == 8 and c.occurrences.count() == 9
    got = {r.chunk_id: (r.heading, r.text) for r in C.rebuilt_clauses(c).collect()}
    assert got == {i: (h, t) for i, (_, _, h, t) in enumerate(texts) if t is not None}
    v = C.verify_content(df, c).first()
    assert (v.held, v.rebuilt, v.exact) == (9, 9, 9)
    with pytest.raises(ValueError):
        C.refuse_to_shrink(3, 4)


# --- versions and lineage --------------------------------------------------------------------


def test_release_order(spark):
    df = spark.createDataFrame([("Rel-18",), ("Rel-99",), ("Rel-20",), ("Rel-4",), ("ETSI",), (None,)], "r string")
    assert [r.r for r in df.orderBy(V.release_ordinal("r").desc(), "r").collect()][:4] == ["Rel-20", "Rel-18", "Rel-4", "Rel-99"]


@pytest.mark.parametrize("a,b,sign", [("2.10.0", "2.9.0", 1), ("19.1", "19.1.0", 0), ("", "0.0.0", 0), ("1.2.3.4", "1.2.3", 0), ("19x.0.0", "0.0.0", 0)])
def test_version_compare(spark, a, b, sign):
    r = spark.createDataFrame([(a, b)], "a string, b string").select((V.version_key("a") > V.version_key("b")).alias("gt"), (V.version_key("a") < V.version_key("b")).alias("lt")).first()
    assert int(r.gt) - int(r.lt) == sign


def test_paragraph_lineage(spark):
    text = {16: "every release says this\n\ndropped in Rel-19", 19: "every release says this\n\nnew in Rel-19"}
    df = clauses(spark, [(n, "23.501", f"Rel-{n}", f"{n}.0.0", "5.2", "AMF", text[19 if n == 19 else 16]) for n in (16, 17, 18, 19)])
    got = {r.part: (r.introduced, r.last_seen, r.obsolete) for r in L.paragraph_lineage(df).collect()}
    assert got == {"every release says this": ("Rel-16", "Rel-19", False), "dropped in Rel-19": ("Rel-16", "Rel-18", True), "new in Rel-19": ("Rel-19", "Rel-19", False)}
    delta = L.paragraph_delta(df, F.col("release") == "Rel-18", F.col("release") == "Rel-19")
    assert {(r.part, r.side) for r in delta.collect()} == {("every release says this", "kept"), ("dropped in Rel-19", "removed"), ("new in Rel-19", "added")}


def test_version_axis(spark):
    df = clauses(spark, [(i, "ETSI TS 102 221", "ETSI", v, "11", "h", "t") for i, v in enumerate(["1.10.1", "1.2.1", "1.9.1"])])
    r = L.clause_lineage(df).first()
    assert list(r.present_in) == ["1.2.1", "1.9.1", "1.10.1"] and not r.obsolete


def test_refile(spark):
    versions = [("26.510", "Rel-20", "18.4.0"), ("26.510", "Rel-18", "18.1.0"), ("21.810", "Rel-4", "3.0.0"), ("33.816", "Rel-11", "10.0.0"), ("33.816", "Rel-10", "10.0.0"), ("36.833", "Rel-13", "0.4.0")]
    occ = [(s, r, v) for s, r, v in versions]
    plan = L.refile_plan(spark.createDataFrame(versions, "spec_id string, release string, version string"), spark.createDataFrame(occ, "spec_id string, release string, version string"))
    assert {r.spec_id: (r.target, r.verdict) for r in plan.collect()} == {"26.510": ("Rel-18", "move"), "21.810": ("Rel-99", "no own release"), "33.816": ("Rel-10", "copy there")}


def test_dated_changes(spark):
    listed = spark.createDataFrame([("s", "1.9.1", "CR1"), ("s", "1.10.1", "CR1"), ("s", "1.10.1", "CR2"), ("s", "1.8.1", "CR0")], "spec_id string, version string, item string")
    versions = spark.createDataFrame([("s", v) for v in ("1.8.1", "1.9.1", "1.10.1")], "spec_id string, version string")
    assert {(r.item, r.from_version, r.to_version) for r in M.date_changes(listed, versions).where("declined is null").collect()} == {("CR1", "1.8.1", "1.9.1"), ("CR2", "1.9.1", "1.10.1")}


# --- retrieval ------------------------------------------------------------------------------------


def test_rrf_keys_on_place(spark):
    a = spark.createDataFrame([(1, "s", "1", 1, 7), (1, "s", "2", 2, 8)], "query_id long, spec string, clause string, rank int, chunk long")
    b = spark.createDataFrame([(1, "s", "1", 2, 9), (1, "t", "1", 1, 7)], a.schema)
    out = {(r.spec, r.clause): (r.score, r["rank"], r.chunk) for r in A.rrf([a, b], ["spec", "clause"], carry=["chunk"]).collect()}
    assert out["s", "1"] == (round(1 / 61 + 1 / 62, 9), 1, 7) and len(out) == 3
    assert A.rrf([b, a], ["spec", "clause"]).count() == 3
    assert out["t", "1"][1] == 2 and out["s", "2"][1] == 3


def test_sparse_scores(spark):
    p = spark.createDataFrame([(1, 100, 0.9), (1, 300, 0.1), (2, 200, 0.8), (2, 200, 0.5)], "chunk_id long, term_id long, weight float")
    q = spark.createDataFrame([(1, 100, 1.0), (1, 200, 0.5)], "query_id long, term_id long, weight float")
    assert {r.chunk_id: round(r.score, 6) for r in A.sparse_scores(p, q).collect()} == {1: 0.9, 2: 0.4}


def test_dense_is_exact_in_blocks(spark, monkeypatch):
    rows = [(i, [1.0 if k == i % 5 else 0.1 * i for k in range(5)]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    want = A.exact_nearest(df, df.where("id % 7 = 0"), "id", "v", 3, 5).collect()
    monkeypatch.setattr(A, "MAX_QUERY_VECTORS", 2)
    got = A.exact_nearest(df, df.where("id % 7 = 0"), "id", "v", 3, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 12


def test_metrics(spark):
    judged = [("33.128", "6.2.2.2", 2)]
    ndcg, recall, mrr, s1 = query_metrics([("33.128", "6.2.2.2.1"), ("33.128", "6.2.2.2.2"), ("33.128", "6.2.2.2")], judged, 10)
    assert ndcg <= 1 and recall == 1 and mrr == 1 and s1 == 0
    assert query_metrics([("33.128", "6.2.2.2")], judged, 10) == (1, 1, 1, 1)
    hits = spark.createDataFrame([(1, "33.128", "6.2.2.2", 1)], "query_id long, spec_id string, clause string, rank int")
    j = spark.createDataFrame([(1, *judged[0]), (2, *judged[0])], "query_id long, spec_id string, clause string, grade int")
    m = metrics(hits, j)
    assert macro_mean(m).first().ndcg == 0.5 and macro_mean(m.limit(0)).first().mrr == 0
    cur = spark.createDataFrame([("a", "ndcg", 0.5)], "system string, metric string, value double")
    base = spark.createDataFrame([("a", "ndcg", 0.51), ("a", "mrr", 0.1)], cur.schema)
    assert {r.metric: r.passed for r in gate(cur, base).collect()} == {"ndcg": True, "mrr": False}


# --- relations --------------------------------------------------------------------------------------


def test_dml(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (None, "C"), (3, "d")], base.schema)
    as_set = lambda df: {(r.k, r.v) for r in df.collect()}
    assert as_set(R.upsert(base, new, ["k"])) == {(1, "a"), (2, "B"), (None, "C"), (3, "d")}
    assert as_set(R.insert_ignore(base, new, ["k"])) == {(1, "a"), (2, "b"), (None, "c"), (3, "d")}
    assert R.same_multiset(base, base.orderBy(F.desc("v"))) and not R.same_multiset(base, base.unionByName(base.limit(1)))
    path = str(tmp_path / "t")
    assert R.write_if_changed(base, path) and not R.write_if_changed(base.repartition(3), path)
    assert R.write_if_changed(new, path) and spark.read.parquet(path).count() == 3


def test_glossary(spark):
    rows = [("AMF", "ATM Mapping Functions", "d", "", None), ("AMF", "Authentication Management Field", "d", "21", 9), ("AMF", "Zone", "d", "23.501", 1)]
    df = spark.createDataFrame(rows, "term string, expansion string, domain string, source_series string, declared_by int")
    assert [r.expansion for r in G.authority_order(df).orderBy("place").collect()] == ["Zone", "Authentication Management Field", "ATM Mapping Functions"]
    batch = spark.createDataFrame([("AMF", "New", "d", "23.502")], "term string, expansion string, domain string, source_series string")
    plan = {r.expansion: r.action for r in G.plan_replacement(df.drop("declared_by"), batch, df.limit(0)).collect()}
    assert plan == {"ATM Mapping Functions": "untouched", "Authentication Management Field": "retired", "Zone": "removed", "New": "written"}
    assert {r.expansion: r.action for r in G.plan_replacement(df.drop("declared_by"), batch, None).collect()}["Zone"] == "withheld"


# --- parsers -------------------------------------------------------------------------------------------


def test_html_clauses():
    page = "<h1>1  Scope</h1><p>First  line.</p><table><tr><td>a</td><td>b</td></tr></table><h2>1.1 Sub</h2><h1>Annex B (informative): Extra</h1><li>item</li><h1>Change history</h1><p>gone</p>"
    found, history, salvaged = H.parse_clauses(page)
    assert history and not salvaged
    assert [(c.clause_path, c.lines, c.is_normative) for c in found] == [("1", ["First line.", "a\tb"], True), ("B", ["item"], False)]
    found, _, salvaged = H.parse_clauses("<p>1 Scope</p><p>Text here.</p>")
    assert salvaged and found[0].clause_path == "1" and found[0].lines == ["Text here."]
    assert H.parse_clauses(None)[0] == []


def test_line_parsers():
    text = "For the purposes of this document:\nAMF\tAccess and Mobility\n  Management Function\nNOTE 1: x\nUPF\tUser Plane Function"
    assert P.parse_abbreviations(text) == [("AMF", "Access and Mobility Management Function"), ("UPF", "User Plane Function")]
    assert P.initials_match("UPF", "User Plane Function") and not P.initials_match("UPX", "User Plane Function")
    assert P.parse_change_line("CR002r1 (cat B) two") == ("CR002", 1, "B", "two") and P.parse_change_line("CR001 (cat F) one") == ("CR001", None, "F", "one")
    module = "XIRIEvent ::= CHOICE\n{\n  -- AMF events, see clause 6.2.2.2\n  registration [1] AMFRegistration,\n}\nAMFRegistration ::= SEQUENCE\n{\n  a [1] INTEGER,\n  b [2] UTF8String OPTIONAL\n}\nMode ::= ENUMERATED\n{\n  on(1),\n  off(2)\n}"
    types = P.parse_asn1(module)
    assert [(t["name"], t["kind"], len(t["members"])) for t in types] == [("XIRIEvent", "choice", 1), ("AMFRegistration", "sequence", 2), ("Mode", "enumerated", 2)]
    assert P.asn1_events(types) == [{"interface": "X2", "nf": "AMF", "domain": "5GC", "event": "registration", "type": "AMFRegistration", "tag": 1, "clause": "6.2.2.2", "fields": 2}]
    assert P.parse_abbreviations("UA\tUser Agent\n*****\nEND SET OF CHANGES *****\n***** BEGIN SET OF CHANGES *****\nlost tail") == [("UA", "User Agent")]
    assert P.parse_abbreviations("Intro line here\n5GC 5G Core Network\n5G AV 5G Authentication Vector\nNG-RAN 5G Radio Access Network") == [("5GC", "5G Core Network"), ("5G AV", "5G Authentication Vector")]
    assert P.parse_abbreviations(None) == P.parse_abbreviations("Row of cells\tthe table\nx\ty") == []
    assert P.initials_match("4G", "Generation four") and P.initials_match("3GPP", "Third Generation Partnership Project") and not P.initials_match("", "x") and not P.initials_match("123", "one")
    assert P.plausible("NWDAF", "Network Data Analytics Function") and not P.plausible("a.b", "a b c") and not P.plausible("amf", "access")


def test_openapi():
    doc = '{"info": {"version": "1.2"}, "paths": {"/a": {"get": {"operationId": "GetA", "responses": {"404": {}, "200": {}}}, "post": {"requestBody": {"content": {"x": {"schema": {"$ref": "#/components/schemas/B"}}}}}}}, "components": {"schemas": {"B": {"type": "object", "properties": {"z": {"$ref": "#/c/C"}, "a": {}}}, "C": {"anyOf": [{"enum": ["x", "y"]}]}}}}'
    ops, schemas = P.parse_openapi(doc)
    assert [(o["method"], o["request_schema"], o["response_codes"]) for o in ops] == [("GET", "", ["200", "404"]), ("POST", "B", [])]
    assert schemas[0]["refs_out"] == ["C"] and schemas[1]["kind"] == "enum" and schemas[1]["enum_values"] == ["x", "y"]


def test_catalogue_pages():
    page = "<table><tr><th>Code</th><th>Name</th><th>Status</th><th>Start date</th><th>Freeze</th></tr><tr><td>Rel-18</td><td>Release 18</td><td>Frozen</td><td>2020-01-02</td><td>2024-06-21 (SA#104)</td></tr></table>"
    assert P.parse_releases(page) == [{"code": "Rel-18", "name": "Release 18", "status": "Frozen", "start_date": dt.date(2020, 1, 2), "freeze_date": dt.date(2024, 6, 21), "freeze_meeting": "SA#104"}]


# --- files ------------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    assert files.decode("é".encode("cp1252")) == "é" and files.decode("é".encode()) == "é"
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.htm").write_bytes("é€".encode("cp1252"))
    (tmp_path / "h/b.html").write_bytes("é€".encode())
    assert [r.html for r in files.read_html(spark, str(tmp_path / "h")).collect()] == ["é€", "é€"]
    (tmp_path / "l.json").write_text('{"id":1,"hash":"a","vec":[1,2]}\nnot json\n{"id":2,"hash":"b","vec":[1]}\n')
    assert [r.id for r in files.read_ledger(spark, str(tmp_path / "l.json"), 2).collect()] == [1]
    df = spark.createDataFrame([("x/23501-i40.zip", "<!-- ETSI TS 103 221-1 V1.8.1 -->"), ("none", "")], "p string, h string")
    r = df.select(files.file_metadata(F.col("p")).alias("f"), files.etsi_header(F.col("h")).alias("e")).collect()
    assert tuple(r[0].f) == ("23.501", "18.4.0") and tuple(r[0].e) == ("ETSI TS 103 221-1", "1.8.1") and tuple(r[1].f) == (None, None)


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Spec</t></si><si><t>CR</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>23.501</t></is></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(data.getvalue())
    assert [tuple(r) for r in files.read_workbooks(spark, str(tmp_path), ["CR", "Spec"]).collect()] == [("7", "23.501")]


def test_scalars(spark):
    df = spark.createDataFrame([(" a  b c ", "x y"), ("w " * 300, None)], "t string, h string")
    r = df.select(X.collapse("t").alias("c"), F.size(X.windows("t", 128)).alias("n"), X.content_hash("h", "t", "m").alias("k")).collect()
    assert r[0].c == "a b c" and [x.n for x in r] == [1, 3] and len(r[0].k) == 16


def test_plans(spark, tmp_path):
    """Filters reach the scan, ranked cuts are top-k, and nothing is a Cartesian product."""
    path = str(tmp_path / "c")
    clauses(spark, [(i, "s", f"Rel-{i % 3 + 4}", "4.0.0", str(i), "h", "t") for i in range(50)]).write.parquet(path)
    df = spark.read.parquet(path)
    plan = lambda d: d._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    p = plan(df.where("release = 'Rel-5'").select("chunk_id").orderBy("chunk_id").limit(3))
    assert "EqualTo(release,Rel-5)" in p and "TakeOrderedAndProject" in p and "text:string" not in p
    p = plan(snapshot_changes(df, "spec_id", "version", F.col("clause_path"), {"text": F.col("text")}, [V.version_part("v", 1)], "chunk_id"))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_streams(spark, tmp_path):
    from clausewright.streaming.ingest import hourly_counters, keep_new, kept

    src = str(tmp_path / "in")
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(t0 + dt.timedelta(minutes=20 * i), "a", 1.0) for i in range(6)], "ts timestamp, event_type string, value double").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src)
    q = hourly_counters(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("hours").collect()) == [3, 3]
    add = keep_new(str(tmp_path / "out"), ["k"])
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    add(batch, 0)
    add(batch, 0)
    add(spark.createDataFrame([(2, "x"), (3, "c"), (3, "d"), (None, "e")], batch.schema), 1)
    assert sorted((r.k or 0) for r in kept(spark, str(tmp_path / "out")).collect()) == [0, 1, 2, 3]
    # a batch that stopped half-way counts for nothing, and is written again
    os.remove(tmp_path / "out" / "batch=1" / "_SUCCESS")
    assert kept(spark, str(tmp_path / "out")).count() == 2
    add(spark.createDataFrame([(2, "x"), (3, "c"), (3, "d"), (None, "e")], batch.schema), 1)
    assert kept(spark, str(tmp_path / "out")).count() == 4
    with pytest.raises(FileNotFoundError):
        kept(spark, str(tmp_path / "none"))


def test_a_swap_that_stops_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    held = lambda: sorted(r.k for r in R.read_table(spark, path).collect())
    assert R.read_table(spark, path) is None
    assert R.write_if_changed(rows(1, 2, 3), path) and not R.write_if_changed(rows(3, 2, 1), path)
    # stopped while the new copy was being written
    rows(9).write.parquet(path + ".next")
    os.remove(path + ".next/_SUCCESS")
    assert held() == [1, 2, 3]
    # stopped between the two renames, before or after the new copy was whole
    os.rename(path, path + ".old")
    assert held() == [1, 2, 3]
    rows(1, 2, 3, 4).write.mode("overwrite").parquet(path + ".next")
    os.rename(path, path + ".old")
    assert held() == [1, 2, 3, 4] and not os.path.exists(path + ".old")
    # stopped before the old copy was deleted
    rows(7).write.parquet(path + ".old")
    assert R.write_if_changed(rows(5), path) and held() == [5]


def test_index_grows_by_content(spark, tmp_path):
    from clausewright.retrieval import index as I
    from clausewright.retrieval import search as S

    path = str(tmp_path / "index")
    rows = [(i, f"{20 + i % 2}.501", f"Rel-{17 + i % 3}", f"{17 + i % 3}.0.0", f"5.{i // 3}", "Head", f"the access node {'alpha' if i % 4 else 'beta'}\n\npart {i}") for i in range(12)]
    df = clauses(spark, rows)
    terms = spark.createDataFrame([(i, i % 3, 1.0 + i) for i in range(12)], "chunk_id long, term_id long, weight float")
    assert I.extend_index(df.where("chunk_id < 7"), terms.where("chunk_id < 7"), path, 2)
    assert I.extend_index(df, terms, path, 2) and not I.extend_index(df, terms, path, 2) and I.generations(spark, path) == [1, 2]
    whole = str(tmp_path / "whole")
    I.extend_index(df, terms, whole, 2)
    q = spark.createDataFrame([(1, "beta node")], "query_id long, query_text string")
    t = spark.createDataFrame([(1, 1, 2.0)], "query_id long, term_id long, weight float")
    hits = lambda p, **f: [(r.rank, r.chunk_id, r.score) for r in S.search_spec(I.open_index(spark, p), q, t, None, S.SearchRequest(**f)).orderBy("rank").collect()]
    assert hits(path) == hits(whole) and len(hits(path)) > 3
    assert all(rows[c][2] == "Rel-18" for _, c, _ in hits(path, release="Rel-18")) and len(hits(path, release="Rel-18")) > 1
    # a generation without its mark doesn't count
    import shutil

    shutil.rmtree(path + "/marks/gen=2")
    assert I.open_index(spark, path).occurrences.count() == 7
    plan = I.paragraph_scores(I.open_index(spark, whole), q)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]


def test_arms_that_cannot_serve_are_reported():
    from clausewright.retrieval import search as S

    r = S.SearchRequest()
    assert r.arms({"lexical": None, "sparse": "no query terms", "dense": None}) == ["lexical", "dense"]
    assert r.report == {"mode_asked": "hybrid", "mode_served": "hybrid", "arms": ["lexical", "dense"], "degraded": {"sparse": "no query terms"}}
    r = S.SearchRequest(mode="dense")
    assert r.arms({"dense": "no query vectors"}) == ["lexical"] and r.report["mode_served"] == "lexical"
    with pytest.raises(ValueError):
        S.SearchRequest(mode="magic").arms({})
    c = S.write_cursor(20, "q", "")
    assert S.read_cursor(c, "q", "") == 20 and S.fnv1a(b"a", 32) == 0xE40C292C and S.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    for bad in (c[:-3], "###", S.write_cursor(20, "other", "")):
        with pytest.raises(ValueError):
            S.read_cursor(bad, "q", "")


def test_tools(spark, tmp_path):
    from clausewright.api import Corpus

    d = str(tmp_path)
    rows = [(i, "23.501", "Rel-18", f"18.{i % 2}.0", f"5.{i // 2}", f"Heading {i}", f"registration of the access node, clause 5.{i % 3}\n\npart {i}") for i in range(8)]
    clauses(spark, rows).write.parquet(f"{d}/clauses.parquet")
    for name, schema, data in (
        ("specs", "spec_id string, series string, title string, doc_type string, working_group string", [("23.501", "23", "System", "TS", "S2")]),
        ("spec_versions", "spec_id string, release string, version string, freeze_date date, docx_url string, status string, metadata_source string", [("23.501", "Rel-18", "18.0.0", None, None, None, None), ("23.501", "Rel-18", "18.1.0", None, None, None, None)]),
        ("clause_sparse", "chunk_id long, term_id long, weight float", [(1, 1, 0.5)]),
        ("search_queries", "query_id long, query_text string, intent string", [(1, "access node", None)]),
        ("query_terms", "query_id long, term_id long, weight float", [(1, 1, 1.0)]),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    c = Corpus(spark, d)
    page = c.search_spec("access node", k=2)
    hits = page.rows.collect()
    assert len(hits) == 2 and hits[0].resource.startswith("3gpp://23.501/Rel-18/5.") and page.report["degraded"] == {"dense": "no query vectors"}
    last = c.search_spec("access node", k=2, cursor=page.next_cursor)
    assert [r["rank"] for r in last.rows.collect()] == [3, 4] and last.next_cursor == ""
    with pytest.raises(ValueError):
        c.search_spec("access", cursor=page.next_cursor)
    assert c.get_spec("23.501").count() == 4 and c.get_spec("23.501", version="18.0.0", clause="5.1").count() == 1
    assert c.list_specs().first().latest == "18.1.0" and c.list_specs(doc_type="TR").count() == 0
    assert [r.version for r in c.list_releases("23.501").collect()] == ["18.1.0", "18.0.0"]
    assert {r.change_kind for r in c.get_changelog("23.501", "Rel-18").collect()} == {"changed"}
    assert c.get_changelog("23.501", "19").count() == 0
    with pytest.raises(ValueError):
        c.get_changelog("23.501", "soon")
    assert c.trace_clause("23.501", "5.1", "18.0.0", "18.1.0").count() > 0
    with pytest.raises(ValueError):
        c.trace_clause("23.501", "5.1", "1.0.0", "18.1.0")
    assert c.find_cross_references("23.501").count() == 8
    assert {r.key: r.value for r in c.server_info().collect()}["clauses"] == 8


def test_a_corpus_from_nothing(spark, tmp_path):
    from clausewright.sources import tables as S

    d = str(tmp_path)
    assert "clauses" in S.prepare(spark, d) and S.prepare(spark, d) == []
    assert S.capabilities(spark, d) == {"clauses": False, "sparse": False, "dense": False, "queries": False, "changelog": False}
    S.append(clauses(spark, [(i, "s", "Rel-1", "1.0.0", str(i), "h", f"t{i}") for i in range(20)]), f"{d}/clauses.parquet")
    assert S.capabilities(spark, d)["clauses"] and not S.capabilities(spark, d)["dense"]
    copy = S.compact(spark, f"{d}/clauses.parquet", f"{d}/copy.parquet", 10)
    assert copy.count() == 20 and len(copy.inputFiles()) == 2
    spark.createDataFrame([("schema_version", "0")], "key string, value string").write.mode("overwrite").parquet(f"{d}/meta.parquet")
    with pytest.warns(UserWarning):
        S.capabilities(spark, d)


def test_changes_are_dated_or_declined(spark):
    listed = [("a", "1.9.1", "CR001"), ("a", "1.10.0", "CR001"), ("a", "1.10.0", "CR002"), ("a", "1.8.1", "CR000"), ("b", "1.0.0", "CR1"), ("b", "1.1.0", "CR2"), ("c", "1.0.0", "CR1"), ("c", "1.2.0", "CR3")]
    versions = [("a", "1.8.1", True), ("a", "1.9.1", True), ("a", "1.10.0", True), ("b", "1.0.0", False), ("b", "1.1.0", True), ("c", "1.0.0", True), ("c", "1.2.0", True)]
    published = [("c", "1.0.0"), ("c", "1.1.0"), ("c", "1.2.0"), ("a", "2.0.0"), ("a", "1.0.0")]
    rows = [(*r, True) for r in listed] + [("a", "1.9.1", "CR9", False), ("a", "1.10.0", "CR9", True)]
    got = M.date_changes(spark.createDataFrame(rows, "spec_id string, version string, item string, strict boolean"), spark.createDataFrame(versions, "spec_id string, version string, has_annex boolean"), spark.createDataFrame(published, "spec_id string, version string"))
    assert sorted((r.spec_id, r.item, r.from_version, r.to_version, r.declined) for r in got.collect()) == sorted(
        [
            ("a", "CR000", None, None, "first version"), ("a", "CR001", "1.8.1", "1.9.1", None), ("a", "CR002", "1.9.1", "1.10.0", None),
            ("b", "CR1", None, None, "first version"), ("b", "CR2", None, None, "no annex before"), ("c", "CR1", None, None, "first version"), ("c", "CR3", None, None, "publication missing"),
        ],
        key=lambda r: r[:2],
    )


def test_merge_overlay_and_footprints(spark):
    vec = lambda *rows: spark.createDataFrame([(*r[:6], r[6], True, r[7], None) for r in rows], CLAUSE)
    base = vec((1, "s", "Rel-1", "1.0.0", "1", "h", "a", [1.0]), (2, "t", "Rel-1", "1.0.0", "1", "h", "b", None))
    newer = vec((1, "s", "Rel-1", "1.1.0", "1", "h", "a", None), (2, "s", "Rel-1", "1.1.0", "2", "h", "c", None))
    same = vec((1, "t", "Rel-1", "1.0.0", "1", "h", "b", None))
    corpus, report = M.merge_shards(base, [newer, same], ["heading", "text"], "embedding")
    assert sorted((r.chunk_id, r.version, r.text, r.embedding) for r in corpus.collect()) == [(2, "1.0.0", "b", None), (4, "1.1.0", "a", [1.0]), (5, "1.1.0", "c", None)]
    assert [(r.shard, r.spec_id, r.why) for r in report.collect()] == [(0, "s", "version")]
    over = M.overlay_vectors(base, vec((9, "t", "Rel-1", "1.0.0", "1", "h", "b", [2.0])), ["spec_id", "version", "clause_path"], "embedding", "m", "m")
    assert {r.chunk_id: r.embedding for r in over.collect()} == {1: [1.0], 2: [2.0]}
    with pytest.raises(ValueError):
        M.overlay_vectors(base, base, ["chunk_id"], "embedding", "m", "other")
    foot = lambda *r: spark.createDataFrame(list(r), "subject string, series string, footprint string")
    was, now = foot(("li", "33", "a"), ("li", "34", "b"), ("x", "22", "c")), foot(("li", "33", "A"), ("li", "34", "B"), ("x", "22", "c"), ("y", "11", "d"))
    assert sorted(r.series for r in M.series_to_rebuild(was, now).collect()) == ["11", "33", "34"]
    done = spark.createDataFrame([("33",), ("11",)], "series string")
    assert sorted(map(tuple, M.effective_footprints(was, now, done).collect())) == [("li", "33", "a"), ("li", "34", "b"), ("x", "22", "c"), ("y", "11", "d")]
    rows = clauses(spark, [(1, "s", "r", "1", "4", "h", "a"), (2, "s", "r", "1", "4", "h", "a"), (3, "s", "r", "1", "5", "h", "b")])
    posts = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "chunk_id long, term_id long")
    p, c = M.repaired(rows, posts, 1)
    assert sorted(r.chunk_id for r in c.collect()) == sorted(r.chunk_id for r in p.collect()) == [1, 3]
    with pytest.raises(ValueError):
        M.repaired(rows, posts, 2)


def test_numbers_that_are_no_int_leave_their_list_not_their_row(spark, tmp_path):
    from clausewright.plans import all_queries

    rows = [(1, [1.2, float("nan"), 9.0]), (2, [float("nan"), -1.6]), (3, [float("inf"), 1e10]), (4, [2.5, -0.5]), (5, [None, 3.5]), (6, None), (7, [])]
    spark.createDataFrame(rows, "chunk_id long, embedding array<float>").write.parquet(f"{tmp_path}/clauses.parquet")
    got = {r.chunk_id: r["head"] for r in all_queries()["sca_16_null_lists"](spark, str(tmp_path)).collect()}
    assert got == {1: "1", 2: "-2", 3: "", 4: "2,0", 5: "4", 6: "", 7: ""}


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("shared", [2, 90])
def test_blocks_give_the_best_of_all_rows(monkeypatch, grouped, shared):
    import numpy as np

    from clausewright.retrieval import products as P

    for name, v in (("BLOCK", 40), ("FIRST", 9), ("POSTINGS", 300)):
        monkeypatch.setattr(P, name, v)
    rng = np.random.default_rng(shared)
    n, words, k = 400, shared, 5
    w = np.round(rng.random((n, words)), 1) * (rng.random((n, words)) < 0.3)  # many equal scores, rows without a posting
    group = np.sort(rng.integers(0, 60, n)) if grouped else np.arange(n)
    asks = [rng.choice(words, min(words, int(rng.integers(1, 5))), replace=False) for _ in range(30)]
    best = P.Best(P.Asked(list(range(30)), np.cumsum([0, *map(len, asks)]), np.concatenate(asks).astype(np.int32), [str(i) for i in range(words)]), k)
    for a in range(0, n, 130):
        row, term = np.nonzero(w[a : a + 130])
        best.add(row, term, w[a : a + 130][row, term], np.arange(a, min(n, a + 130)), group[a : a + 130] if grouped else None, np.arange(a, min(n, a + 130)) + 1000)
    got: dict = {}
    for r in best.rows().to_pylist():
        got.setdefault(r["query_id"], []).append((r["row_id"], r["score"]))
    for q, terms in enumerate(asks):
        s = np.round(w[:, terms].sum(1), 9)
        want, seen = [], set()
        for i in sorted(np.flatnonzero(s > 0), key=lambda i: (-s[i], i)):
            if group[i] not in seen and len(want) < k:
                seen.add(group[i])
                want.append((i + 1000, s[i]))
        assert got.get(q, []) == want


def test_no_row_for_each_query_and_match_leaves_a_task(spark):
    from clausewright.retrieval import products as P

    docs = spark.createDataFrame([(i, f"node {'alpha ' * (i % 7)}{'Beta' if i % 3 else ''} x{i}" if i else None) for i in range(600)], "id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "node alpha"), (2, "Node, node beta"), (3, "x17"), (4, "absent"), (5, ""), (1, "beta node")], "query_id long, query_text string")
    got = P.bm25_top(docs, "id", "text", queries, 10)
    assert got.count() <= got.rdd.getNumPartitions() * 3 * 10
    alike = spark.createDataFrame([(1, "node alpha beta"), (2, "node beta"), (3, "x17"), (4, "absent")], "query_id long, query_text string")
    want = A.top_k(A.bm25(docs, "id", "text", alike), 10, ["doc_id"])
    rows = lambda df, c: sorted((r.query_id, r["rank"], r[c], round(r.score, 8)) for r in df.collect())
    assert rows(A.top_k(got, 10, ["row_id"]), "row_id") == rows(want, "doc_id") and want.count() == 21


def test_clauses_are_ranked_in_blocks_and_shuffle_files_go(spark, tmp_path, monkeypatch):
    import gc
    import random

    from clausewright.retrieval import index as I
    from clausewright.retrieval import search as S

    r = random.Random(3)
    parts = [" ".join(r.choice("alpha beta gamma delta node of the".split()) for _ in range(r.randint(1, 6))) for _ in range(40)]
    rows = [(i, f"{r.randint(21, 24)}.501", f"Rel-{17 + i % 3}", f"{17 + i % 3}.{r.randint(0, 2)}.0", r.choice([None, "4", "5.1", "5.10"]), "Head", "\n\n".join(r.choices(parts, k=r.randint(1, 4)))) for i in range(300)]
    env, as_java = spark._jsc.sc().env(), spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    files = lambda: sum(f.getName().startswith("shuffle_") for f in as_java(env.blockManager().diskBlockManager().getAllFiles()))
    gc.collect()
    was = files()
    I.extend_index(clauses(spark, rows), spark.createDataFrame([(1, 1, 1.0)], "chunk_id long, term_id long, weight float"), str(tmp_path / "i"), 2)
    assert files() <= was
    index = I.open_index(spark, str(tmp_path / "i"))
    assert {len(x.para_id) for x in index.tokens.collect()} == {16}
    q = spark.createDataFrame([(1, "alpha node"), (2, "the beta of gamma"), (3, "delta"), (4, "nothing"), (5, None)], "query_id long, query_text string")
    monkeypatch.setattr(S, "TASK_PARAGRAPHS", 5)  # clauses lie in several tasks
    key = lambda df: sorted((x.query_id, x["rank"], x.chunk_id, x.spec_id, str(x.clause_path), x.release, x.version, round(x.score, 8)) for x in df.collect())
    for pool in (index, index.narrowed(release="Rel-18")):
        got = S.lexical_arm(pool, q, 7)
        plain = I.paragraph_scores(pool, q).join(pool.body_parts, "para_id").groupBy("query_id", "body_id").agg(F.max("score").alias("score"))
        assert key(got) == key(S.per_clause(plain, pool, 7)) and got.count() == 21
        assert "MapInArrow" in got._jdf.queryExecution().toString()  # pairs of queries and paragraphs are no rows
