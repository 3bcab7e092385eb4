"""Dumps, register, consultations, acts, stages and streams, from small files."""

import json

import pytest
from pyspark.sql import functions as F

from warpline.plans import store
from warpline.sources import acts, dump, feedback, register
from warpline.streaming import origins as streaming


def test_dump_lines(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"id": "1", "date": "2024-01-02T00:00:00"}\n,{"id": "2", "date": "2024-03-02T00:00:00"}\n]\n')
    lines = dump.dump_lines(spark, str(tmp_path / "d.json"))
    assert [json.loads(r.value)["id"] for r in lines.collect()] == ["1", "2"]
    assert dump.dump_lines(spark, str(tmp_path / "d.json"), '"2"').count() == 1
    assert dump.latest_date(lines).first().latest == "2024-03-02"
    found = dump.provenance(spark, str(tmp_path / "d.json"), "dumps").first()
    assert found.document_id == "doc:dumps:d" and len(found.sha256) == 64


def test_catalog_entries(spark):
    dossier = {
        "procedure": {"reference": "2021/0106(COD)", "title": " AI ", "stage_reached": "Procedure completed", "subject": {"3.30": "Info"}, "final": {"url": "x?uri=CELEX:32024R1689"}},
        "events": [
            {"date": "2021-04-21T00:00:00", "type": "Legislative proposal published", "docs": [{"title": "COM(2021)0206"}, {"title": "SEC"}]},
            {"date": "2024-07-12", "type": "Final act published in Official Journal"},
            {"date": "bad", "type": "Final act published in Official Journal"},
        ],
        "committees": [{"type": "Opinion"}, {"type": "Joint Responsible Committee", "committee": ["IMCO", "LIBE"], "rapporteur": [{"name": " A B "}, {"name": ""}]}],
    }
    rows = [json.dumps(x) for x in (dossier, {"other": 1}, {"procedure": {"reference": "COM(2019)0308"}})]
    entries, skipped = dump.catalog(dump.read_dump(spark.createDataFrame([(r,) for r in rows], "value string"), dump.DOSSIER))
    e = entries.first()
    assert (e.title, e.status, e.subjects, e.celex_final, e.com_references, e.lead_committee, e.rapporteurs) == ("AI", "completed", ["3.30 Info"], "32024R1689", ["COM(2021)206"], "IMCO/LIBE", ["A B"])
    assert (str(e.proposed_on), str(e.completed_on), str(e.last_activity_on)) == ("2021-04-21", "2024-07-12", "2024-07-12")
    assert {r.reason: r.n for r in skipped.collect()} == {"no_procedure": 1, "reference_not_a_procedure": 1}


def test_amendment_records(spark):
    base = {"reference": "2021/0106(COD)", "committee": ["IMCO"], "date": "2022-06-01T00:00:00"}
    records = [
        base | {"id": "A-1", "seq": 3, "new": ["x", "y"], "meps": [7], "authors": "A  B, C ,"}, base | {"id": "A-1", "new": ["again"]}, base | {"id": None, "new": ["x"]},
        base | {"id": "A-2", "old": [" "], "new": []}, base | {"id": "A-3", "old": "", "new": "z", "location": [["Article 1", "p"], "Recital 2"]}, base | {"id": "A-4", "reference": "other", "new": ["x"]},
    ]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "place int, value string")
    parsed = frame.select("place", F.from_json("value", dump.AMENDMENT).alias("r")).select("place", "r.*")
    kept, skipped = dump.amendments(parsed, "2021/0106(COD)", "committee")
    got = {r.amendment_id: r for r in kept.collect()}
    one, three = got["am:2021-0106-COD:IMCO:A-1"], got["am:2021-0106-COD:IMCO:A-3"]
    assert (one.old_text, one.new_text, one.author_ids, one.author_names, one.number) == (None, "x\ny", ["actor:mep:7"], ["A B", "C"], 3)
    assert (three.old_text, three.new_text, three.target_provision) == ("", "z", "Article 1 - p; Recital 2")
    assert {r.reason: r.n for r in skipped.collect()} == {"duplicate_id": 1, "no_id": 1, "no_text": 1}


def test_members(spark):
    value = json.dumps({"UserID": 5, "Name": {"full": "X"}, "Groups": [{"groupid": "A", "start": "2014-01-01T00:00:00", "end": "2019-01-01T00:00:00"}, {"groupid": "B", "start": "2019-01-02T00:00:00", "end": "9999-12-31T00:00:00"}]})
    records = dump.read_dump(spark.createDataFrame([(value,)], "value string"), dump.MEMBER)
    m = dump.members(records, spark.createDataFrame([(5,), (6,)], "member_id long")).first()
    assert (m.actor_id, m.latest_group, [s.group for s in m.spells]) == ("actor:mep:5", "B", ["A", "B"])


def test_register(spark, tmp_path):
    entry = lambda i, name, cost: f"<interestRepresentative><identificationCode>{i}</identificationCode><name><originalName>{name}</originalName></name><headOffice><country> belgium </country></headOffice><financialData><closedYear>{cost}</closedYear></financialData></interestRepresentative>"
    band = "<costs currency='€'><range><min>100</min><max>300</max></range></costs>"
    floor, dollars = "<costs currency='€'><range><min>100</min></range></costs>", "<costs currency='$'><absoluteCost>5</absoluteCost></costs>"
    (tmp_path / "r.xml").write_text("<resultList>" + entry("123456-78", "A  B", band) + entry("223456-78", "C", floor) + entry("323456-78", "D", dollars) + entry("bad", "E", "") + "</resultList>")
    countries = spark.createDataFrame([("BELGIUM", "BEL")], "name string, code string")
    good, skipped = register.entries(register.read_register(spark, str(tmp_path / "r.xml")), countries)
    got = {r.register_id: r for r in good.collect()}
    assert (got["123456-78"].name, got["123456-78"].declared_cost_eur, got["123456-78"].country_code) == ("A B", 200.0, "BEL")
    assert got["223456-78"].declared_cost_eur is None and got["323456-78"].declared_cost_eur is None and got["323456-78"].declared_cost_raw == "exact=5 currency=$"
    assert [r.register_id for r in skipped.collect()] == ["bad"]
    assert register.to_actors(good).where("register_id = '123456-78'").first().aliases == ["A B"]
    with pytest.raises(Exception, match="no entry"):
        register.check_entries(good.limit(0)).collect()
    text = spark.createDataFrame([("a&#x1;b&#11;c&#x41;&#10;",)], "t string").select(register.legal_xml(F.col("t")).alias("r")).first().r
    assert text == "a b c&#x41;&#10;"


def test_feedback(spark):
    raw = [{"id": 1, "userType": "EU_CITIZEN", "trNumber": "123456-78", "organization": "Me", "dateFeedback": "2021/07/01 12:30:00", "feedback": "t", "attachments": [{"id": 1, "documentId": "D1"}, {"id": 2}]}, {"id": 2, "userType": "NGO", "trNumber": "123456-78 or 223456-78", "organization": "Org", "dateFeedback": "x"}]
    frame = spark.createDataFrame([(json.dumps(r),) for r in raw], "v string").select(F.from_json("v", feedback.FEEDBACK).alias("r")).select("r.*")
    rows = feedback.submissions(frame)
    got = {r.feedback_id: r for r in rows.collect()}
    assert got[1].organisation is None and got[1].register_id is None and str(got[1].submitted_at) == "2021-07-01 10:30:00" and len(got[1].attachments) == 1
    assert got[2].organisation == "Org" and got[2].register_id is None and got[2].submitted_at is None and got[2].text == ""
    assert sorted(r.document_id for r in feedback.feedback_documents(rows).collect()) == ["doc:hys_attachment:D1", "doc:hys_feedback:1", "doc:hys_feedback:2"]
    pages = spark.createDataFrame([(0, 0, 5, "AI", [("COM(2021)206",)]), (1, 0, 5, "late", []), (1, 1, None, "x", [])], "page int, place int, initiative_id long, title string, publications array<struct<reference:string>>")
    entries, failures = feedback.index_entries(pages)
    assert [(r.title, r.com_references) for r in entries.collect()] == [("AI", ["COM(2021)206"])] and failures.count() == 1
    assert feedback.initiatives(entries, "COM(2021)206", "ai law").first().found_by == "reference"
    assert feedback.find_by_title(entries, "AI law", "COM(2021)206").count() == 1 and feedback.find_by_title(entries, "AI law", "COM(2021)1").count() == 0


PROPOSAL = """<body><p>Explanatory Article 9</p><p>Whereas:</p><p>(1) First recital</p><p>more of it</p><p>(2) Second</p><p>HAVE ADOPTED THIS</p>
<p>Article 1</p><p class='Titrearticle'>Subject</p><p>1. One</p><p>(a)</p><p>point</p><p>2. Two</p><p>5. list item</p><p>Article 1</p><p>quoted</p><p>Article 2</p><p>Only text</p><p>Done at Brussels</p><p>Article 3</p></body>"""


def test_acts(spark):
    frame = spark.createDataFrame([("52021PC0206", PROPOSAL), ("x", "<div id='rct_1'><p>(1) R</p></div><div id='art_5'><p class='oj-ti-art'>Article 5</p><p>1. A</p><p>2. B</p></div><p class='oj-hd-date'>12.7.2024</p>"), ("empty", "")], "celex string, html string")
    got = {r.article_id: (r.kind, r.provision, r.text) for r in acts.split_act(frame, "celex", "html").collect()}
    assert got["art:52021PC0206:recital-1"] == ("recital", "Recital 1", "First recital\nmore of it")
    assert got["art:52021PC0206:article-1-1"] == ("paragraph", "Article 1(1)", "One\n(a) point")
    assert got["art:52021PC0206:article-1-2"] == ("paragraph", "Article 1(2)", "Two\n5. list item\nArticle 1\nquoted")
    assert got["art:52021PC0206:article-2"] == ("article", "Article 2", "Only text") and not any("article-3" in k or "article-9" in k for k in got)
    assert got["art:x:recital-1"][2] == "R" and got["art:x:article-5-2"] == ("paragraph", "Article 5(2)", "B")
    blocks = acts.blocks(frame, "celex", "html")
    assert [str(r.published_on) for r in acts.published_on(blocks, "celex").collect()] == ["2024-07-12"]
    annexes = acts.annex_sections(acts.blocks(spark.createDataFrame([("p", "<p>ANNEXES</p><p>ANNEX I</p><p>one</p><p>ANNEX</p><p>two</p>")], "k string, h string"), "k", "h"), "k")
    assert [(r.provision, r.text) for r in acts.provisions(annexes, "k").orderBy("article_id").collect()] == [("Annex", "ANNEX\ntwo"), ("Annex I", "ANNEX I\none")]


def test_stage_store(spark, tmp_path):
    s = store.StageStore(spark, str(tmp_path))
    key = s.key("in", "put")
    assert key != s.key("inp", "ut") and s.load("collect", key) is None
    df = spark.createDataFrame([(1, "a"), (2, "b c")], "n int, t string")
    s.save("collect", key, {"rows": df})
    assert sorted(map(tuple, s.load("collect", key)["rows"].collect())) == [(1, "a"), (2, "b c")]
    s.publish("run-1", [("collect", key)])
    assert s.runs().first().run == "run-1"
    spark.createDataFrame([(9, "z")], "n int, t string").write.mode("overwrite").parquet(s.path("collect", key, "rows"))
    assert s.load("collect", key) is None
    with pytest.raises(ValueError):
        s.publish("run-2", [("collect", key)])
    s.save("bad", key, {"rows": df}, errors=["lost"])
    assert s.load("bad", key) is None
    store.export(df, str(tmp_path / "out"), ["n"])
    assert store.read_json_lines(spark, str(tmp_path / "out/jsonl"), "n int, t string").count() == 2
    store.write_view({"a": df, "b": df.limit(0)}, str(tmp_path / "view"))
    assert json.loads(spark.read.text(str(tmp_path / "view")).first().value)["b"] == []


def test_streamed_origins(spark, tmp_path):
    said = "one two three four five six seven eight nine"
    phrases = spark.createDataFrame([("p1", said)], "phrase_id string, text string")
    common = spark.createDataFrame([("one",)], "word string")
    for i, text in enumerate([f"x {said} y", "nothing of it"]):
        spark.createDataFrame([(f"d{i}", text)], "document_id string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = streaming.read_documents(spark, f"{tmp_path}/in", files=1)
        streaming.write_origins(stream, phrases, common, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.document_id, r.phrase_id, r.first, r.words) for r in rows] == [("d0", "p1", 1, 9)]


def test_bad_lines_are_numbered_within_files(spark, tmp_path):
    """Also where a file is read in many blocks."""
    lines = [f'{{"a": {k}, "b": "x"}}' if k % 50 else ("no json" if k % 100 else '{"a": 1}') for k in range(3000)]
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.jsonl").write_text('{"a": 1, "b": "y"}\n\n[1]\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
    try:
        got = store.bad_lines(spark, str(tmp_path), "a int, b string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.line for r in got if r.file.endswith("one.jsonl")) == list(range(1, 3001, 50))
    assert [(r.line, r.value) for r in got if r.file.endswith("two.jsonl")] == [(3, "[1]")]
