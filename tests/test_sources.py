import json

import pytest
from pyspark.sql import functions as F

from factloom.sources import articles, files, pages, paged, studies
from raw_files import PAGE, article, write_raw


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    return write_raw(tmp_path_factory.mktemp("raw"))


def test_catalogue(spark, raw, tmp_path):
    good, bad = files.read_catalogue(spark, f"{raw}/seed.csv")
    rows = {r.adc_id: r for r in good.collect()}
    assert len(rows) == 3 and bad.isEmpty() and rows["e1"].dar == 4.0 and rows["e2"].indication is None and rows["e3"].linker_type == "unknown"
    assert sorted(r.alias for r in files.alias_rows(good).filter("entity_id = 'e1'").collect()) == ["AV-101", "Alpha V"]
    (tmp_path / "bad.csv").write_text("adc_id,adc_name,target,dar,linker_type\nx,N,T,-1,cleavable\ny,N,T,21,odd\nz,,T,5,\n", encoding="utf-8")
    good, bad = files.read_catalogue(spark, str(tmp_path / "bad.csv"))
    assert good.isEmpty() and {r.adc_id: list(r.violations) for r in bad.collect()} == {"x": ["dar"], "y": ["linker_type", "dar"], "z": ["adc_name"]}
    (tmp_path / "twice.csv").write_text("adc_id,adc_name\na,1\na,2\n", encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_unique_catalogue(spark, str(tmp_path / "twice.csv"))


def test_json_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question_id": "a", "question": "x"}\n\n{"question_id": "b", "question": "y", "split": "test"}\n', encoding="utf-8")
    assert [(r.question_id, r.split) for r in files.read_questions(spark, str(tmp_path / "q.jsonl")).orderBy("question_id").collect()] == [("a", "dev"), ("b", "test")]
    (tmp_path / "l.jsonl").write_text('{"adc_id": "a", "field": "dar", "url": "http://x", "value": "1"}\n', encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_locators(spark, str(tmp_path / "l.jsonl"))


def test_studies(spark, raw):
    p = studies.read_pages(spark, f"{raw}/trials")
    rows = {r.nct_id: r for r in studies.parse_studies(p).collect()}
    assert set(rows) == {"NCT00000001", "NCT00000002"}
    assert rows["NCT00000002"].brief_title == "Betamab deruxtecan in TROP2 disease" and rows["NCT00000002"].interventions == ["BD-202", "Betamab deruxtecan"]
    assert rows["NCT00000001"].primary_outcomes == ["Objective response rate"] and rows["NCT00000001"].completion_date is None
    state = studies.capture_state(p).first()
    assert state.expected_count == 2 and state.truncated is False
    assert studies.capture_state(p.filter("page = 1")).first().truncated is True


def test_articles(spark, raw, tmp_path):
    rows = {r.source_record_id: r for r in articles.parse_articles(articles.read_articles(spark, f"{raw}/articles")).collect()}
    a, b = rows["101"], rows["102"]
    assert a.title == "Mechanism of Alphamab vedotin & bystander killing" and a.authors == ["Doe J", "The Group"] and a.doi == "10.1/101"
    assert a.abstract == ("BACKGROUND: Alphamab vedotin binds HER2. The payload MMAE is released in cells.\n"
                          "RESULTS: Internalization of the payload was rapid. Bystander killing was seen.")
    assert (a.publication_date, b.publication_date, a.journal) == ("2024-Mar", "2024 Nov-Dec", "J Test")
    names = spark.createDataFrame([("alphamab VEDOTIN",), ("BD-202",), ("Missingmab",)], "name string")
    left = articles.uncovered_names(names, articles.parse_articles(articles.read_articles(spark, f"{raw}/articles")))
    assert [r.name for r in left.collect()] == ["Missingmab"]
    history = '<PubMedPubDate PubStatus="entrez"><Year>2024</Year><Month>3</Month><Day>5</Day></PubMedPubDate>'
    (tmp_path / "h.xml").write_text(article("7", "T", [("", "A")], extra=history), encoding="utf-8")
    h = articles.article_histories(articles.read_articles(spark, str(tmp_path / "h.xml"))).collect()
    assert [(r.source_record_id, r.event, str(r.event_date)) for r in h] == [("7", "entrez", "2024-03-05")]


def test_pages(spark):
    df = spark.createDataFrame([("e1", "u1", PAGE), ("e2", "u2", "<table></table>")], "entity_id string, detail_url string, body string")
    ok, bad = pages.parse_details(df)
    row = ok.first()
    assert (row.adcdb_id, row.adc_name, row.dar, row.drug_status) == ("DRG001", "Alphamab vedotin", 3.5, "Approved (FDA)")
    assert row.synonyms == ["AV-101", "AV101", "Alpha"] and row.antigen_name == "Receptor ERBB2 & more"
    assert [r.entity_id for r in bad.collect()] == ["e2"]
    hit = '<div>ADC ID: DRG{0}</div><span><b>ADC Name: </b>{1}</span><a href="/data/adc/details/DRG{0}">x</a>'
    found = pages.search_results(spark.createDataFrame([("e1", hit.format("001", "Alphamab <i>Vedotin</i>") + hit.format("002", "Other"))], "entity_id string, body string"))
    wanted = spark.createDataFrame([("e1", "alphamab-vedotin"), ("e2", "none")], "entity_id string, name string")
    best, errors = pages.pick_exact(wanted, found)
    assert [(r.entity_id, r.adcdb_id, r.detail_path) for r in best.collect()] == [("e1", "DRG001", "/data/adc/details/DRG001")]
    assert [r.entity_id for r in errors.collect()] == ["e2"]


def test_paged_source(spark):
    import paged_fixture  # noqa: F401  (must be importable in the tasks)

    spark.dataSource.register(paged.PagedSource)
    read = lambda **o: spark.read.format("paged").options(queries=json.dumps(["a", "b"]), fetcher="paged_fixture:fetch", basedelay="0", **o).load()
    rows = sorted((r.query, r.page, r.truncated) for r in read(pagesize="500").collect())
    assert rows == [(q, p, False) for q in "ab" for p in (1, 2, 3)]
    assert {json.loads(r.body)["size"] for r in read(pagesize="500").collect()} == {100}
    assert sorted((r.query, r.page, r.truncated) for r in read(maxpages="2").collect()) == [("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 2, True)]
    waits = []
    with pytest.raises(OSError):
        paged.retry(lambda: paged_fixture.fetch("broken", None, 1), 3, 1.0, waits.append)
    assert waits == [1.0, 2.0] and paged.batches(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]]


def test_file_audits(spark, tmp_path):
    from factloom.operators import audits

    (tmp_path / "a.txt").write_text("fine", encoding="utf-8")
    (tmp_path / "b.txt").write_text("see /home/me/secret", encoding="utf-8")
    found = audits.hygiene_findings(audits.read_texts(spark, str(tmp_path))).collect()
    assert [(r.path.rsplit("/", 1)[1], r.kind) for r in found] == [("b.txt", "local_path")]
    m = audits.artifact_manifest(spark, str(tmp_path))
    assert m.count() == 2
    snaps = m.select(F.col("path").alias("raw_path"), F.col("sha256").alias("content_hash")).limit(1).unionByName(
        m.filter("path LIKE '%b.txt'").select(F.col("path").alias("raw_path"), F.lit("0").alias("content_hash"))).unionByName(
        m.limit(1).select(F.lit("nowhere").alias("raw_path"), F.lit("0").alias("content_hash")))
    assert sorted(r.integrity for r in audits.snapshot_integrity(snaps, m).collect()) == ["hash_mismatch", "missing", "valid"]
    df = spark.createDataFrame([("/home/x/y", "https://a/b", 1), ("C:\\Users\\x", "rel/path", 2)], "p string, q string, n int")
    assert {r.column: r.n for r in audits.absolute_paths(df).collect()} == {"p": 2, "q": 0}
