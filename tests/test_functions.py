from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arborlake.functions import extract, normalize, temporal, vectors
from arborlake.operators import find, fulltext, ontology, search
from arborlake.sources import text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "said, expected",
    [
        ("Revenue grew to $2.3 billion in Q4, up from $1.8B last year", [2300000000, 1800000000]),
        ("European sales reached €1.5M, exceeding our €1.2 million target", [1500000, 1200000]),
        ("International revenue: USD 5.2 million, EUR 4.1 million, GBP 3.3 million", [5200000, 4100000, 3300000]),
        ("Total assets: $1,234,567.89 million", [1234567890000]),
        ("It moved from $5 to $6", [5, 6]),
        ("Price is $ (no number)", []),
        ("", []),
    ],
)
def test_currency(spark, said, expected):
    rows = spark.createDataFrame([(1, said)], "element_pk int, text string")
    found = [r["value"] for r in extract.values(rows).where("value_type = 'currency'").collect()]
    assert found == pytest.approx(expected)


@pytest.mark.parametrize(
    "said, kind, expected",
    [
        ("Profit margin improved to 25.5%, up from 18% last quarter. Growth rate: +12.3%", "percentage", [25.5, 18, 12.3]),
        ("Loss this quarter, down -15% year-over-year", "percentage", [-15]),
        ("between 10-15% of sales", "percentage", [15]),
        ("Revenue grew 3.5x compared to last year. We achieved a 10x return", "multiplier", [3.5, 10]),
        ("Growth of % year-over-year", "percentage", []),
    ],
)
def test_other_values(spark, said, kind, expected):
    rows = spark.createDataFrame([(1, said)], "element_pk int, text string")
    found = [r["value"] for r in extract.values(rows).where(F.col("value_type") == kind).collect()]
    assert found == pytest.approx(expected)


def test_currency_codes(spark):
    rows = spark.createDataFrame([(1, "USD 5.2 million and €3 and £4.5k")], "element_pk int, text string")
    assert [r["unit"] for r in extract.values(rows).collect()] == ["USD", "EUR", "GBP"]


@pytest.mark.parametrize(
    "kind, said, expected",
    [
        ("financial_quarter", "Q4 2024", "2024-q4"),
        ("financial_quarter", "fourth quarter 2024", "2024-q4"),
        ("financial_quarter", "4Q24", "2024-q4"),
        ("financial_quarter", "FY24", "2024"),
        ("statute", "18 U.S.C. § 1001", "18 USC § 1001"),
        ("case_citation", "410 U.S. 113", "410 U.S. 113"),
        ("case_citation", "[2019] UKSC 41", "[2019] UKSC 41"),
        ("regulation", "Rule 10b-5", "RULE_10B-5"),
        ("company_name", "Acme Holdings Inc.", "acme"),
        ("dosage", "10mg", "10mg"),
        ("vital_sign", "BP 120/80 mmHg", "bp 120/80 mmhg"),
        ("medical_code", "E11.9", "E11.9"),
        ("lab_value", "Glucose: 110 mg/dL", "glucose: 110 mg/dl"),
        ("contract_clause", "Schedule C", "SCHEDULE_C"),
        ("date", "March 5, 2024", "2024-03-05"),
        ("date", "03/05/2024", "2024-03-05"),
        ("date", "05.03.2024", "2024-03-05"),
        ("date", "5 March 2024", "2024-03-05"),
        ("relative_date", "3 weeks ago", "3 weeks ago"),
        ("fiscal_period", "fiscal year 2024", "2024"),
    ],
)
def test_entities(spark, kind, said, expected):
    rows = spark.createDataFrame([(1, said)], "element_pk int, text string")
    assert expected in [r["normalized"] for r in extract.entities(rows, [kind]).collect()]


def test_custom_extractors(spark):
    spec = {"custom_extractors": [{"name": "po", "entity_type": "order_number", "patterns": [{"regex": r"PO-\d+", "word_boundaries": True}], "confidence": 0.7}]}
    (po,) = extract.from_config(spec)
    rows = spark.createDataFrame([(1, "see PO-123 and xPO-9")], "element_pk int, text string")
    assert [(r["raw"], r["confidence"]) for r in extract.extracted(rows, [po]).collect()] == [("PO-123", 0.7)]


def test_fiscal_and_academic(spark):
    ts = F.to_timestamp("d")
    assert one(spark, temporal.fiscal_year(ts), d="2024-10-01") == 2025
    assert one(spark, temporal.fiscal_quarter(ts), d="2024-10-01") == 1
    assert one(spark, temporal.fiscal_year(ts), d="2024-09-30") == 2024
    assert one(spark, temporal.fiscal_quarter(ts), d="2024-09-30") == 4
    assert one(spark, temporal.academic_semester(ts), d="2024-08-01") == "fall"
    assert one(spark, temporal.academic_year(ts), d="2024-08-01") == "2024-2025"
    assert one(spark, temporal.academic_semester(ts), d="2024-07-31") == "summer"
    assert one(spark, temporal.academic_year(ts), d="2024-07-31") == "2023-2024"


@pytest.mark.parametrize(
    "said, kind",
    [("2024-03-05", "DATE"), ("10:30 am", "TIME"), ("2024-03-05 10:30", "DATETIME"), ("9:00-17:00", "TIME_RANGE"), ("hello", "NONE"), ("", "NONE"), (None, "NONE")],
)
def test_temporal_type(spark, said, kind):
    row = spark.createDataFrame([(said,)], "t string").select(temporal.temporal_type(F.col("t")).alias("k"))
    assert row.first()["k"] == kind


def test_search_bounds():
    assert find.date_bounds("fiscal_year", year=2024) == (datetime(2023, 7, 1), datetime(2024, 6, 30, 23, 59, 59))
    assert find.date_bounds("quarter", year=2024, quarter=4)[1] == datetime(2024, 12, 31, 23, 59, 59)
    with pytest.raises(ValueError):
        find.date_bounds("within", start=datetime(2024, 1, 1))


def test_normal_forms(spark):
    assert one(spark, normalize.slug(F.col("x")), x="Jane O'Neil - CFO") == "jane_oneil_cfo"
    assert one(spark, normalize.levenshtein_ratio(F.col("x"), F.col("y")), x="kitten", y="sitting") == pytest.approx(4 / 7)
    assert one(spark, normalize.levenshtein_ratio(F.col("x"), F.col("y")), x="", y="") == 1
    assert one(spark, normalize.levenshtein_ratio(F.col("x"), F.col("y")), x="", y="a") == 0
    assert one(spark, normalize.address(F.col("x")), x="12 N. Main St.") == "12 north main street"
    assert one(spark, normalize.phone(F.col("x")), x="+1 (555) 123-4567") == "5551234567"
    assert one(spark, normalize.monetary(F.col("x")), x="$2.5M") == 2.5e6
    assert one(spark, normalize.date(F.col("x")), x="25/12/2024") == "2024-12-25"
    assert one(spark, normalize.date(F.col("x")), x="3/4/2024") == "2024-03-04"
    assert one(spark, normalize.fuzzy_match(F.col("x"), F.col("y")), x="Café  Noir", y="cafe noir")


def test_vectors(spark):
    v = vectors.literal
    assert one(spark, vectors.cosine(v([0, 0]), v([1, 0]))) == 0
    assert one(spark, vectors.cosine(v([1, 0, 5]), v([1, 0]))) == 1
    assert one(spark, vectors.euclidean(v([0, 0]), v([3, 4]))) == pytest.approx(1 / 6)
    assert one(spark, vectors.token_estimate(F.col("x")), x="one two three four") == 5


def scores(spark, rows):
    return spark.createDataFrame(rows, "element_pk long, score_type string, score double")


@pytest.mark.parametrize("fusion, expected", [("weighted_avg", 0.923077), ("add", 1.2), ("multiply", 0.27), ("max", 0.9)])
def test_fusion(spark, fusion, expected):
    rows = scores(spark, [(1, "text_similarity", 0.9), (1, "date_relevance", 1.0)])
    assert search.fuse(rows, fusion).first()["final_score"] == pytest.approx(expected, abs=1e-6)


def test_scores_of_a_type_are_averaged(spark):
    rows = scores(spark, [(1, "text_similarity", 0.8), (1, "text_similarity", 0.6)])
    assert search.fuse(rows).first()["final_score"] == pytest.approx(0.7)


def test_query_round_trip():
    query = (
        search.Builder()
        .text("profit", threshold=0.5)
        .begin("OR")
        .topics("a%", minimum=0.6)
        .in_quarter(2024, 3)
        .end()
        .options(limit=3, fusion="max")
        .build()
    )
    assert search.from_json(search.to_json(query)) == query
    with pytest.raises(ValueError):
        search.Builder().build()
    with pytest.raises(ValueError):
        search.Query(query.root, fusion="none")


def test_unsupported_criteria(spark):
    store = search.Store(spark.createDataFrame([(1,)], "element_pk long"))
    with pytest.raises(ValueError, match="embedding"):
        store.check(search.Query(search.Group((search.Embedding((1.0,)),))))


@pytest.mark.parametrize(
    "content, kind",
    [
        ('{"a": 1}', "json"),
        ("<?xml version='1.0'?><a/>", "xml"),
        ("<!DOCTYPE html><html></html>", "html"),
        ("a,b,c\n1,2,3\n4,5,6", "csv"),
        ("# Title\n\n- item\n", "markdown"),
        ("just words", "text"),
        ("", "text"),
        (None, "text"),
    ],
)
def test_content_type(spark, content, kind):
    row = spark.createDataFrame([(content,)], "t string").select(text.content_type(F.col("t")).alias("k"))
    assert row.first()["k"] == kind


def test_paragraph_split(spark):
    docs = spark.createDataFrame([(1, "one  two\n\nthree\r\n\r\n\n"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in text.paragraphs(docs).orderBy("index").collect()] == ["one two", "three"]
    assert text.paragraphs(docs, compat=True).count() == 1


def test_highlight(spark):
    assert one(spark, fulltext.highlight(F.col("x"), ["cat"]), x="Cat concatenates a cat") == "<b>Cat</b> concatenates a <b>cat</b>"


def test_ontology():
    a = ontology.from_dict({"name": "a", "terms": [{"id": "x", "label": "X"}], "element_mappings": [{"term_id": "x", "rules": [{"type": "keywords", "keywords": ["x"]}]}]})
    b = ontology.Ontology("b", {"y": "Y"})
    assert set(ontology.merge("c", a, b).terms) == {"x", "y"}
    with pytest.raises(ValueError):
        ontology.Ontology("d", {}, {"z": ()})


def found_entities(spark, kind, text):
    rows = spark.createDataFrame([(1, text)], "element_pk long, text string")
    return sorted((r["pattern"], r["raw"], r["normalized"]) for r in extract.entities(rows, [kind]).collect())


def test_details_of_entities(spark):
    assert found_entities(spark, "ticker_symbol", "(THE) (CEO) (AAPL), NYSE: IBM and NASDAQ: IPO") == [("bracketed", "(AAPL)", "AAPL"), ("exchange", "NYSE: IBM", "IBM")]
    assert found_entities(spark, "percentage", "5 % or thirty-five percent, one hundred percent, Twenty percent") == [
        ("sign", "5 %", "0.0500"), ("spelled", "Twenty percent", "0.2000"), ("spelled", "one hundred percent", "1.0000"), ("spelled", "thirty-five percent", "0.3500"),
    ]
    found = found_entities(spark, "drug_name", "Ambien CR and Toprol XL, OxyContin, the Table, amoxicillin/clavulanate, ab/c")
    assert ("brand", "OxyContin", "oxycontin") in found
    assert ("combination", "amoxicillin/clavulanate", "amoxicillin/clavulanate") in found
    assert not any(raw in ("Table", "ab/c") and pattern == "combination" and len(raw) < 4 for pattern, raw, _ in found)
    assert ("brand", "Table", "table") not in found
    assert [p for p, *_ in found_entities(spark, "vital_sign", "Weight: 70.5 kg, height 180 cm")] == ["height", "weight"]


def test_entities_of_all_types_read_the_texts_once(spark, tmp_path):
    spark.createDataFrame([(1, "BP 120/80")], "element_pk long, text string").write.parquet(str(tmp_path / "t"))
    plan = extract.entities(spark.read.parquet(str(tmp_path / "t")), list(extract.EXTRACTORS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_marked_matches_are_those_of_a_split(spark):
    from pyspark.sql import functions as F

    from arborlake.functions import extract, temporal

    texts = ["5x a5x 5x5 5 x", "x", "", None, "a\x005x\x01 7x", "é 5x 日本 6 fold", "-5% $1.5 million, +3%4% usd 7 €8", "$5$6 \x015%"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    t = F.col("text")
    for pattern in (extract.CURRENCY, extract.PERCENT, extract.MULTIPLIER, r"\d", "zz"):
        found = {r["k"]: r["f"] for r in rows.select("k", temporal.find_all_at(t, pattern).alias("f")).collect()}
        raws = {r["k"]: r["f"] for r in rows.select("k", temporal.find_all(t, pattern).alias("f")).collect()}
        for k, text in enumerate(texts):
            if text is None:
                assert found[k] is None
                continue
            assert [x["raw"] for x in found[k]] == raws[k], (pattern, text)
            assert all(text[x["start"] :].startswith(x["raw"]) for x in found[k])
            assert [x["start"] for x in found[k]] == sorted({x["start"] for x in found[k]})


def test_guarded_patterns_lose_no_match(spark):
    from dataclasses import replace

    from arborlake.functions import extract

    said = """$ 5.2M 1,000 dollars 5 USD 3 Billion 5 Percent Twenty-five percent (ABC) NYSE: XY Acme Corp. Q3 2020 first Quarter of 2020 3q 21 FY22
    2020-01-02 1/2/2020 1.2.2020 March 3, 2020 3 March 2020 Mar. 3 2020 5 Weeks Weekly H1 20 second HALF YTD Today Next Friday this quarter 3 days From Now End of the year
    fiscal year 2020 FQ2 20 2020 Fiscal Year 1 F.2d 3 1 U.S. 3 1 S. Ct. 3 1 F. Supp. 2d 3 1 Cal. App. 2d 3 1 Ohio. 3 [2020] UKSC 3 C-1/20 18 U.S.C. § 5 17 C.F.R. § 2.4
    Section 5 of the Clean Air Act Sec. 4 § 5 Public Law 1-2 H.R. 5 S. 6 Chapter 5 of Title 3 Supreme Court of Ohio SUPREME  COURT tax court Habeas Corpus DE FACTO Rule 10b-5 Reg. 5
    Form 10-K Art. IV Article 5.1 Title IX GDPR Clause 5 Cl. 5.1 Para. 4(a) Paragraph 3 Ex. B Exhibit A-1 Sch. 4 Schedule B Appendix A App. 2 Aspirin 5 mg ATORVASTATIN Lipitor XR OxyContin abc/def
    5 Tablets 5mg/ml 5% cream Twice a day q8H BID E11.9 12345-6 1234-567-89 CPT 12345 DRG 123 Hearts ANKLE Arthritis fibrosis Anemia Melanoma Neuropathy Down Syndrome Crohn Disease
    Panic disorder BP 120/80 blood pressure: 120/80 HR 60 Pulse: 60 Temp 98.6 RR 12 respiratory rate 12 SpO2 98% O2 sat 98 BMI 22.5 Wt 70 kg weight: 70kg Ht 180 cm height 6 ft Glucose 90 WBC 5"""
    texts = [said, said.upper(), said.lower(), "", *said.split("\n"), *said.split()]
    rows = spark.createDataFrame(list(enumerate(texts)), "element_pk int, text string").repartition(4)
    plain = [replace(x, cues={}, leads={}, gate=None) for x in extract.EXTRACTORS.values()]

    def hits(chosen):
        found = extract.extracted(rows, chosen).select("element_pk", "entity_type", "pattern", "raw")
        return sorted(map(tuple, found.collect()))

    with_guards, without = hits(list(extract.EXTRACTORS.values())), hits(plain)
    assert with_guards == without
    guarded = {(t, p) for t, x in extract.EXTRACTORS.items() for p in x.patterns if p in x.cues or p in x.leads}
    missed = {g for g in guarded if g[0] not in ("legal_term", "court_name", "anatomy")} - {(t, p) for _, t, p, _ in without}
    assert len(guarded) > 120 and not missed, missed


def test_counted_matches_are_those_of_extracted(spark):
    from pyspark.sql import functions as F

    from arborlake.functions import extract

    own = [
        extract.Extractor("own", {"start": r"\bab", "behind": r"(?<=#)\d+", "marks": "[\x01\x02]+"}),
        extract.Extractor("kept", {"number": r"\d+", "ahead": r"\d+(?=;)"}, valid=lambda _, raw: raw != "7"),
    ]
    said = ["abab ab \x01\x02 #12; 7 7; 88", "Lipitor and Table in NYSE: XY, NYSE: CEO (ETF) (ABCD)", "BP 120/80 BP 130/85 5% 6% Hearts", "", None, "\x02", "plain words"]
    texts = said + ["Order 5 of $7.5 million on 2020-01-02 by Acme Corp. for Aspirin 5 mg"] * 2000 + said * 3
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    chosen = [*extract.EXTRACTORS.values(), *own]
    wanted = extract.extracted(rows.withColumn("k", F.lit(1)), chosen, "k").groupBy("entity_type", "pattern").count()
    found = {(r["entity_type"], r["pattern"]): r["n"] for r in extract.counted(rows, chosen).collect()}
    assert found == {(r["entity_type"], r["pattern"]): r["count"] for r in wanted.collect()}
    assert found["own", "start"] == 8 and found["own", "behind"] == 4 and found["kept", "ahead"] == 4 and len(found) > 12


def test_entity_counts_leave_the_texts_to_arrow(spark, sf_dir):
    from arborlake import catalog

    plan = catalog.queries()["entity_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan
