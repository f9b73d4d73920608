import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from verbena.contracts import ContractError
from verbena.operators import contributions as K
from verbena.operators import hypotheses as H
from verbena.sources import mondo, receipts

NOW = datetime(2025, 1, 2)
KINDS = ", ".join(f"{c} {'double' if c == 'confidence' else 'timestamp' if c in H.TIMES else 'string'}" for c in H.COLUMNS)


def row(**changed):
    base = {c: "x" for c in H.COLUMNS} | dict.fromkeys((*H.OPTIONAL, "reviewed_at")) | {"proposal_type": "candidate", "proposer_type": "model", "judgment": "supports", "review_status": "proposed", "confidence": 0.5, "inheritance_id": "i", "recorded_at": NOW}
    return tuple((base | changed)[c] for c in H.COLUMNS)


@pytest.fixture
def fields(spark):
    return spark.createDataFrame([("p", "r", "s", "s#1", "/a/0", "aaa bé cc"), ("p", "r", "s", "s#2", "/b", "other")], ", ".join(f"{c} string" for c in H.FIELD_COLUMNS))


def test_links_quote_their_field_once(spark, fields):
    link = H.hypothesis_source("x", fields, "rel", "/a/0", "bé", "PMID:1")
    assert link.first()[:] == ("x", "p", "r", "s", "rel", "s#1", "/a/0", 4, 6, "bé", "PMID:1", "support")
    assert H.hypothesis_source("x", fields, "rel", "/b", None, "c").first()["end_offset"] == 5
    for text in ("aa", "zz", ""):
        with pytest.raises(ContractError, match="exactly once"):
            H.hypothesis_source("x", fields, "rel", "/a/0", text, "c")
    with pytest.raises(ContractError, match="exactly one"):
        H.hypothesis_source("x", fields, "rel", "/none", None, "c")
    with pytest.raises(ContractError, match="evidence_role"):
        H.hypothesis_source("x", fields, "rel", "/b", None, "c", evidence_role="other")
    for given in ({"citation": None}, {"citation": ""}, {"source_relation": ""}, {"hypothesis_id": None}):
        with pytest.raises(ContractError, match="non-empty text"):
            H.hypothesis_source(**({"hypothesis_id": "x", "source_fields": fields, "source_relation": "rel", "field_path": "/b", "citation": "c"} | given))
    blank = fields.withColumn("provider_id", F.lit(" "))
    with pytest.raises(ContractError, match="blank"):
        H.hypothesis_source("x", blank, "rel", "/b", None, "c")


def test_rows_are_accepted_whole_or_refused(spark, fields):
    made = lambda *rows: spark.createDataFrame(list(rows), KINDS)
    link = H.hypothesis_source("x", fields, "rel", "/a/0", "bé", "PMID:1")
    rows, links = H.hypotheses(made(row()), link, fields)
    assert rows.columns == list(H.COLUMNS) and links.count() == 1
    changes = [
        ({"run_id": " "}, "run_id needs text"), ({"judgment": "maybe"}, "judgment has a value"), ({"review_note": ""}, "review_note must be null"), ({"judgment": "abstain"}, "abstain together"),
        ({"judgment": "abstain", "review_status": "abstained"}, "abstaining hypotheses have no confidence"), ({"judgment": "abstain", "review_status": "abstained", "confidence": None}, "abstaining hypotheses have no source"),
        ({"confidence": 1.5}, "must lie in"), ({"confidence": float("nan")}, "must lie in"), ({"confidence": None}, "must lie in"), ({"inheritance_id": None}, "mechanism_text is needed"),
        ({"judgment": "insufficient_evidence"}, "missing_evidence"), ({"judgment": "contradicts"}, "contradiction named"), ({"judgment": "contradicts", "contradiction": "c"}, "evidence roles"),
        ({"review_status": "accepted"}, "both reviewer_id"), ({"reviewer_id": "me"}, "belong to reviews"), ({"supersedes_id": "y"}, "belongs to revisions"), ({"recorded_at": None}, "recorded_at"),
        ({"review_status": "revised", "reviewer_id": "me", "reviewed_at": NOW, "supersedes_id": "x"}, "another hypothesis"), ({"hypothesis_id": "y"}, "no given hypothesis_id"),
    ]
    for changed, message in changes:
        with pytest.raises(ContractError, match=message):
            H.hypotheses(made(row(**changed)), link, fields)
    with pytest.raises(ContractError, match="source span is needed"):
        H.hypotheses(made(row()), link.where("false"), fields)
    with pytest.raises(ContractError, match="unique"):
        H.hypotheses(made(row(), row()), link, fields)
    for column, value, message in (("source_span", "be", "exactly match"), ("source_field", "/c", "resolve"), ("evidence_role", "other", "evidence roles"), ("end_offset", 60, "exceeds"), ("end_offset", 4, "half-open"), ("citation", None, "citation needs text")):
        with pytest.raises(ContractError, match=message):
            H.hypotheses(made(row()), link.withColumn(column, F.lit(value).cast(link.schema[column].dataType)), fields)
    done = made(row(review_status="accepted", reviewer_id="me", reviewed_at=NOW), row(hypothesis_id="y"))
    assert [r["hypothesis_id"] for r in H.contribution_gate(done, link).collect()] == ["x"]


OBO = """format-version: 1.2

[Term]
id: MONDO:1
name: one
synonym: "first" EXACT []
xref: OMIM:1 {source="a"}
property_value: skos:exactMatch OMIM:1
property_value: skos:exactMatchOther OMIM:2
is_a: MONDO:2 ! two

[Term]
id: MONDO:2
name: two
is_obsolete: true
replaced_by: MONDO:1

[Term]
id: HP:1
name: other
"""


def test_ontology_release(spark, tmp_path):
    path = tmp_path / "m.obo"
    path.write_text(OBO)
    digest = hashlib.sha256(OBO.encode()).hexdigest()
    release = spark.createDataFrame([("mondo", "2025", NOW, "rc", "m", "uri", digest)], "provider_id string, release_id string, available_at timestamp, receipt_id string, source_id string, source_uri string, sha256 string")
    got = mondo.mondo_import(str(path), release)
    ids = lambda name, *c: sorted(tuple(r[x] for x in c) for r in got[name].collect())
    assert ids("terms", "node_id", "is_obsolete", "sha256") == [("MONDO:1", False, digest), ("MONDO:2", True, digest)]
    assert ids("mappings", "tag", "source_row_id") == [("property_value", "m#MONDO:1:5"), ("xref", "m#MONDO:1:4")]
    assert ids("obsolescence", "tag") == [("is_obsolete",), ("replaced_by",)]
    assert ids("edges", "from_id", "to_id", "release_id") == [("MONDO:1", "MONDO:2", "2025")]
    assert ids("synonyms", "alias") == [("first",), ("one",), ("two",)] and got["artifact"].count() == 1
    with pytest.raises(ContractError, match="receipt"):
        mondo.mondo_import(str(path), release, sha256="0" * 64)
    with pytest.raises(ContractError, match="one row"):
        mondo.mondo_import(str(path), release.union(release))
    twice = OBO + "\n[Term]\nid: MONDO:1\nname: again\n"
    path.write_text(twice)
    with pytest.raises(ContractError, match="unique"):
        mondo.mondo_import(str(path), release, sha256=hashlib.sha256(twice.encode()).hexdigest())


def test_constructor(spark):
    base = {c: "x" for c in H.COLUMNS if c not in (*H.OPTIONAL, "reviewed_at", "confidence")} | {"proposal_type": "candidate", "proposer_type": "model", "judgment": "supports", "review_status": "proposed", "recorded_at": NOW, "mechanism_text": "m", "confidence": 0.5}
    assert H.hypothesis(spark, **base).columns == list(H.COLUMNS)
    assert H.hypothesis(spark, **(base | {"hypothesis_id": ["a", "b"], "confidence": [0.1, 1.0]})).count() == 2
    for bad, message in (({"confidence": 2.0}, "must lie in"), ({"hypothesis_id": ["a", "a"]}, "unique"), ({"hypothesis_id": ["a", "b"], "run_id": ["a"]}, "one length"), ({"other": 1}, "has no other")):
        with pytest.raises(ContractError, match=message):
            H.hypothesis(spark, **(base | bad))
    with pytest.raises(ContractError, match="missing run_id"):
        H.hypothesis(spark, **{k: v for k, v in base.items() if k != "run_id"})


def test_contributions(spark, fields):
    link = H.hypothesis_source("x", fields, "rel", "/a/0", "bé", "PMID:1")
    done = spark.createDataFrame([row(review_status="accepted", reviewer_id="me", reviewed_at=NOW)], KINDS)
    term = {"contribution_type": "new_term", "Label": "l", "description": "as PMID:1 says", "parent": "MONDO:1"}
    made = lambda **v: spark.createDataFrame([("x", *(term | v).values())], "hypothesis_id string, " + ", ".join(f"{k} string" for k in (term | v)))
    got = K.contribution(done, link, fields, made(), "mondo")
    assert got["hypothesis"].count() == got["sources"].count() == got["payload"].count() == 1 and got["schema"].count() == 2
    for bad, message in (({"Label": " "}, "needs Label"), ({"parent": "HP:1"}, "MONDO"), ({"description": "none"}, "citation"), ({"orcid": "1"}, "ORCID"), ({"term": "MONDO:2"}, "has no term"), ({"more": "1"}, "unexpected"), ({"contribution_type": "x"}, "outside")):
        with pytest.raises(ContractError, match=message):
            K.contribution(done, link, fields, made(**bad), "mondo")
    with pytest.raises(ContractError, match="neither accepted"):
        K.contribution(spark.createDataFrame([row()], KINDS), link, fields, made(), "mondo")
    with pytest.raises(ContractError, match="no given"):
        K.contribution(done, link, fields, made().withColumn("hypothesis_id", F.lit("z")), "mondo")
    entry = "named_struct('name', 'n', 'biological_scale', 'TISSUE', 'description', 'd', 'evidence', array(named_struct('reference', 'PMID:1', 'supports', 'SUPPORT', 'evidence_source', 'OTHER', 'quote_role', 'BACKGROUND', 'snippet', 'bé', 'explanation', 'e')))"
    record = f"select 'x' hypothesis_id, 'n' name, named_struct('id', 'MONDO:1', 'label', 'l') disease_term, array({entry}) pathophysiology"
    assert K.contribution(done, link, fields, spark.sql(record), "dismech")["payload"].count() == 1
    for old, new, message in (("'bé'", "'be'", "one cited support"), ("TISSUE", "X", "biological_scale"), ("'SUPPORT'", "'NO'", "SUPPORT"), ("'explanation', 'e'", "'explanation', ''", "explanation"), (f"array({entry})", f"slice(array({entry}), 1, 0)", "not be empty"), ("MONDO:1'", "D:1'", "MONDO"), ("BACKGROUND", "B", "quote_role")):
        with pytest.raises(ContractError, match=message):
            K.contribution(done, link, fields, spark.sql(record.replace(old, new)), "dismech")
    edge = "select 'x' hypothesis_id, 'G:1' subject, 'biolink:causes' predicate, 'D:1' object, 'infores:a' primary_knowledge_source, 'prediction' knowledge_level, 'manual_agent' agent_type, array('PMID:1', 'PMID:2') publications, array('ECO:1') has_evidence"
    assert K.contribution(done, link, fields, spark.sql(edge), "monarch")["payload"].count() == 1
    for old, new, message in (("G:1", "G 1", "CURIE"), ("'PMID:1', ", "", "citation"), ("'ECO:1'", "'ECO'", "has_evidence"), ("infores:", "", "infores"), ("manual_agent", "", "agent_type")):
        with pytest.raises(ContractError, match=message):
            K.contribution(done, link, fields, spark.sql(edge.replace(old, new)), "monarch")
    with pytest.raises(ContractError, match="target"):
        K.contribution(done, link, fields, made(), "other")


def test_disease_record(spark, tmp_path):
    text = "name: Marfan\nparts:\n  - {a/b: 1, c: [true, null]}\nempty: []\n"
    (tmp_path / "r.yaml").write_text(text)
    release = spark.createDataFrame([("d", "1", NOW, "rc", "s", "uri", hashlib.sha256(text.encode()).hexdigest())], "provider_id string, release_id string, available_at timestamp, receipt_id string, source_id string, source_uri string, sha256 string")
    got = receipts.dismech_import(str(tmp_path / "r.yaml"), release)
    assert [r["yaml_text"] for r in got["records"].collect()] == [text] and got["artifact"].count() == 1
    assert {(r["field_path"], r["value_type"], r["value"]) for r in got["fields"].collect()} == {("/name", "character", "Marfan"), ("/parts/0/a~1b", "integer", "1"), ("/parts/0/c/0", "logical", "TRUE"), ("/parts/0/c/1", "null", None)}
    (tmp_path / "r.yaml").write_text("other: 1\n")
    with pytest.raises(ContractError, match="name"):
        receipts.dismech_import(str(tmp_path / "r.yaml"), release, sha256=hashlib.sha256(b"other: 1\n").hexdigest())
