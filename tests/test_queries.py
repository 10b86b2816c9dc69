"""Every core query against its SQL; those without SQL must at least run."""

import hashlib

import pytest

from lectern.plans import catalogue
from tests.oracle import same, tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, con, name):
    same(spark, con, SMALL, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.fixture(scope="module")
def templated(spark):
    from lectern.plans import policies

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return {r.doc_id: r.t for r in docs.select("doc_id", policies._templated().alias("t")).collect()}


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n.startswith("policy_")))
def test_policies_by_row(spark, templated, name):
    """Every row against the policy itself, whose edits replay to its text and whose spans lie in it."""
    from lectern.operators.policies import columns

    got = {r.doc_id: r for r in catalogue.QUERIES[name](spark, SMALL).collect()}
    assert set(got) == set(templated)
    for i, text in templated.items():
        want = columns._STAGES[name.removeprefix("policy_")](text)
        assert got[i].text_sha256 == hashlib.sha256(want["text"].encode()).hexdigest()
        assert (got[i].n_edits, got[i].n_warnings, got[i].n_protected) == (len(want["edits"]), len(want["warnings"]), len(want["protected"]))
        assert all(0 <= s["start"] < s["end"] <= len(want["text"]) for s in want["protected"])
        if want["edits"]:
            out, at = [], 0
            for e in want["edits"]:
                assert text[e["start"] : e["end"]] == e["original"]
                out += [text[at : e["start"]], e["replacement"]]
                at = e["end"]
            assert "".join(out) + text[at:] == want["text"]


#: Rows that queries without SQL return over the smallest tables: one a document, or some.
BY_DOCUMENT = {"guarded_merge", "variant_forms"}


@pytest.mark.parametrize("name", sorted(n for n in set(catalogue.QUERIES) - set(catalogue.ORACLES) if not n.startswith("policy_")))
def test_rows_of_queries_without_sql(spark, templated, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns and (len(rows) == len(templated) if name in BY_DOCUMENT else True)
    again = [tuple(r) for r in catalogue.QUERIES[name](spark, SMALL).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
