"""Reports against their DuckDB oracles on sf0.001 (the driver's gate runs sf0.01)."""

import pytest

from compare import compare

from marketlens.plans.registry import all_reports

ORACLE_KEYS = sorted(k for k, r in all_reports().items() if r.oracle)


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__ as E

    return E


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_report_matches_oracle(spark, duck, entry, key):
    info = compare(spark, duck, key, entry.queries()[key], entry.oracle_sql()[key], "/root/testdata/sf0.001")
    assert info["status"] == "OK", info


def test_every_query_has_oracle_or_note(entry):
    reps = all_reports()
    missing = [k for k, r in reps.items() if r.oracle is None and not r.note]
    assert not missing
    assert set(reps) <= set(entry.queries())


def test_entry_smoke(spark, entry):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "year_month" in df.columns
