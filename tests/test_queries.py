"""Every query of the engine that has SQL agrees with it; the others, each compared by hand in `test_operators.py`, return rows."""

import pytest
from compare import same

from tessera.plans import catalog

D = "/root/testdata/sf0.001"
#: What SQL cannot express: files' bytes, redaction, parsing, Unicode normal forms, feature hashing, and walks over leases.
BY_HAND = set(
    "s1_s4_scan_manifest s2_s3_scan_paths s11_vector_codec p1_p4_classify f1_normalize_unicode f7_redact f9_script_class_exact r1_identifier_tokens_any_script r24_r25_backfill "
    "c1_c6_universal_chunks c7_c8_code_units t7_lease_stream".split()
)


def test_what_has_no_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == BY_HAND


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, D)
    if name in catalog.SQL:
        same(df, catalog.SQL[name], D)
    else:
        assert df.count() > 0
