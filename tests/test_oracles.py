"""A cross-section of the registered queries against DuckDB at the smallest
scale; ``python tests/compare.py 0.01`` checks all of them."""

import os

import pytest

from compare import compare, connect
from vigilake.plans import COVERS, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CHOSEN = (
    "parse_event_verbatim", "case_events", "read_smq_outline", "section_16_1_table", "parse_label_date",
    "validate_date_range", "latest_date_records", "version_history", "product_lookup_cascade", "boundary_extract",
    "parse_newsletter_index", "parse_search_results", "label_tables", "tga_changes", "scan_folder",
)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) is None


def test_every_query_says_what_it_covers():
    assert all(COVERS[name] for name in QUERIES)
    assert set(ORACLES) <= set(QUERIES)
