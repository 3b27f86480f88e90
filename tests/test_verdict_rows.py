import re

from conftest import SF

from wardlume import queries as library


def test_rows_of_documents_and_criteria_are_not_joined_by_both(spark):
    plan = library.QUERIES["conformance_by_document"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join \[doc_id#\d+L?, num#", plan)
