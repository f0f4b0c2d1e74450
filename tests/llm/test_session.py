"""Queries of the library and of this subpackage follow each other in one session."""

from quillgrid import catalog
from quillgrid.llm import catalog as llm

SF = "/root/testdata/sf0.001"


def test_forest_after_full_text_search(spark):
    assert catalog.QUERIES["bm25_topk"](spark, SF).count() > 0
    assert llm.op9_secrets(spark, SF).count() > 0
