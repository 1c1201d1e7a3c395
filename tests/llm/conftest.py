from __future__ import annotations

import pytest

from reelmetrics.llm.shared import importable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    importable(spark)
    return spark


@pytest.fixture
def documents(llm):
    """Documents from (doc_id, text) or (doc_id, text, lang), over a few partitions."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
        df = llm.createDataFrame(full, DOCS).repartition(3)
        return df.selectExpr("*", *filter(None, [extra]))

    return make
