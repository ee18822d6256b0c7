from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts or (id, text, source) rows, with extra columns whose names the operators use too."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1) if isinstance(r, tuple) else (i, r, "en", "s", 1) for i, r in enumerate(rows)]
        frame = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:
            from pyspark.sql import functions as F

            frame = frame.withColumns({c: F.lit("x") for c in ("score", "ids", "hash", "fp", "row", "kept", "base", "host", "label", "tokens", "n_lines", "line", "leaf", "masked", "root")})
        return frame

    return make
