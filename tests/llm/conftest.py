import pytest

from leadflow.llm.support import prepare

# Columns with names that operators use inside; they must neither clash nor be read.
CLASHING = {"text_buffer": "x", "score": "y", "row_key": "z", "class_id": "c", "label": "l", "place": "p", "g": "g", "piece": "q", "d2": "d", "shard": "s", "digest": "h", "start": "w"}


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture
def documents(llm):
    """Documents with ids from 0, or with given (id, text) pairs, in the columns of the documents table and clashing ones."""
    def make(rows, lang="en", source="s"):
        from pyspark.sql import functions as F

        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        rows = [(r + (lang, source)[len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
        df = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    return make
