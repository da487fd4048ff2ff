"""The pipeline's stages against their own brute-force readings on a small corpus, and the registered queries."""

import importlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from leadflow.llm import quality

SMALL = "/root/testdata/sf0.001"


def corpus(r):
    words = {"en": "the house friend near old river they went there and was of".split(), "de": "das haus freundes nahe alten fluss sie gingen dorthin und war von".split()}
    rows, families = [], []
    for lang in words:
        # Words of one language are made of its own syllables, so that texts are long, varied and tell the language.
        make = lambda: " ".join(r.choice(words[lang]) + r.choice(words[lang]) for _ in range(r.randrange(60, 120)))  # noqa: B023, E731
        for _ in range(60):
            rows.append((len(rows), make(), lang, r.choice(["a", "b"])))
        for _ in range(8):
            base = make().split()
            start = len(rows)
            for _ in range(4):
                copy = list(base)
                copy[r.randrange(len(copy))] = r.choice(words[lang])
                rows.append((len(rows), " ".join(copy), lang, "a"))
            families.append(range(start, len(rows)))
    clean = len(rows)
    rows += [(clean, "1234 5678 " * 30, "en", "a"), (clean + 1, None, "en", "a"), (clean + 2, "too short", "de", "b"), (clean + 3, " ".join(f"the###{w}&&&" for w in rows[3][1].split()), "en", "a"),
             (clean + 4, "the house " * 50, "en", "b")]
    return rows, families, set(range(clean, clean + 5))


def test_stages_drop_what_they_should_and_keep_the_rest(llm, tmp_path):
    rows, families, junk = corpus(random.Random(1))
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = llm.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(llm, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        now = llm.read.parquet(str(tmp_path / f"stage{k}"))
        ids.append(sorted(r["doc_id"] for r in now.select("doc_id").collect()))
    every = {r[0] for r in rows}
    assert every - set(ids[0]) == {min(junk), min(junk) + 1}
    assert every - set(ids[1]) == junk
    assert set(ids[1]) - set(ids[2]) == {i for family in families for i in family[1:]}
    packed = corpus_pipeline.run(llm, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(ids[2])
    assert all(r["offset"] + r["length"] <= 2048 for r in packed)


def test_empty_documents(llm, tmp_path):
    llm.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(llm, str(tmp_path)).count() == 0


def test_every_operator_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_equals_sql(llm, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    df = entry.queries()[name](llm, SMALL)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == sorted(cursor.fetchall(), key=str)


def test_modules_import_without_a_session():
    for module in ("ann", "bpe", "chat", "language", "licences", "lm", "neardup", "packing", "quality", "warc"):
        importlib.import_module(f"leadflow.llm.{module}")
    assert quality.MIN_WORDS == 10
