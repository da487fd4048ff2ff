import zlib

import pytest

from leadflow.llm import language

WORDS = {"en": "the house of a friend was near to the old river and they went there", "de": "das haus eines freundes stand nahe an dem alten fluss und sie gingen dorthin",
         "fr": "la maison d'un ami se trouvait près de la vieille rivière et ils y allèrent"}


def sentences(lang, n, seed):
    import random

    r = random.Random(seed)
    return [" ".join(r.choices(WORDS[lang].split(), k=r.randrange(8, 40))) for _ in range(n)]


def labelled():
    rows, i = [], 0
    for lang in WORDS:
        for text in sentences(lang, 120, lang):
            rows.append((i, text, lang, "s"))
            i += 1
    return rows


def test_held_out_texts_are_named(documents):
    rows = labelled()
    out = {r["doc_id"]: r for r in language.identify(documents(rows)).collect()}
    assert len(out) == len(rows)
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert kept and all(out[r[0]]["held_out"] == (r in kept) for r in rows)
    assert sum(out[r[0]]["lang_pred"] == r[2] for r in kept) >= 0.97 * len(kept)
    assert sum(out[r[0]]["accepted"] for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_texts_without_letters_and_nulls(documents):
    rows = labelled() + [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "123 !? \n", None, None), (1003, "the house " * 40_000, "en", "s"), (None, "the river and the house", "en", "s"), (1004, "é", None, "s")]
    rows += [rows[0], rows[0]]
    out = language.identify(documents(rows)).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    for k in (1000, 1001, 1002):
        assert (by_id[k]["lang_pred"], by_id[k]["score"], by_id[k]["accepted"]) == ("und", 0.0, False)
    assert by_id[1003]["lang_pred"] == "en" and not by_id[None]["held_out"]
    assert by_id[1004]["lang_pred"] in WORDS
    assert sum(r["doc_id"] == 0 for r in out) == 3


def test_label_and_source_are_no_inputs(documents):
    rows = labelled()
    model = language.fit(documents(rows))
    from pyspark.sql import functions as F

    def named(df):
        return [tuple(r) for r in df.select("doc_id", language.predict(model, F.col("text")).alias("p")).select("doc_id", "p.*").orderBy("doc_id").collect()]

    assert named(documents(rows)) == named(documents([(r[0], r[1], "zz", "other") for r in rows]))


@pytest.mark.parametrize("rows", [[], [(0, "the house", None, "s")], [(0, None, None, None)]])
def test_nothing_learned(documents, rows):
    out = language.identify(documents(rows)).collect()
    assert [(r["lang_pred"], r["score"]) for r in out] == [("und", 0.0)] * len(rows)


def test_one_language_and_kept_columns(documents):
    docs = documents([(i, t, "en", "s") for i, t in enumerate(sentences("en", 30, 1))] + [(99, "42", "en", "s")])
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 30
