"""Language identification: edge texts, the folds, held-out accuracy."""

from __future__ import annotations

import zlib

import pytest

from hirelake.llm import langid

EN = "the house and the garden of the old man are on the other side of the river where they live "
DE = "das haus und der garten des alten mannes liegen auf der anderen seite des flusses wo sie wohnen "


@pytest.fixture(scope="module")
def model():
    return {"de": DE.encode() * 3, "en": EN.encode() * 3}


def test_edge_texts(model):
    predict = langid.Classifier(model).predict
    assert predict(None) == predict("") == predict("12 !? \n") == ("und", 0.0)
    assert predict("The old man lives in the garden of the house")[0] == "en"
    assert predict("DER ALTE MANN WOHNT AUF DER ANDEREN SEITE")[0] == "de"
    assert predict("the the the the garden of the river")[0] == "en"
    long = predict("they live on the other side of the garden " * 60_000)
    assert long[0] == "en" and 0 < long[1] <= 1
    lang, score = predict("qx")
    assert lang == "de" and score < langid.MARGIN  # a tie
    assert langid.Classifier({}).predict("some text") == ("und", 0.0)
    assert langid.Classifier({"en": b"x"}).predict("some text") == ("en", 1.0)


def test_folds_and_columns(spark, model):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    rows += [(None, EN, "fr"), (41, None, "en"), (42, "", "en"), (43, EN, None), (43, EN, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1.5D as score", "'x' as lang_pred")
    own = [(i, t, lang) for i, t, lang in rows if i is not None and lang and t and zlib.crc32(str(i).encode()) % 5]
    fitted = langid.fit(docs)
    assert sorted(fitted) == ["de", "en"]
    assert fitted["en"].count(langid.letters(EN)) == sum(lang == "en" for _, _, lang in own)
    kept = langid.accepted(docs, fitted)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 2
    assert langid.accepted(docs.limit(0), fitted).count() == 0
    assert langid.fit(docs.limit(0)) == {}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = langid.op5_language_id(spark, folder)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = got.collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.96 * len(held)
    assert sum(not r.accepted for r in out) < 0.01 * len(out)


def test_numerals_are_no_letters(model):
    predict = langid.Classifier(model).predict
    assert predict("½ ² ③ Ⅷ ٣ 7") == ("und", 0.0)
    assert langid.letters("a½b x² 3c") == b"a b x c"


def test_many_rows_of_one_id_keep_their_language(spark):
    rows = [(7, "repeated words of one document here", "en")] * 10_000
    rows += [(i, f"viele worte des dokuments nummer {chr(97 + i % 26)}", "de") for i in range(3000)]
    rows += [(9, f"autres mots {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "fr") for i in range(1, 2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = langid.fit(docs)
    assert sorted(fitted) == ["de", "en", "fr"]
    assert fitted["en"] == b"repeated words of one document here"
    assert fitted["de"].count(b"nummer") == langid.SAMPLE_ROWS == fitted["fr"].count(b"autres")


def test_against_a_plain_version(spark):
    """Dictionaries and sizes by other code, from collected rows."""
    import zstandard

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "xxhash64(doc_id, text) AS digest").collect()

    def words(text):
        out = []
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            if not out or out[-1] != word:
                out.append(word)
        return " ".join(out).encode()

    samples = {}
    for digest, lang, text in sorted({(r.digest, r.lang, r.text) for r in rows if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5}):
        samples.setdefault(lang, []).append(words(text[:1000]))
    content = {lang: b"\n".join(own[:1000])[: 256 * 1024] for lang, own in samples.items()}
    packers = {lang: zstandard.ZstdCompressor(3, dict_data=zstandard.ZstdCompressionDict(c, zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for lang, c in content.items()}
    got = {r.doc_id: r for r in langid.op5_language_id(spark, folder).collect()}
    for r in rows:
        data = words(r.text or "")
        sizes = sorted((sum(len(p.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)), lang) for lang, p in packers.items())
        want = (sizes[0][1], 1 - sizes[0][0] / sizes[1][0]) if data else ("und", 0.0)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == want


def test_clashing_names_keep_their_values(spark, model):
    docs = spark.createDataFrame([(1, EN, 5, "p", "q")], "`a.b` long, text string, __text long, score string, row string")
    (row,) = langid.accepted(docs, model).collect()
    assert tuple(row) == (1, EN, 5, "p", "q") and langid.accepted(docs, model).columns == docs.columns
