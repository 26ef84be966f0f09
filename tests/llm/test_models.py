"""The trained models' rows against plain scorers: one text, one n-gram or window at a time, nothing of the library but the model."""

import math
import re
import unicodedata
import zlib

import pytest

pytest.importorskip("netmetrics.llm")
import zstandard  # noqa: E402

from netmetrics.llm import langid, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [(-1, None), (-2, ""), (-3, "123 ... !"), (-4, "a"), (-5, "Żółć ÄÖÜ ßtraße"), (-6, "漢字かな"), (-7, "you stupid idiot"), (-8, "Lorem IPSUM dolor " * 4000), (None, "no id at all"), (-7, "you stupid idiot"), (-9, "\x00퟿ \U0001f600")]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return given.unionByName(spark.createDataFrame([(*x, None) for x in ODD], "doc_id long, text string, lang string"))


def folded_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def plain_language(text, m):
    """(language, probability) from the table's rows of all n-grams, hashed by hand."""
    if text is None or not any(unicodedata.category(ch)[0] == "L" for ch in text):
        return "und", 0.0
    raw, total, count = re.sub(rb"[A-Z]", lambda x: x[0].lower(), text.encode()), [0.0] * len(m.languages), 0
    for n in (2, 3, 4):
        for at in range(len(raw) - n + 1):
            h = n
            for x in raw[at : at + n]:
                h = (h ^ x) * 0x01000193 % 2**32
            row = m.table[(h ^ h >> 15) % 2**15]
            total, count = [a + float(b) for a, b in zip(total, row, strict=True)], count + 1
    z = [(t / max(count, 1) + float(b)) * m.temperature for t, b in zip(total, m.bias, strict=True)]
    e = [math.exp(x - max(z)) for x in z]
    best = max(range(len(e)), key=e.__getitem__)
    return m.languages[best], e[best] / sum(e)


def test_language_rows_equal_a_plain_scorer(docs):
    m = langid.fitted(docs)
    got = langid.identify(docs, m).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == docs.where("doc_id IS NOT NULL").count()
    for r in got:
        lang, score = plain_language(r["text"], m)
        assert r["score"] == pytest.approx(score, abs=1e-5) and r["held_out"] == folded_out(r["doc_id"]), r["doc_id"]
        assert r["lang_pred"] == lang and r["rejected"] == (lang == "und" or r["score"] < m.threshold), r["doc_id"]
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {-1, -2, -3, -9}


def test_language_of_rows_that_were_held_out(docs):
    gold = {r["doc_id"]: r["lang"] for r in docs.collect() if r["lang"] is not None and r["text"] and folded_out(r["doc_id"])}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fitted(docs)).collect()}
    assert len(gold) > 5 and sum(got[d] == lang for d, lang in gold.items()) >= 0.9 * len(gold)


def plain_toxicity(text, m):
    """The score from every window, compressed by compressors made for it alone."""
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = b" " + b" ".join(word.findall(re.sub(rb"[A-Z]", lambda x: x[0].lower(), (text or "").encode()))) + b" "
    p = zstandard.ZstdCompressionParameters.from_level(6, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)

    def size(window, raw):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress(window))

    saved, at = [], 0
    while at == 0 or at + 12 < len(low):  # windows of 32 bytes, 20 apart, until one reaches the end
        saved.append(size(low[at : at + 32], m.ordinary) - size(low[at : at + 32], m.toxic))
        at += 20
    top = sorted(saved)[-3:]
    x = [top[-1], sum(top) / 3, math.log1p(sum(max(0, s - 2) for s in saved)), math.log1p(len(saved))]
    z = sum(a * float(b) for a, b in zip(x, m.weights, strict=True)) + m.bias
    return top[-1], 1 / (1 + math.exp(-z))


def test_toxicity_rows_equal_a_plain_scorer(spark, docs):
    m = toxicity.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert m.weights.any()
    got = toxicity.score(docs, m).join(docs.where("doc_id <> -8 AND (length(text) < 3000 OR text IS NULL)").select("doc_id", "text").distinct(), "doc_id").collect()  # the plain scorer is slow
    assert len(got) > 50
    for r in got:
        most, score = plain_toxicity(r["text"], m)
        assert r["saved_most"] == most and r["score"] == pytest.approx(score, abs=1e-9), r["doc_id"]
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == folded_out(r["doc_id"])
