import json
import random
import re
from urllib.error import URLError
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tillspark import model
from tillspark.functions.text import WHITESPACE, trim_blank
from tillspark.operators import bridge, contract, extraction, queue, replication, sieve
from tillspark.sources import adapter

NOW = datetime(2026, 7, 14, 10, 0, 0, 5)
VALID = {
    "schemaVersion": 1, "documentType": "receipt",
    "merchant": {"rawName": "MARKET", "normalizedName": "Market"},
    "transactionDate": "2026-07-13", "currency": "EUR", "subtotalMinor": 1000, "taxMinor": 100,
    "discountMinor": 0, "totalMinor": 1100, "categoryId": "food_grocery",
    "items": [{"rawName": "LATTE", "normalizedName": "Latte", "quantity": 1,
               "unitPriceMinor": 1100, "totalPriceMinor": 1100, "categoryId": "food_grocery",
               "confidence": 0.9}],
    "confidence": 0.92, "warnings": [],
}


def changed(**fields):
    return json.dumps({**VALID, **fields})


def item(**fields):
    return changed(items=[{**VALID["items"][0], **fields}])


def violations(spark, *replies, rules=contract.SERVER):
    df = spark.createDataFrame(list(enumerate(replies)), "n long, reply string")
    found = contract.validate_extractions(df, rules).orderBy("n").collect()
    return [list(r.violations) for r in found]


CASES = [
    (json.dumps(VALID), []),
    ("{}", []),
    ("```json\n" + json.dumps(VALID) + "\n```", []),
    ("``` " + json.dumps(VALID) + "```", []),
    (changed(totalMinor=-100, confidence=1.2), ["total", "confidence"]),
    (changed(totalMinor="12"), ["total"]),
    (changed(totalMinor=1.5), ["total"]),
    (changed(totalMinor=None, transactionDate=None), []),
    (changed(transactionDate="2026-7-1"), ["transaction_date"]),
    (changed(currency="EURO"), ["currency"]),
    (changed(currency=None), ["currency"]),
    (changed(schemaVersion=2), ["schema_version"]),
    (changed(documentType="invoice"), ["document_type"]),
    (changed(extra=1), ["extra_key"]),
    (changed(merchant={"rawName": None, "other": 1}), ["merchant"]),
    (changed(merchant=None), ["merchant"]),
    (changed(merchant={"rawName": "x" * 301}), ["merchant"]),
    (changed(merchant={}), []),
    (changed(categoryId="c" * 81), ["category"]),
    (changed(items=None), ["items"]),
    (changed(items=[None]), ["items"]),
    (changed(items=[VALID["items"][0], None]), ["items"]),
    (changed(items=[{}]), []),
    (changed(items=[VALID["items"][0]] * 250), []),
    (changed(items=[VALID["items"][0]] * 251), ["items"]),
    (item(rawName=None), ["items"]),
    (changed(items=[VALID["items"][0], {"rawName": None}]), ["items"]),
    (item(quantity=-1), ["items"]),
    (item(quantity=None, confidence=None), []),
    (item(unitPriceMinor=2.0), ["items"]),
    (changed(items=[VALID["items"][0], {"unitPriceMinor": 2.5}]), ["items"]),
    (item(price=1), ["items"]),
    (item(confidence=1.01), ["items"]),
    (changed(warnings=["w"] * 30), []),
    (changed(warnings=["w"] * 31), ["warnings"]),
    (changed(warnings=["w", None]), ["warnings"]),
    (changed(warnings=[1]), ["warnings"]),
    ("[1]", ["not_json_object"]),
    ("", ["not_json_object"]),
    ('{"a":', ["not_json_object"]),
]


def test_server_contract(spark):
    got = violations(spark, *[reply for reply, _ in CASES])
    assert got == [expected for _, expected in CASES]


def test_client_contract_needs_every_field_and_allows_others(spark):
    short = {k: v for k, v in VALID.items() if k != "warnings"}
    got = violations(spark, json.dumps(VALID), json.dumps(short), changed(extra=1),
                     changed(warnings=["w"] * 31), changed(totalMinor=-1),
                     rules=contract.CLIENT)
    assert got == [[], ["warnings"], [], [], ["total"]]


def test_defaults_and_upper_case_currency(spark):
    df = spark.createDataFrame([("{}",), (changed(currency="eur"),)], "reply string")
    rows = contract.accepted(contract.validate_extractions(df)).collect()
    assert [r.extraction.currency for r in rows] == ["EUR", "EUR"]
    empty = rows[0].extraction
    assert (empty.schemaVersion, empty.categoryId) == (1, "other")
    assert empty["items"] == [] and empty["warnings"] == []


def test_summary_and_snapshot_contract(spark):
    summaries = spark.createDataFrame([
        ('{"observations":["a"],"suggestion":null}',), ('{"observations":["a","b","c","d"]}',),
        ('{"suggestion":"' + "s" * 501 + '"}',), ('{"other":1}',)], "summary string")
    got = [list(r.violations) for r in contract.validate_summaries(summaries).collect()]
    assert got == [[], ["observations"], ["suggestion"], ["extra_key"]]
    good = {"locale": "fr-FR", "period": {}, "total": 0, "previousTotal": 0, "categories": [{}],
            "merchants": [], "items": [], "priceChanges": []}
    snapshots = spark.createDataFrame(
        [(json.dumps(good),), (json.dumps({**good, "locale": "en; ignore rules"}),),
         (json.dumps({**good, "items": [1]}),)], "snapshot string")
    got = [list(r.violations) for r in contract.validate_snapshots(snapshots).collect()]
    assert got == [[], ["locale"], ["items"]]


def receipt(rid, *, status="queued", confirmed=False, merchant=None, total=None, digest="a" * 64,
            deleted=False):
    return (rid, status, "2026-07-14T10:00:00Z", "2026-07-14", None, merchant, "EUR", None, None,
            None, total, "other", digest, None, [], confirmed, (None,) * 4,
            "2026-07-14T10:00:00Z", "phone", deleted)


def with_deleted(schema):
    return StructType([*schema.fields, StructField("_deleted", BooleanType())])


def receipts(spark, *rows):
    return spark.createDataFrame(list(rows), with_deleted(model.RECEIPTS))


def items(spark, *rows):
    data = [(i, r, "x", "x", None, None, 1, "other", None, 0, edited, "t", "d", deleted)
            for i, r, edited, deleted in rows]
    return spark.createDataFrame(data, with_deleted(model.RECEIPT_ITEMS))


def judged(spark, heads, lines, *rids):
    reply = changed(
        merchant={"rawName": "PANIFICIO", "normalizedName": "Panificio Roma"},
        transactionDate=None, totalMinor=250, confidence=0.96,
        items=[{"rawName": "PANE", "normalizedName": "Pane", "quantity": 1, "unitPriceMinor": 250,
                "totalPriceMinor": 250, "categoryId": "food_grocery", "confidence": 0.97},
               {"rawName": "UOVA"}])
    replies = spark.createDataFrame([(f"job-{r}", r, reply) for r in rids],
                                    "job_id string, receipt_id string, reply string")
    return extraction.judge(contract.accepted(contract.validate_extractions(replies)), heads,
                            lines)


def test_apply_extraction(spark):
    heads = receipts(spark, receipt("r1"), receipt("r2", confirmed=True), receipt("r3"),
                     receipt("r4", deleted=True), receipt("r6"))
    lines = items(spark, ("i1", "r1", False, False), ("i2", "r1", True, True),
                  ("i3", "r3", True, False))
    result = judged(spark, heads, lines, "r1", "r2", "r3", "r4", "r5", "r6")
    outcome = {r.receipt_id: r.status for r in extraction.job_outcomes(result, NOW).collect()}
    assert outcome == {"r1": "completed", "r2": "skipped", "r3": "skipped", "r4": "skipped",
                       "r5": "skipped", "r6": "completed"}
    merged = extraction.merged_receipts(result, NOW, "ollama", "vision:latest")
    row = merged.where("id = 'r1'").first()
    assert (row.status, row.merchantNormalized, row.totalMinor, row.transactionDate) == (
        "needs_review", "Panificio Roma", 250, "2026-07-14")
    assert tuple(row.ai) == ("ollama", "vision:latest", "receipt-v1", 1)
    gone = extraction.item_tombstones(result, lines, NOW).collect()
    assert [(g.id, g["_deleted"]) for g in gone] == [("i1", True)]
    fresh = extraction.new_items(result, NOW).where("receiptId = 'r1'").orderBy("position")
    assert [(f.normalizedName, f.totalPriceMinor, f.position) for f in fresh.collect()] == [
        ("Pane", 250, 0), ("UOVA", None, 1)]


def test_readiness(spark):
    heads = receipts(spark, receipt("r1"), receipt("r2", confirmed=True))
    jobs = spark.createDataFrame(
        [("j1", "r1", "a" * 64), ("j2", "r1", "b" * 64), ("j3", "r2", "a" * 64),
         ("j4", "none", "a" * 64)], "id string, receipt_id string, image_hash string")
    got = {r.job_id: r.readiness for r in extraction.job_readiness(jobs, heads).collect()}
    assert got == {"j1": "ready", "j2": "invalid", "j3": "skipped", "j4": "not_ready"}


def test_backfill_of_blank_confirmed_receipt(spark):
    heads = receipts(
        spark, receipt("legacy", confirmed=True), receipt("plain"),
        receipt("busy", status="processing"), receipt("queued"), receipt("no-image",
                                                                         digest="c" * 64),
        receipt("review", status="needs_review"), receipt("bad", digest="../x"))
    jobs = spark.createDataFrame([("queued",)], "receipt_id string")
    store = spark.createDataFrame([("a" * 64,)], "hash string")
    found = extraction.backfill(heads, jobs, store)
    assert {r.id: r.reset for r in found.collect()} == {
        "legacy": True, "plain": False, "busy": True}
    fixed = extraction.backfilled_receipts(found, NOW).where("id = 'legacy'").first()
    assert (fixed.status, fixed.userConfirmed) == ("queued", False)


def job(jid, rid, digest="a" * 64, status="pending", attempts=0, due=None, created="t"):
    return (jid, rid, digest, "ollama", "it-IT", "EUR", status, attempts, due, "code", "message",
            created, created)


def test_same_upload_keeps_job_and_new_hash_resets(spark):
    jobs = spark.createDataFrame([job("j1", "r1", status="completed", attempts=3),
                                  job("j2", "r2", status="failed", attempts=5)], model.EXTRACTION_JOBS)
    requests = spark.createDataFrame(
        [("r1", "a" * 64, "fr-FR", "CHF", 0), ("r1", "a" * 64, "de-DE", "CHF", 1),
         ("r2", "b" * 64, "fr-FR", "CHF", 2), ("r2", "a" * 64, "es-ES", "CHF", 3),
         ("r3", "c" * 64, "it-IT", "EUR", 4)],
        "receipt_id string, image_hash string, locale string, currency string, ord long")
    table = {r.receipt_id: r for r in queue.enqueue(jobs, requests, "openai", NOW,
                                                    width=2).collect()}
    assert (table["r1"].status, table["r1"].attempts, table["r1"].locale) == (
        "completed", 3, "it-IT")
    assert (table["r2"].status, table["r2"].attempts, table["r2"].locale) == (
        "pending", 0, "es-ES")
    assert table["r3"].status == "pending" and table["r3"].id


def test_failures_and_attempts(spark):
    jobs = spark.createDataFrame([job(f"j{n}", f"r{n}", status="processing", attempts=4)
                                  for n in range(9)], model.EXTRACTION_JOBS)
    kinds = [f[0] for f in queue.FAILURES] + ["strange"]
    failures = spark.createDataFrame([(f"j{n}", k) for n, k in enumerate(kinds)],
                                     "id string, failure string")
    rows = {k: r for k, r in zip(kinds, sorted(queue.fail(jobs, failures, NOW).collect(),
                                               key=lambda r: r.id))}
    assert rows["not_ready"].status == "pending" and rows["not_ready"].attempts == 4
    assert rows["missing_key"].last_error_code == "provider_unavailable"
    assert rows["missing_key"].attempts == 4
    for kind in ("http", "timeout", "invalid", "file", "other", "strange"):
        assert (rows[kind].status, rows[kind].attempts, rows[kind].next_attempt_at) == (
            "failed", 5, None)


def test_claim_is_oldest_due(spark):
    jobs = spark.createDataFrame([
        job("late", "r1", created="b"), job("early", "r2", created="a", due="2027"),
        job("next", "r3", created="aa"), job("busy", "r4", created="a", status="processing")], model.EXTRACTION_JOBS)
    assert [r.id for r in queue.claim(jobs, NOW).collect()] == ["next"]


def test_backoff_sequence(spark):
    df = spark.range(1, 9).select(queue.backoff_minutes(F.col("id").cast("int")).alias("m"))
    assert [r.m for r in df.collect()] == [1, 2, 4, 8, 16, 32, 60, 60]


def test_model_seam(spark):
    def fake(content, mime_type, prompt):
        if content == b"bad":
            raise ValueError("no")
        if content == b"gone":
            raise FileNotFoundError("no")
        if content == b"key":
            raise KeyError("no")
        if content == b"down":
            raise URLError("unreachable")
        if content == b"own":
            raise extraction.ModelUnavailable("no")
        return json.dumps(VALID)

    requests = spark.createDataFrame(
        [("j1", "r1", b"ok"), ("j2", "r2", b"bad"), ("j3", "r3", b"gone"), ("j4", "r4", b"key"),
         ("j5", "r5", b"down"), ("j6", "r6", b"own"), ("j7", "r7", None)],
        "job_id string, receipt_id string, content binary").withColumns({
            "mimeType": F.lit("image/jpeg"),
            "prompt": extraction.receipt_prompt(F.lit("it-IT"), F.lit("EUR"))})
    rows = {r.job_id: r for r in extraction.call_model(requests, fake).collect()}
    assert json.loads(rows["j1"].reply) == VALID and rows["j1"].failure is None
    assert [rows[f"j{n}"].failure for n in range(2, 8)] == [
        "invalid", "file", "lookup", "http", "http", "file"]


def test_prompts(spark):
    row = spark.range(1).select(
        extraction.receipt_prompt(F.lit("it-IT"), F.lit("CHF")).alias("a"),
        extraction.insight_prompt(F.lit("fr-FR"), F.lit("{}")).alias("b")).first()
    assert row.a.endswith("Locale: it-IT. Valuta predefinita: CHF.")
    assert "locale fr-FR" in row.b and row.b.endswith("Dati aggregati:\n{}")


@pytest.mark.parametrize("code,attempts,status,tries", [
    (None, 2, "completed", 2), ("503", 9, "pending", 10), ("network", 9, "pending", 10),
    ("413", 3, "pending", 4), ("413", 4, "failed", 5)])
def test_client_outcome(spark, code, attempts, status, tries):
    jobs = spark.createDataFrame(
        [("j", "image-upload", "r", "processing", attempts, None, None, None, "t", "t")],
        model.CLIENT_JOBS)
    results = spark.createDataFrame([("j", code, "m" * 400)],
                                    "id string, error_code string, message string")
    row = queue.client_outcome(jobs, results, NOW).first()
    assert (row.status, row.attempts) == (status, tries)
    assert code is None or len(row.lastErrorMessage) == 300


def test_other_client_jobs_keep_their_error(spark):
    jobs = spark.createDataFrame(
        [("j", "ai-insight", "r", "processing", 1, None, "503", "before", "t", "t")],
        model.CLIENT_JOBS)
    results = spark.createDataFrame([("j", None, None)],
                                    "id string, error_code string, message string")
    row = queue.client_outcome(jobs, results, NOW).first()
    assert (row.status, row.lastErrorCode, row.lastErrorMessage) == ("pending", "503", "before")


def test_replies_break_every_rule_and_hold_the_items_of_their_receipt(spark, sf_dir):
    broken = contract.rejected(contract.validate_extractions(adapter.extractions(spark, sf_dir)))
    seen = {r.rule for r in broken.select(F.explode("violations").alias("rule")).distinct()
            .collect()}
    assert seen == {"not_json_object", "extra_key", "total", *[rule for rule, _, _ in
                                                               adapter.BROKEN]}
    lines = adapter.reply_items(spark, sf_dir).select(F.sum(F.size("lines")).alias("n"))
    assert lines.first().n == adapter.receipt_items(spark, sf_dir).count()


def test_a_list_beyond_the_bound_is_cut_one_beyond_it(spark, monkeypatch):
    item = spark.createDataFrame([("r", "X", "", 1.0, 5, 5, "c")],
                                 "receiptId string, rawName string, normalizedName string, "
                                 "quantity double, unitPriceMinor long, totalPriceMinor long, "
                                 "categoryId string")
    many = item.crossJoin(spark.range(600).select(
        F.col("id").cast("int").alias("position"), F.col("id").cast("string").alias("id")))
    monkeypatch.setattr(adapter, "receipt_items", lambda s, d: many)
    found = adapter.reply_items(spark, "").select(F.size("lines").alias("n")).first()
    assert found.n == model.EXTRACTED_ITEMS_MAX + 1


def test_numbers_are_dense_and_rows_are_shuffled_once(spark):
    rows = spark.createDataFrame([
        ("b", "2", "x"), ("a", "9", "y"), (None, "1", "z"), ("a", None, "u"), ("b", "2", "v")],
        "collection_name string, document_id string, document_json string")
    dense = bridge.numbered(rows, ["collection_name", "document_id"])
    found = [(r.position, r.collection_name, r.document_id) for r in dense.collect()]
    assert sorted(found) == [(0, None, "1"), (1, "a", None), (2, "a", "9"), (3, "b", "2"),
                             (4, "b", "2")]
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "collection_name" in plan
    jsons = [r.document_json for r in dense.where("document_id = '2'").collect()]
    assert sorted(jsons) == ["v", "x"]


def test_numbering_reads_keys_only(spark):
    rows = spark.range(50).select(
        F.lit("receipts").alias("collection_name"), F.col("id").cast("string")
        .alias("document_id"), F.raise_error(F.lit("read")).cast("string").alias("document_json"))
    dense = bridge.numbered(rows, ["collection_name", "document_id"])
    assert sorted(r.position for r in dense.select("position").collect()) == list(range(50))


def test_shards_of_any_size_give_dense_numbers(spark, monkeypatch):
    rnd = random.Random(1)
    keys = [(rnd.choice(["b", "a", None]), rnd.choice(["z", "é", "10", "9", "", None, "Z"]))
            for _ in range(300)]
    rows = spark.createDataFrame(keys, "collection_name string, document_id string")
    ordered = sorted(keys, key=lambda k: [(v is not None, (v or "").encode()) for v in k])
    for size, apart in ((1, 0), (2, 1), (5, 0), (500_000, 1)):
        monkeypatch.setattr(bridge, "SHARD_KEYS", size)
        dense = bridge.numbered(rows, ["collection_name", "document_id"], apart=apart).collect()
        found = {r.position: (r.collection_name, r.document_id) for r in dense}
        assert [found[n] for n in range(300)] == ordered
    assert bridge.numbered(rows.limit(0), ["collection_name"]).collect() == []


def test_a_log_that_is_dealt_out_is_not_shuffled_for_its_state(spark):
    rows = spark.createDataFrame(
        [(c, str(n), '{"id":"%d"}' % n) for c in ("receipts", "receipt_items") for n in range(40)],
        "collection_name string, document_id string, document_json string")
    log = bridge.append(rows, 7, "now", shards=True)
    state = replication.current_state(log.where("collection_name = 'receipts'"))
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("receipts", plan.index("Exchange")) > 0
    assert sorted(r.server_sequence for r in state.collect()) == list(range(48, 88))
    assert "_shard" not in state.columns + bridge.append(rows, 7, "now").columns


def test_items_to_replace_are_filtered_below_their_join(spark):
    judged = spark.createDataFrame([("r1", False), ("r1", False), ("r2", True)],
                                   "receipt_id string, skip boolean")
    items = spark.createDataFrame(
        [("a", "r1", False), ("b", "r1", None), ("c", "r1", True), ("d", "r2", False),
         ("e", None, False)], "id string, receiptId string, _deleted boolean")
    near = sieve.sieved(items, extraction.taken_receipts(judged), ["receiptId"])
    gone = extraction.item_tombstones(judged, near, NOW)
    assert sorted(r.id for r in gone.collect()) == ["a", "b"]
    plan = gone._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if "Join" in line]
    assert len(joins) == 2 and "receiptId" in joins[0] and "_block" in joins[1]


def test_client_contract_on_list_entries(spark):
    entry = VALID["items"][0]
    short = {k: v for k, v in entry.items() if k != "quantity"}
    good = [item(), item(quantity=None), item(price=1), item(rawName="x" * 301),
            changed(items=[]), changed(items=[entry] * 250)]
    bad = [changed(items=[entry, short]), changed(items=[entry, None]), changed(items=[[]]),
           item(rawName=None), item(confidence=1.5), item(confidence=-0.1), item(quantity="1"),
           item(totalPriceMinor=1.0), changed(items=[entry] * 251), changed(items=[None] * 251),
           changed(items=None), changed(items={"0": entry})]
    got = violations(spark, *good, *bad, rules=contract.CLIENT)
    assert got == [[]] * len(good) + [["items"]] * len(bad)


def test_methods_that_make_replies_are_compiled(spark, sf_dir, capsys):
    """The JVM compiles no method of over 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows none yet
    try:
        adapter.extractions(spark, sf_dir).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)
    assert sizes and max(map(int, sizes)) < 8000


def test_rows_carry_the_verdict_on_entries_and_not_the_entries(spark):
    df = spark.createDataFrame([("{}",)], "reply string")
    plan = contract.validate_extractions(df, contract.CLIENT)._jdf.queryExecution()
    made = [line for line in plan.optimizedPlan().toString().split("\n") if "Generate" in line]
    assert made and not any(re.search(r"\[[^\[]*_item(s|_maps)#\d+[^\[]*\]\s*$", line)
                            for line in made)


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "a\u00a0", "\u00e8", "\u00e8 ", "a\u00e8",
                                  "a\ufeff", "\x7f", "a\x7f"])
def test_trim_by_last_byte(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(trim_blank(F.col("t"))).first()
    assert row[0] == text.strip("".join(WHITESPACE))
