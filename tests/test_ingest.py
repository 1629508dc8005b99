import json

from pyspark.sql import functions as F

from pricebase.functions import skew
from pricebase.sources import dims, export, files, ledger, payloads, store
from pricebase.streaming import ingest


def payload(**changes):
    line = {
        "ordre": 1, "page": 1, "designation": "Pacivation", "unite_brute": "ens", "quantite": 120, "pu_ht": 10.0,
        "total_ht": 1200.0, "est_titre": False, "attributs": {"section_mm": "160", "longueur_m": "2M50"}, "confiance": 0.9,
    }
    body = {
        "type_document": "devis", "est_ts": False, "numero_document": "D-1", "date_document": "FREJUS le 10/04/2026",
        "client_nom": "Croix du Sud", "client_code_postal": "83600", "chantier_code_postal": None, "total_ht": 1200.0,
        "tva_taux": 20, "total_ttc": 1440.0, "lignes": [line], "remarques": None,
    }
    body.update(changes)
    return json.dumps(body, ensure_ascii=False)


def test_payloads_are_tolerant(spark):
    line = json.loads(payload())["lignes"][0]
    rows = [
        ("good", payload()),
        ("fenced", "```json\n" + payload() + "\n```"),
        ("cut", payload()[:50]),
        ("kind", payload(type_document="bon")),
        ("flag", payload(est_ts=None)),
        ("line", payload(lignes=[{**line, "designation": ""}])),
        ("nul", payload(client_nom="A\u0000B")),
    ]
    parsed = payloads.parse_payloads(spark.createDataFrame(rows, "id string, payload string")).persist()
    assert {r.id: r.error for r in payloads.quarantine(parsed).collect()} == {
        "cut": "json", "kind": "type_document", "flag": "est_ts", "line": "ligne"
    }
    lines = {r.id: r for r in payloads.payload_lines(parsed, ["id"]).collect()}
    assert lines["good"].designation == "Pacivation"
    assert (lines["good"].attr_section_mm, lines["good"].attr_longueur_m) == (160.0, None)
    assert {r.id: r.client_nom for r in payloads.headers(parsed, ["id"]).collect()}["nul"] == "AB"


def test_segments_merge_in_order(spark):
    parts = [
        ("d", 1, payload(type_document="indetermine", numero_document=None, total_ht=5.0, remarques="un")),
        ("d", 2, payload(type_document="facture", total_ht=9.0, est_ts=True, remarques="")),
        ("d", 3, payload(type_document="devis", total_ht=None, numero_document="late", remarques="trois")),
    ]
    frame = spark.createDataFrame(parts, "document_key string, segment int, payload string")
    parsed = payloads.parse_payloads(frame)
    (head,) = payloads.merged_headers(payloads.headers(parsed, ["document_key", "segment"])).collect()
    assert (head.type_document, head.numero_document, head.total_ht) == ("facture", "D-1", 9.0)
    assert (head.est_ts, head.remarques) == (False, "un | trois")
    merged = payloads.merged_lines(payloads.payload_lines(parsed, ["document_key", "segment"]))
    assert [r.ord for r in merged.orderBy("segment").collect()] == [1, 2, 3]


def test_lines_of_longer_segments_are_numbered_in_order(spark):
    one = json.loads(payload())["lignes"][0]
    parts = [("d", s, payload(lignes=[one | {"ordre": 9, "designation": f"{s}.{i}"} for i in range(n)])) for s, n in ((1, 3), (2, 0), (3, 2))]
    frame = spark.createDataFrame(parts, "document_key string, segment int, payload string")
    merged = payloads.merged_lines(payloads.payload_lines(payloads.parse_payloads(frame), ["document_key", "segment"]))
    assert [r.designation for r in merged.orderBy("ord").collect()] == ["1.0", "1.1", "1.2", "3.0", "3.1"]
    assert sorted(r.ord for r in merged.collect()) == [1, 2, 3, 4, 5]


def test_unreadable_batch_lines_are_quarantined(spark, tmp_path):
    answer = {"custom_id": "1", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "{}"}}]}}}
    nameless = {k: v for k, v in answer.items() if k != "custom_id"}
    file = tmp_path / "answers.jsonl"
    file.write_text("\n".join([json.dumps(answer), json.dumps(answer | {"custom_id": "2"})[:40], "", json.dumps(nameless)]) + "\n")
    answers = payloads.read_batch_answers(spark, str(file))
    assert [(r.import_id, r.content) for r in payloads.batch_results(answers).collect()] == [("1", "{}")]
    assert sorted(r.reason for r in payloads.batch_quarantine(answers).collect()) == ["custom_id", "json"]
    assert payloads.read_batch_results(spark, str(file)).count() == 1


def test_only_real_nul_escapes_are_dropped(spark):
    from pricebase.functions.text import without_nul

    texts = [("a\\u0000b", "ab"), ("a\\\\u0000b", "a\\\\u0000b"), ("a\\\\\\u0000b", "a\\\\b"), ("a\x00b", "ab")]
    rows = spark.createDataFrame(texts, "given string, wanted string").select(without_nul(F.col("given")).alias("got"), "wanted")
    assert [r.got for r in rows.collect()] == [w for _, w in texts]


def test_file_inventory(spark, tmp_path):
    (tmp_path / "Pièce n°1.pdf").write_bytes(b"%PDF /Type /Page /Type /Pages /Type/Page\n")
    (tmp_path / "b.txt").write_bytes(b"x")
    got = {r.file_name: r for r in files.file_inventory(spark, str(tmp_path)).collect()}
    pdf = got["Pièce n°1.pdf"]
    assert (pdf.pages, pdf.accepted, got["b.txt"].accepted) == (2, True, False)
    assert pdf.storage_key == f"devis/{pdf.file_hash[:12]}/Piece_n_1.pdf"


def test_stream_resumes_and_ignores_copies(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()

    def drop(name, rows):
        text = "\n".join(json.dumps({"file_name": f, "file_hash": h, "payload": p}) for f, h, p in rows)
        (tmp_path / "in" / name).write_text(text)

    drop("1.json", [("a.pdf", "h1", payload()), ("copy.pdf", "h1", payload()), ("bad.pdf", "h2", "{")])
    ingest.start_ingest(spark, source, output, checkpoint).awaitTermination(120)
    drop("2.json", [("again.pdf", "h1", payload()), ("c.pdf", "h3", payload(chantier_code_postal="06450"))])
    ingest.start_ingest(spark, source, output, checkpoint).awaitTermination(120)
    documents = {r.file_hash: r for r in spark.read.parquet(f"{output}/documents").collect()}
    assert set(documents) == {"h1", "h3"}
    first = documents["h1"]
    assert (first.review_status, first.date_source, str(first.document_date)) == ("valide", "raw", "2026-04-10")
    assert (first.zone_code, first.zone_reliable) == ("83_AUTRE", False)
    assert (documents["h3"].zone_code, documents["h3"].zone_reliable) == ("MERCANTOUR", True)
    lines = spark.read.parquet(f"{output}/lines").collect()
    assert [(r.unit, float(r.quantity_norm), r.control) for r in lines] == [("u", 120.0, "ok")] * 2
    assert spark.read.parquet(f"{output}/quarantine").count() == 1


def test_event_stream_closes_windows(spark, tmp_path):
    rows = [("f1", "extrait", "2026-01-01 10:05:00", 1), ("f1", "insere", "2026-01-01 10:15:00", 2),
            ("f2", "erreur", "2026-01-01 13:00:00", 3)]
    frame = spark.createDataFrame(rows, "file string, state string, ts string, event_id long")
    frame.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("file string, state string, ts timestamp, event_id long").parquet(str(tmp_path / "ev"))
    for name, rows_out, mode in (("w", ingest.event_windows(stream), "append"), ("l", ingest.ledger_stream(stream), "complete")):
        q = rows_out.writeStream.format("memory").queryName(f"out_{name}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r.state, r.n) for r in spark.table("out_w").collect()} == {("extrait", 1), ("insere", 1)}
    assert {r.file: r.status for r in spark.table("out_l").collect()} == {"f1": "insere", "f2": "erreur"}


def test_ledger_stuck_and_retry(spark):
    rows = [("a", "extrait", "2026-01-01 10:00:00", "h1"), ("b", "extrait", "2026-01-01 11:50:00", "h2"),
            ("c", "erreur", "2026-01-01 11:59:00", "h3"), ("d", "erreur", "2026-01-01 09:00:00", None)]
    frame = spark.createDataFrame(rows, "file string, status string, updated_at string, file_hash string")
    frame = frame.withColumn("updated_at", F.to_timestamp("updated_at"))
    now = F.to_timestamp(F.lit("2026-01-01 12:00:00"))
    assert ledger.import_stats(frame, now).first().n_failed == 3
    done = spark.createDataFrame([("h3",)], "file_hash string")
    assert [r.file for r in ledger.retry_set(frame, done, now).collect()] == ["a"]


def test_snapshot_refresh_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "stats")
    rows = spark.range(50).select(F.col("id").alias("item_id"), F.lit(1).alias("n"))
    store.with_item_bucket(rows, 8).write.partitionBy("item_bucket").parquet(path)
    touched = spark.createDataFrame([(3,)], "item_id bigint")
    store.refresh_touched(rows.withColumn("n", F.lit(2)), touched, path, 8)
    got = {r.item_id: r.n for r in spark.read.parquet(path).collect()}
    assert len(got) == 50 and got[3] == 2 and 1 in got.values()
    # an item that lost its last line, alone in its bucket or not
    lost = rows.where("item_id <> 3")
    same = store.with_item_bucket(rows, 8).where("item_id = 3").first().item_bucket
    alone = store.with_item_bucket(rows, 8).where(f"item_bucket <> {same}").drop("item_bucket")
    store.refresh_touched(lost, touched, path, 8)
    assert 3 not in {r.item_id for r in spark.read.parquet(path).collect()}
    store.refresh_touched(alone, touched, path, 8)
    assert {r.item_id for r in spark.read.parquet(path).collect()} == {r.item_id for r in alone.collect()}


def test_csv_file(spark, model, tmp_path):
    from checks import queries
    from pricebase.operators import grid

    rows = grid.price_grid(queries.base(model, False), queries.categorised(model))
    export.write_csv(rows, grid.grid_order("label"), str(tmp_path / "csv"))
    parts = sorted((tmp_path / "csv").glob("part-*.csv"))
    texts = [p.read_text(encoding="utf-8") for p in parts]
    lines = [t.rstrip("\n").split("\n") for t in texts]
    assert all(t.startswith("\ufeff\"Lot\";\"Code\"") for t in texts)
    body = [row for own in lines for row in own[1:]]
    assert len(body) == rows.count() and all(row.count(";") == 16 for row in body)
    wanted = [r.csv_line for r in export.csv_rows(rows.orderBy(*grid.grid_order("label"))).collect()]
    assert body == wanted
    export.write_csv(rows, grid.grid_order("label"), str(tmp_path / "few"), max_rows=5)
    few = [line for p in (tmp_path / "few").glob("part-*.csv") for line in p.read_text(encoding="utf-8").rstrip("\n").split("\n")[1:]]
    assert few == wanted[:5]


def test_reference_dimensions(spark):
    assert dims.units(spark).count() == 9
    assert dims.zone_towns(spark).join(dims.zones(spark).select(F.col("code").alias("zone_code")), "zone_code").count() == len(dims.ZONE_TOWNS)
    assert dims.unit_aliases(spark).groupBy("alias").count().where("count > 1").count() == 0
    assert dims.categories(spark).where("parent_id is not null").count() == 2


def test_answers_are_parsed_once_for_merged_lines(spark):
    line = '{"ordre":1,"page":1,"designation":"x","confiance":0.5}'
    answer = '{"type_document":"devis","est_ts":false,"lignes":[%s]}'
    texts = [
        (1, "a", "```json\n" + answer % f"{line},{line}" + "\n``` fin"),
        (1, "b", "} avant " + answer % line + "\\u0000"),
        (1, "c", "} rien {"),
        (1, "d", None),
        (1, "e", ""),
    ]
    rows = spark.createDataFrame(texts, "document_key int, segment string, payload string")
    parsed = payloads.parse_payloads(rows)
    assert {r.segment: r.error for r in parsed.collect()} == {"a": None, "b": None, "c": "json", "d": "json", "e": "json"}
    lines = payloads.payload_lines(parsed, ["document_key", "segment"]).select("document_key", "segment", "position")
    merged = payloads.merged_lines(lines)
    assert sorted((r.segment, r.position, r.ord) for r in merged.collect()) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 3)]
    assert "from_json" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_merged_lines_move_once_and_long_documents_lie_in_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(skew, "SAMPLED", 1_000)
    rows = [("long", f"{s:05d}", i) for s in range(500) for i in range(1, 1 + s % 4)]
    rows += [(f"d{d}", str(s), 1) for d in range(50) for s in range(3)]
    rows += [("d0", "1", 1), ("d0", "1", 1), (None, "1", 1), ("d1", None, 1)]  # keys repeat or are missing
    frame = spark.createDataFrame(rows, "document_key string, segment string, position int")
    parts = skew.range_parts(frame, ["document_key", "segment"], 4)
    assert frame.where("document_key = 'long'").select(parts.alias("p")).distinct().count() > 1
    merged = payloads.merged_lines(frame)
    known = [r for r in rows if r[0] and r[1]]
    expected = sorted((d, s, i, i + sum(1 for e, t, _ in known if e == d and t < s)) for d, s, i in known)
    assert sorted(map(tuple, merged.collect())) == expected
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= 2 and "SortMergeJoin" not in plan
    run = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert run.count("Exchange hashpartitioning") <= 1
