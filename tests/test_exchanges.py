"""Payloads, log, samples, sources and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pii_spark.operators import audit_log, batches, normalize, payloads
from pii_spark.sources import readers, scratch, vault_store, writers
from pii_spark.streaming import streams


def mask_one(spark, body, provider):
    df = spark.createDataFrame([(body if isinstance(body, str) else json.dumps(body), provider)], "body string, provider string")
    return payloads.mask_payloads(df).first()


MAIL = "write to ann.lee@corp.com"


def test_mask_all_shapes(spark):
    for provider, body, path in [
        ("openai", {"model": "m", "n": 1.5, "messages": [{"role": "user", "content": MAIL, "x": [1]}]}, lambda d: d["messages"][0]["content"]),
        ("openai", {"messages": [{"role": "user", "content": [{"type": "image"}, {"type": "text", "text": MAIL}]}]}, lambda d: d["messages"][0]["content"][1]["text"]),
        ("anthropic", {"messages": [{"role": "user", "content": MAIL}]}, lambda d: d["messages"][0]["content"]),
        ("gemini", {"contents": [{"role": "user", "parts": [{"inline": 1}, {"text": MAIL}]}]}, lambda d: d["contents"][0]["parts"][1]["text"]),
    ]:
        row = mask_one(spark, body, provider)
        assert row.mask_status == "masked" and len(row.entities) == 1
        out = json.loads(row.masked_body)
        text = path(out)
        assert "ann.lee@corp.com" not in row.masked_body and text.startswith("write to ")
        (dummy,) = row.masked_to_original
        assert row.masked_to_original[dummy] == "ann.lee@corp.com" and dummy in text
        if "n" in body:
            assert out["n"] == 1.5 and out["messages"][0]["x"] == [1]


def test_mask_other_bodies(spark):
    plain = mask_one(spark, MAIL, None)
    assert plain.mask_status == "text" and "corp.com" not in plain.masked_body
    odd = mask_one(spark, {"prompt": MAIL}, "openai")
    assert odd.mask_status == "unrecognised" and json.loads(odd.masked_body) == {"prompt": MAIL}


def test_mask_nested_blocks_and_bodies_that_are_no_object(spark):
    inner = {"type": "tool_result", "content": [{"type": "text", "text": "x e@f.com"}, {"content": "g@h.com"}]}
    nested = {"messages": [{"role": "user", "content": [{"type": "text", "text": "a@b.com"}, "bare c@d.com", inner]}]}
    deep = {"messages": [{"role": "user", "content": [{"content": [{"content": [{"text": "k@l.com"}]}]}]}]}
    bodies = [json.dumps(nested), json.dumps(deep), json.dumps("mail i@j.com"), json.dumps(["i@j.com"]), "4111111111111111", '{"a": 1}']
    df = spark.createDataFrame([(b, "anthropic") for b in bodies], "body string, provider string")
    got = {r.body: r for r in payloads.mask_payloads(df).collect()}
    one = got[bodies[0]]
    assert one.mask_status == "masked" and not any(x in one.masked_body for x in ("a@b", "c@d", "e@f", "g@h"))
    assert {e.text for e in one.entities} == {"a@b.com", "c@d.com", "e@f.com", "g@h.com"}
    assert got[bodies[1]].mask_status == "masked" and "k@l.com" not in got[bodies[1]].masked_body
    for body in bodies[2:5]:
        assert got[body].mask_status == "text" and got[body].masked_body != body
    assert got[bodies[5]].mask_status == "unrecognised"


def test_mask_strings_at_any_depth(spark):
    def wrapped(value, n):
        for i in range(n):
            value = [value] if i % 2 else {"content" if i % 4 else 'odd \\" key': value}
        return value

    bodies = {
        "anthropic": {"model": "a@b.com", "system": "for c@d.com", "messages": [
            {"role": "user", "content": {"text": "e@f.com"}},
            {"role": "user", "content": [{"type": "tool_use", "input": {"to": "g@h.com", "n": 1.50}}, wrapped("i@j.com", 60)]},
        ]},
        "gemini": {"systemInstruction": {"parts": [{"text": "k@l.com"}]}, "contents": [{"parts": [{"functionCall": {"args": {"x": ["m@n.com"]}}}]}]},
        "openai": {"messages": [{"role": "user", "content": "quote \" and \\ and \n o@p.com { [ ] }", "name": "q@r.com"}], "user": "s@t.com"},
    }
    df = spark.createDataFrame([(json.dumps(b, indent=1, ensure_ascii=p == "gemini"), p) for p, b in bodies.items()], "body string, provider string")
    got = {r.provider: r for r in payloads.mask_payloads(df).collect()}
    for provider, body in bodies.items():
        row = got[provider]
        assert row.mask_status == "masked"
        back = row.masked_body
        for dummy, original in row.masked_to_original.items():
            back = back.replace(dummy, original)
        assert back == row.body and json.loads(back) == body
    assert {e.text for e in got["anthropic"].entities} == {"c@d.com", "e@f.com", "g@h.com", "i@j.com"}
    assert {e.text for e in got["gemini"].entities} == {"k@l.com", "m@n.com"}
    assert {e.text for e in got["openai"].entities} == {"o@p.com", "q@r.com"}
    many = json.dumps({"messages": [{"content": "x\n" * 200_000 + "u@v.com"}]})
    row = mask_one(spark, many, "openai")
    assert row.mask_status == "masked" and "u@v.com" not in row.masked_body and len(row.entities) == 1
    escaped = '{"mess\\u0061ges": [{"content": "w@x\\u002ecom"}]}'
    row = mask_one(spark, escaped, "openai")
    assert row.mask_status == "masked" and [e.text for e in row.entities] == ["w@x.com"] and "w@x" not in row.masked_body


def test_parse_messages_at_any_depth(spark):
    def nested(value, n):
        for i in range(n):
            value = [value] if i % 3 else {"parts": [value]}
        return value

    for n in (0, 3, 4, 10, 80):
        body = {"messages": [{"role": "user", "content": nested(["a", {"text": "b"}, 5, {"content": "c"}, None, {"x": "no"}], n)}]}
        assert parsed(spark, body, "request") == ([("user", "abc")], None)
    long = {"messages": [{"content": [{"text": f"[{i}] "} for i in range(3000)]}]}
    assert parsed(spark, long, "request")[0][0][1] == "".join(f"[{i}] " for i in range(3000))


def test_restore_with_notice(spark):
    rows = [("openai", {"choices": [{"message": {"content": "hi D1"}}, {"text": "D1"}]}),
            ("anthropic", {"content": [{"type": "text", "text": "D1"}, {"type": "tool", "text": "D1"}]}),
            ("gemini", {"candidates": [{"content": {"parts": [{"text": "D1 D1"}]}}]}), ("openai", None)]
    df = spark.createDataFrame([(json.dumps(b) if b else "D1 plain", p, {"D1": "Ann"}) for p, b in rows], "response string, provider string, masked_to_original map<string,string>")
    out = [r.restored_body for r in payloads.restore_payloads(df, notice=" !").collect()]
    assert json.loads(out[0])["choices"] == [{"message": {"content": "hi Ann !"}}, {"text": "D1"}]
    assert json.loads(out[1])["content"] == [{"type": "text", "text": "Ann !"}, {"type": "tool", "text": "D1"}]
    assert json.loads(out[2])["candidates"][0]["content"]["parts"] == [{"text": "Ann Ann !"}]
    assert out[3] == "D1 plain"


def test_routing(spark):
    rows = [('{"provider":"mistral"}', "/v1/chat/completions", "x", "mistral"), ("{}", "/v1/chat/completions", "x", "openai"),
            ("{}", "/v1/messages", "x", "anthropic"), ("no json", "/v1beta/models/g:do", "x", "gemini"),
            ('{"provider":"nope"}', "/x", "api.mistral.ai:443", "mistral"), ("{}", "/x", "y", None)]
    df = spark.createDataFrame([r[:3] for r in rows], "b string, p string, h string")
    got = [r.x for r in df.select(payloads.route_provider(F.col("b"), F.col("p"), F.col("h")).alias("x")).collect()]
    assert got == [r[3] for r in rows]


def test_envelope(spark):
    rows = [('{"a": 1}', '{"b": 2, "proxy_metadata": 0}'), ("plain", "plain"), ("no json", '{"b": 1}'), (None, None)]
    df = spark.createDataFrame(rows, "response string, restored_body string")
    out = payloads.add_envelope(df, F.timestamp_millis(F.lit(1500)), "it's me").collect()
    meta = {"intercepted": True, "timestamp": 1500, "service": "it's me"}
    assert json.loads(out[0].restored_body) == {"b": 2, "original_response": {"a": 1}, "proxy_metadata": meta}
    assert out[1].restored_body == "plain" and out[3].restored_body is None
    assert json.loads(out[2].restored_body) == {"b": 1, "original_response": "no json", "proxy_metadata": meta}


def test_host_of_the_users_provider(spark):
    rows = [("Corp.org:8080", "custom"), ("corp.org", "custom"), ("x.corp.org", None), ("API.openai.com", "openai"), (None, None)]
    df = spark.createDataFrame(rows, "h string, w string")
    got = df.select("w", payloads.route_provider(F.lit("{}"), F.lit("/x"), F.col("h"), custom="https://corp.org:1/v1").alias("g")).collect()
    assert all(r.g == r.w for r in got)


def parsed(spark, message, direction):
    df = spark.createDataFrame([(message if isinstance(message, str) else json.dumps(message), direction)], "m string, d string")
    row = df.select(audit_log.parse_messages(F.col("m"), F.col("d")).alias("x"), audit_log.extract_model(F.col("m")).alias("y")).first()
    return [(m.role, m.content) for m in row.x], row.y


# Payload shapes as the providers define them, and what is read from them.
def test_parse_messages(spark):
    assert parsed(spark, {"model": "mm", "choices": [{"message": {"content": [{"text": "Hello "}, {"text": "world"}]}}]}, "response_masked") == ([("assistant", "Hello world")], "mm")
    assert parsed(spark, {"messages": [{"content": "a"}, {"role": "system", "content": {"parts": [{"text": "b"}, "c"]}}, 5]}, "In") == ([("user", "a"), ("system", "bc")], None)
    assert parsed(spark, {"contents": [{"role": "model", "parts": [{"text": "x"}]}]}, "request_masked") == ([("model", "x")], None)
    assert parsed(spark, {"modelVersion": "g", "candidates": [{"content": {"parts": [{"text": "x"}]}}, {"content": {}}]}, "Out") == ([("assistant", "x")], "g")
    assert parsed(spark, {"role": "r", "content": [{"type": "text", "text": "p"}, {"type": "z", "text": "q"}], "original_response": {"model": "o"}}, "response") == ([("r", "p")], "o")
    assert parsed(spark, {"choices": [{"text": "old"}]}, "response") == ([("assistant", "old")], None)
    assert parsed(spark, {"messages": [{"content": "a"}]}, "sideways")[0] == []
    assert parsed(spark, "not json", "request") == ([], None)


def test_log_limits_and_pages(spark):
    df = spark.createDataFrame([("x" * 60000,), ("y",)], "m string").select(audit_log.truncated(F.col("m")).alias("m"))
    a, b = [r.m for r in df.collect()]
    assert a == "x" * 51200 + "... [truncated]" and b == "y"
    log = spark.range(1200).select(F.timestamp_seconds(F.col("id") % 10).alias("timestamp"), F.col("id").cast("string").alias("id"))
    assert audit_log.page_logs(log, 9999).count() == 500 and audit_log.page_logs(log, -1).count() == 100
    pages = [r.id for k in range(3) for r in audit_log.page_logs(log, 400, 400 * k).collect()]
    assert len(set(pages)) == 1200


def test_long_messages_are_parsed_before_they_are_cut(spark):
    body = json.dumps({"model": "m", "messages": [{"role": "user", "content": "w " * 40_000}]})
    df = spark.createDataFrame([(body, "request"), ("{}", "request")], "message string, direction string")
    long, short = audit_log.to_log(df).orderBy(F.desc("truncated")).collect()
    assert long.truncated and len(long.message) < 52_000 and long.model == "m"
    assert len(long.messages[0].content) == 80_000 and not short.truncated


def test_transaction_order(spark):
    rows = [("1", "t1", 0, "request_original"), ("2", "t1", 9, "response_original"), ("3", "t1", 1, "request_masked"),
            ("4", None, 5, "request_original"), ("5", "t2", 20, "odd")]
    log = spark.createDataFrame([(a, b, datetime(2024, 1, 1) + timedelta(seconds=c), d) for a, b, c, d in rows], "id string, transaction_id string, timestamp timestamp, direction string")
    assert [r.id for r in audit_log.order_transactions(log).collect()] == ["5", "1", "3", "2", "4"]


def test_display_forms(spark):
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.lit("z" * 101).alias("content")), F.struct(F.lit("a").alias("role"), F.lit("b").alias("content")))
    row = spark.range(1).select(
        audit_log.format_messages(msgs).alias("line"),
        audit_log.direction_label(F.lit("request_masked"), F.lit("claude-3")).alias("label"),
        audit_log.format_entities(F.array().cast(audit_log.DETECTED)).alias("none"),
        audit_log.display_text(F.array().cast(audit_log.MESSAGES), F.lit("")).alias("empty"),
    ).first()
    assert row.line == "[user] " + "z" * 97 + "... | [a] b"
    assert row.label == "Request (To Anthropic)" and row.none == "None" and row.empty == "No message content"


def test_foreign_import(spark):
    rows = [("Bob in Rome, Bob", [("Bob", "GIVENNAME1", 0, 3), ("Rome", "CITY", None, None), ("x", "CITY", None, None), ("Rome", "CITY", 0, 4), ("Bob", "SEX", 0, 3)], None), ("nothing", [("no", "TITLE", 0, 2)], "German"), ("", [("a", "CITY", 0, 1)], "x")]
    df = spark.createDataFrame(rows, "source_text string, privacy_mask array<struct<value:string,label:string,start:int,end:int>>, language string")
    out = normalize.import_foreign(df).collect()
    assert len(out) == 1 and out[0].language == "English"
    assert [(e.label, e.start, e.end) for e in out[0].privacy_mask] == [("FIRSTNAME", 0, 3), ("CITY", 7, 11)]


def test_read_samples_one_per_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"text": "hi Ann", "privacy_mask": [{"value": "Ann", "label": "FIRSTNAME"}], "coreferences": [{"cluster_id": 1, "entity_type": "person", "mentions": ["Ann", {"text": "she"}]}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"data": {"text": "t"}, "predictions": [{"result": [{"type": "labels", "value": {"start": 0, "end": 1, "text": "t", "labels": ["CITY", "ODD"]}}, {"type": "relation", "to_id": "e"}]}]}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{"other": 1}')
    rows = readers.read_samples(spark, str(tmp_path))
    assert {r.file_name: r.format for r in rows.collect()} == {"a.json": "simplified", "b.json": "task", "c.json": "bad_json", "d.json": "unknown"}
    recs = {r.file_name: r for r in readers.sample_records(rows).collect()}
    assert recs["a.json"].labels == ["FIRSTNAME"] and recs["a.json"].language == "unknown" and recs["a.json"].has_coreferences
    assert recs["b.json"].all_labels == ["CITY", "ODD"] and recs["b.json"].coref_cluster_count == 1


def test_batch_lines(spark):
    good = {"custom_id": "q", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "```json\n[{\"text\": \"a\"}, {\"text\": \"b\"}]\n```"}}], "metadata": {"language": "German"}}}}
    other = {"customID": "r", "body": {"choices": [{"message": {"content": "{\"text\": \"c\"}"}}]}}
    lines = [json.dumps(good), json.dumps(other), "nope", " ", json.dumps({"response": {"status_code": 429}}), json.dumps({"response": {"body": {"choices": []}}}), json.dumps({"body": {"choices": [{"message": {"content": "7"}}]}})]
    p = batches.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r.status for r in p.collect()) == ["bad_content", "bad_json", "bad_status", "no_choices", "ok", "ok"]
    assert sorted(r.file_name for r in batches.explode_samples(p, "f").collect()) == ["f-q_0.json", "f-q_1.json", "f-r.json"]
    assert {r.custom_id: r.language for r in batches.parse_ner_results(p).collect()} == {"q": "German", "r": "English"}
    assert readers.quarantine(p).count() == 4
    assert spark.range(1).select(batches.fix_unicode_escapes(F.lit("a\\u0000e9b")).alias("x")).first().x == "a\\u00e9b"


def test_ledger_round_trip(spark, tmp_path):
    rows = [("b.json", "DIRTY", 2, 'say "hi"\tthere'), ("a.json", "CLEAN", 0, "")]
    writers.write_ledger(spark.createDataFrame(rows, readers.LEDGER), str(tmp_path / "l"))
    back = {r.file_name: (r.status, r.issue_count, r.issues) for r in readers.read_ledger(spark, str(tmp_path / "l")).collect()}
    assert back["b.json"] == ("DIRTY", 2, 'say "hi" there') and back["a.json"][:2] == ("CLEAN", 0)


def test_shared_folder_comes_from_the_session(spark):
    assert scratch.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def put(spark, folder, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_join_restores_and_finds_unanswered(spark, tmp_path):
    t = datetime(2024, 1, 1)
    r_ddl, a_ddl = "transaction_id string, ts timestamp, masked_to_original map<string,string>", "transaction_id string, ts timestamp, answer string"
    put(spark, tmp_path / "r", [("1", t, {"D": "Ann"}), ("2", t, {"D": "Bob"}), ("3", t, {})], r_ddl)
    put(spark, tmp_path / "a", [("1", t + timedelta(seconds=9), "hi D"), ("2", t + timedelta(seconds=90), "late D")], a_ddl)
    late = t + timedelta(hours=1)
    put(spark, tmp_path / "r2", [("9", late, {})], r_ddl)
    put(spark, tmp_path / "a2", [("9", late, "x")], a_ddl)

    def stream(name, ddl):
        return spark.readStream.schema(ddl).parquet(str(tmp_path / name))

    out = streams.restore_stream(stream("r", r_ddl), stream("a", a_ddl))
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        for name in ("r", "a"):
            ddl = r_ddl if name == "r" else a_ddl
            spark.read.schema(ddl).parquet(str(tmp_path / f"{name}2")).write.mode("append").parquet(str(tmp_path / name))
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.transaction_id: r.restored for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got["1"] == "hi Ann" and got["2"] is None and got["3"] is None
    batch = streams.unanswered_requests(spark.read.parquet(str(tmp_path / "r")), spark.read.parquet(str(tmp_path / "a")))
    assert sorted(r.transaction_id for r in batch.collect()) == ["2", "3"]


def test_vault_stream_equals_batch(spark, tmp_path):
    from pii_spark.operators import vault

    ddl = "hit_id long, original_pii string, dummy_pii string, pii_type string, confidence double, ts timestamp"
    t = datetime(2024, 1, 1)
    rows = [(i, f"o{i % 5}", f"d{i % 5}", "X", 0.5, t + timedelta(seconds=i)) for i in range(40)]
    put(spark, tmp_path / "h", rows[:20], ddl)
    put(spark, tmp_path / "h", rows[20:] + rows[20:22], ddl)
    hits = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "h"))
    path = str(tmp_path / "v")
    streams.vault_stream(spark, hits, path, str(tmp_path / "c"), lateness="1 hour", availableNow=True).awaitTermination()
    got = {r.original_pii: r for r in vault_store.read_store(spark, path).collect()}
    want = {r.original_pii: r for r in vault.vault_build(spark.createDataFrame(rows, ddl)).collect()}
    assert {k: v.asDict() for k, v in got.items()} == {k: v.asDict() for k, v in want.items()}


def test_vault_stream_expires_and_repeats_safely(spark, tmp_path):
    ddl = "hit_id long, original_pii string, dummy_pii string, pii_type string, confidence double, ts timestamp"
    t = datetime(2024, 1, 1)
    put(spark, tmp_path / "h", [(1, "old", "a", "X", 1.0, t), (2, "mid", "b", "X", 1.0, t + timedelta(minutes=50))], ddl)
    source = spark.readStream.schema(ddl).parquet(str(tmp_path / "h"))

    def run():
        streams.vault_stream(spark, source, str(tmp_path / "v"), str(tmp_path / "c"), max_age="1 hour", availableNow=True).awaitTermination()
        return sorted((r.original_pii, r.access_count) for r in vault_store.read_store(spark, str(tmp_path / "v")).collect())

    assert run() == [("mid", 1), ("old", 1)]
    put(spark, tmp_path / "h", [(3, "mid", "c", "X", 0.5, t + timedelta(minutes=70))], ddl)
    assert run() == [("mid", 2)]
    assert run() == [("mid", 2)]


def test_one_conversation_holds_a_third_of_the_turns(spark):
    """Masking is row-local, so a hot conversation is spread like any other rows."""
    from pii_spark.operators import mask

    turns = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
        F.lit("user").alias("role"), F.concat(F.lit("I am u"), F.col("id") % 50, F.lit("@x.org")).alias("text"))
    masked = mask.mask_conversations(turns)
    assert masked.count() == 3000 and "Exchange" not in masked._jdf.queryExecution().executedPlan().toString()
    pairs = mask.conversation_vault(masked).where("conv_id = 0").collect()
    assert len(pairs) == 50 and len({p.original for p in pairs}) == 50


def test_mask_stream_is_the_batch_operator(spark, tmp_path):
    put(spark, tmp_path / "d", [(1, MAIL), (2, "none"), (3, None)], "doc_id long, text string")
    s = streams.mask_stream(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "d")))
    s.select("doc_id", "masked_text").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = streams.mask_stream(spark.read.parquet(str(tmp_path / "d"))).select("doc_id", "masked_text")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("lateness,closed", [("0 seconds", 2), ("20 minutes", 0)])
def test_windows_close_with_the_watermark(spark, tmp_path, lateness, closed):
    t = datetime(2024, 1, 1)
    put(spark, tmp_path / "e", [("A", t + timedelta(minutes=m)) for m in (1, 2, 11, 21)], "label string, ts timestamp")
    w = streams.pii_rate_windows(spark.readStream.schema("label string, ts timestamp").parquet(str(tmp_path / "e")), lateness=lateness)
    w.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema(w.schema).parquet(str(tmp_path / "o")).count() == closed
