import json

import pytest

from tracewell.plans import config
from tracewell.sources import audit_logs as logs
from tracewell.streaming import events as streams

M = "com.bbn.tc.schema.avro.cdm18."


def record(kind, **body):
    return json.dumps({"datum": {M + kind: body}}, separators=(",", ":"))


def test_third_generation_logs(spark, tmp_path):
    lines = [
        record("NetFlowObject", uuid="n1", localAddress="1.1.1.1", localPort=80, remoteAddress="2.2.2.2", remotePort=443),
        record("NetFlowObject", uuid="n2", localAddress={"string": "3.3.3.3"}, localPort={"int": 5}, remoteAddress=None),
        record("Subject", uuid="s1", cmdLine={"string": "run me"}, properties={"map": {"path": "/bin/x"}}), record("Subject", uuid="s2", cmdLine="plain", properties={"map": {}}), record("Subject", uuid="s2", cmdLine="again"),
        record("FileObject", uuid="f1", baseObject={"path": "/p", "properties": {"map": {"filename": "/q"}}}), record("FileObject", uuid="f2", baseObject={"filename": "/base"}),
        f'{{"datum":{{"{M}Event":{{"uuid":"e1","type":"EVENT_READ","subject":{{"{M}UUID":"s1"}},"predicateObject":{{"{M}UUID":"f1"}},"timestampNanos":123,"x":1}}}}}}',
        f'{{"datum":{{"{M}Event":{{"uuid":"e2","type":"EVENT_WRITE","subject":{{"{M}UUID":"s1"}},"predicateObject":{{"{M}UUID":"n2"}},"timestampNanos":124,"x":1}}}}}}',
        f'{{"datum":{{"{M}Event":{{"uuid":"e3","type":"EVENT_FCNTL","subject":{{"{M}UUID":"s1"}},"predicateObject":{{"{M}UUID":"n2"}},"timestampNanos":125,"x":1}}}}}}',
        f'{{"datum":{{"{M}Event":{{"uuid":"e4","type":"EVENT_WRITE","subject":{{"{M}UUID":"s1"}},"predicateObject":{{"{M}UUID":"gone"}},"timestampNanos":126,"x":1}}}}}}', "not json",
    ]
    path = tmp_path / "log.json"
    path.write_text("\n".join(lines))
    rows = logs.lines(spark, str(path))
    nodes = logs.cdm_nodes(rows, 18)
    got = {r.node_uuid: r for r in nodes.collect()}
    assert [got[u].node_id for u in ("n1", "n2", "s1", "s2", "f1", "f2")] == list(range(6))
    assert (got["n2"].src_addr, got["n2"].src_port, got["n2"].dst_addr, got["n2"].dst_port) == ("3.3.3.3", "5", "null", "null") and got["n1"].src_port == "80"
    assert (got["s1"].cmd, got["s1"].path, got["s2"].cmd, got["s2"].path) == ("run me", "/bin/x", "again", "null")
    assert got["f1"].path == "/q" and got["f2"].path == "/base"
    found = sorted((r.event_uuid, r.src, r.dst, r.op, r.t) for r in logs.cdm_events(rows, nodes, 18).collect())
    assert found == [("e1", 4, 2, "EVENT_READ", 123), ("e2", 2, 1, "EVENT_WRITE", 124)]


def test_fifth_generation_logs(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text("\n".join([
        '{"datum":{"com.bbn.tc.schema.avro.cdm20.NetFlowObject":{"uuid":"n","baseObject":{},"localAddress":{"string":"1.1.1.1"},"localPort":{"int":1},"remoteAddress":{"string":"2.2.2.2"},"remotePort":{"int":2}}}}',
        '{"datum":{"com.bbn.tc.schema.avro.cdm20.Subject":{"uuid":"s","x":1,"cmdLine":{"string":"c d"},"properties":{"map":{"path":"/b"}}}}}',
        '{"datum":{"com.bbn.tc.schema.avro.cdm20.FileObject":{"uuid":"f","baseObject":{"properties":{"map":{"filename":"/etc"}}}}}}',
    ]))
    got = {r.node_uuid: r for r in logs.cdm_nodes(logs.lines(spark, str(path)), 20).collect()}
    assert (got["n"].node_id, got["s"].node_id, got["f"].node_id) == (0, 1, 2)
    assert (got["n"].dst_port, got["s"].cmd, got["s"].path, got["f"].path) == ("2", "c d", "/b", "/etc")


def test_host_logs(spark, tmp_path):
    def line(i, action, obj, actor, target, host="h1.dom", **props):
        return json.dumps({"hostname": host, "action": action, "object": obj, "actorID": actor, "objectID": target, "id": f"e{i}", "timestamp": f"2019-09-25T10:00:0{i}.5-04:00", "properties": props})

    path = tmp_path / "log.json"
    path.write_text("\n".join([
        line(1, "READ", "FILE", "p1", "f1", image_path="C:\\a", file_path="\\x"), line(2, "MESSAGE", "FLOW", "p1", "n1", src_ip="1", dest_ip="2", src_port="3", dest_port="4", direction="inbound"),
        line(3, "CREATE", "PROCESS", "p1", "p2", command_line="cmd", parent_image_path="pp"), line(4, "WRITE", "FILE", "p2", "f1", host="other.dom"), line(5, "LOGIN", "FILE", "p1", "f9"),
    ]))
    records = logs.host_records(logs.lines(spark, str(path)), "h1")
    nodes = logs.host_nodes(records)
    got = {r.node_uuid: (r.node_id, r.node_type, r.path) for r in nodes.collect()}
    assert got == {"p1": (0, "subject", None), "p2": (1, "subject", "pp"), "f1": (2, "file", "/x"), "n1": (3, "netflow", None)}
    found = sorted((r.event_uuid, r.src, r.dst, r.op) for r in logs.host_events(records, nodes).collect())
    assert found == [("e1", 2, 0, "READ"), ("e2", 3, 0, "MESSAGE"), ("e3", 0, 1, "CREATE")]


def test_small_sources(spark, tmp_path):
    gt = tmp_path / "gt.csv"
    gt.write_text('u1,"{\'file\': ""a,b""}", 7\nu2,x,8\n')
    assert [(r.node_uuid, r.index_id) for r in logs.ground_truth(spark, str(gt)).orderBy("index_id").collect()] == [("u1", 7), ("u2", 8)]
    flows = tmp_path / "x.data"
    flows.write_text("a b  c\nq\nd e f\n")
    good, bad = logs.flow_pairs(spark.read.text(str(flows)), 1, 3)
    assert sorted(map(tuple, good.collect())) == [("a", "c"), ("d", "f")] and bad.first().malformed == 1
    timing = tmp_path / "t.json"
    timing.write_text(json.dumps({"results": [{"batch_id": 1}, {"batch_id": 2}]}))
    assert logs.batch_timings(spark, str(timing)).count() == 2


def test_config():
    files = {"base": {"training": {"lr": 1, "x": {"a": 1}}, "evaluation": {"used_method": "node_evaluation"}}, "child": {"_include": "base", "training": {"x": {"b": 2}}}}
    c = config.resolve("child", files.__getitem__)
    assert c["training"] == {"lr": 1, "x": {"a": 1, "b": 2}}
    with pytest.raises(ValueError):
        config.resolve("loop", {"loop": {"_include": "loop"}}.__getitem__)
    assert config.layered({"a": {"b": 1}}, {"a": {"b": 2}}) == {"a": {"b": 2}}
    for bad in ({"nope": {}}, {"evaluation": {"used_method": "x"}}, {"transformation": {"used_method": "undirected, dag"}}, {"transformation": {"used_method": "none,dag"}}, {"training": {"decoder": "none", "objective": "predict_edge_type"}}):
        with pytest.raises(ValueError):
            config.validate(bad)
    assert config.validate(c) is c
    a, b = config.stage_keys(c), config.stage_keys(config.merge(c, {"training": {"lr": 2}}))
    assert a["batching"] == b["batching"] and a["training"] != b["training"] and a["triage"] != b["triage"]
    assert config.stage_keys(config.merge(c, {"_secret": 1})) == a
    assert config.to_run(c, lambda s, k: True) == [] and config.to_run(c, lambda s, k: s != "batching")[0] == "batching"
    assert config.offsets([3, 5]) == [0, 4]


def drained(spark, frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    rows = [(i, f"n{i % 2}", "m", 1_704_067_200_000_000_000 + i * 60_000_000_000, float(i)) for i in range(30)]
    batch = spark.createDataFrame([(i, i % 2, 9, t, x) for i, _, _, t, x in rows], "event_uuid long, src long, dst long, t long, loss double")
    for k in range(3):
        batch.where(f"event_uuid div 10 = {k}").unionByName(batch.where("event_uuid = 0").limit(0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.timed(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    got = drained(spark, streams.window_losses(stream, "5 minutes"), "w5", "complete").orderBy("start").collect()
    assert [r.n for r in got] == [5] * 6 and got[0].score == 4.0
    ring = drained(spark, streams.last_neighbours(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), 3), "ring", "update")
    assert list(ring.where("node = 0").first().neighbours) == [9, 9, 9]
    by = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")).selectExpr("src as by", "t", "event_uuid")
    closed = drained(spark, streams.quantised(by, 2, 240_000_000_000), "cut")
    assert closed.where("n < 1").count() == 0
