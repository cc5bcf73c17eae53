import random
from collections import deque

import pytest

from quillgraph.functions.blake3 import blake3_hex
from quillgraph.model import CONFIDENCES, Graph, validate_enums
from quillgraph.operators import queries as Q
from quillgraph.operators import traverse as T
from quillgraph.streaming import watch


def graph(spark, edges, names=None):
    ids = sorted({x for e in edges for x in e[:2]})
    files = spark.createDataFrame([("f", "src/a.ts", "typescript")], "id string, relative_path string, language string")
    symbols = spark.createDataFrame([(i, "f", (names or {}).get(i, i), f"src/a.ts::{i}", "function", "typescript", 0, 1, 1, 1, "default") for i in ids], "id string, file_id string, name string, qualified_name string, kind string, language string, start_byte long, end_byte long, start_line long, end_line long, visibility string")
    rels = spark.createDataFrame([(str(k), a, b, None, kind, "resolved", conf, "f", k, 0, None) for k, (a, b, kind, conf) in enumerate(edges)], "id string, source_symbol_id string, target_symbol_id string, target_external string, kind string, provenance string, confidence string, source_file_id string, start_line int, start_column int, reason string")
    unres = spark.createDataFrame([], "source_symbol_id string, source_file_id string, relationship_kind string, target_text string, reason string, confidence string, candidate_count int")
    state = spark.createDataFrame([("p", 2, None)], "project_id string, pending_files long, last_verified_at string")
    return Graph(files, symbols, rels, unres, state)


def reference_bfs(edges, start, target, caps, floor=0):
    adj = {}
    for k, (a, b, kind, conf) in enumerate(edges):
        adj.setdefault(a, []).append((kind, b, str(k), conf))
    for v in adj.values():
        v.sort()
    reached, order, examined, capped = {start: 0}, [start], 0, False
    if target == start:
        return reached, True, None
    todo = deque([start])
    while todo:
        x = todo.popleft()
        if reached[x] >= caps.depth:
            capped |= bool(adj.get(x))
            continue
        for kind, y, _, conf in adj.get(x, ()):
            if CONFIDENCES.index(conf) < floor:
                continue
            examined += 1
            if examined > caps.edges:
                return reached, False, "max_edges"
            if y in reached:
                continue
            if len(reached) >= caps.nodes:
                return reached, False, "max_nodes"
            reached[y] = reached[x] + 1
            order.append(y)
            if y == target:
                return reached, True, None
            todo.append(y)
    return reached, False, "max_depth" if capped else None


@pytest.mark.parametrize("seed", range(6))
def test_bfs_caps_match_a_queue(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(9)}", f"n{r.randrange(9)}", r.choice(["calls", "reads"]), r.choice(CONFIDENCES)) for _ in range(22)]
    g = graph(spark, edges)
    caps = T.Caps(depth=r.choice([1, 2, 10]), nodes=r.choice([3, 5, 100]), edges=r.choice([4, 9, 100]), seconds=600)
    target = r.choice([None, "n5", "n0"])
    got = T.bfs(T.adjacency(g), "n0", target, caps, min_confidence="low")
    want = reference_bfs(edges, "n0", target, caps, 1)
    assert ({x["symbol_id"]: x["depth"] for x in got.reached.collect()}, got.found, got.truncated) == want


def test_trace_and_directions(spark):
    g = graph(spark, [("a", "m", "calls", "exact"), ("m", "b", "calls", "exact")])
    assert [x["symbol_id"] for x in T.trace(g, "a", "b", T.Caps(seconds=600)).collect()] == ["a", "m", "b"]
    assert T.trace(g, "b", "a", T.Caps(seconds=600)).count() == 0
    assert {x["symbol_id"] for x in T.impact(g, "b", T.Caps(seconds=600)).reached.collect()} == {"a", "b", "m"}
    nodes, edges = T.neighbourhood(g, "m", 2, T.Caps(depth=2, seconds=600))
    assert {(e["source"], e["target"]) for e in edges.collect()} == {("a", "m"), ("m", "b")} and nodes.count() == 3


def test_subjects(spark):
    g = graph(spark, [("a", "b", "calls", "exact"), ("c", "b", "calls", "low")], {"a": "twice", "c": "twice"})
    assert Q.resolve_subject(g, "b") == "b" and Q.resolve_subject(g, symbol_id="zz") == "zz" and Q.resolve_subject(g, "src/a.ts::c") == "c"
    with pytest.raises(Q.Ambiguous) as e:
        Q.resolve_subject(g, "twice")
    assert e.value.code == 6 and len(e.value.candidates) == 2
    with pytest.raises(Q.NotFound):
        Q.resolve_subject(g, "nope")
    assert Q.callers(g, "b", min_confidence="high").count() == 1 and Q.callers(g, "b", min_confidence="unresolved").count() == 2
    assert Q.project_status(g).first()["stale"] and "2 file(s)" in Q.project_status(g).first()["warning"]
    assert validate_enums(g.relationships, confidence=CONFIDENCES).count() == 0
    assert Q.clamp_limit(None) == 50 and Q.clamp_limit(9999) == 500 and Q.doctor(spark, g).where("ok").count() == 7


def test_blake3_golden():
    key = "\x1f".join(["typescript", "src/member.ts", "class", "src/member.ts::MemberService", ""])
    assert blake3_hex(key.encode()) == "8be6b5b411dfdc32b2948f30e91dab5251ad60480b1cd3cddf250f5c1d4470af"
    assert blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"


def test_debounce():
    assert watch.sessions([0, 500, 1000, 3000], 750, 5000) == [(0, 3, 1750), (3000, 1, 3750)]
    assert [n for _, n, _ in watch.sessions(list(range(0, 12000, 500)), 750, 5000)] == [10, 10, 4]


def test_debounced_stream(spark, tmp_path):
    import json
    import time

    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"root": "r", "path": p}) for p in ("b", "a", "b")))
    events = spark.readStream.schema("root string, path string").json(str(folder))
    q = watch.debounced_stream(events, 200, 2000).writeStream.outputMode("append").format("memory").queryName("batches").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("batches").count():
                break
        assert [r["paths"] for r in spark.table("batches").collect()] == [["a", "b"]]
    finally:
        q.stop()
