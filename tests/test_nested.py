import json

from lemmaflow.operators import nested

NODES = "node_id string, policy_diagnostics string, owner_key string, doc string"
JOBS = "job_id string, logs array<struct<line_index:int,stream_name:string,message:string>>, line_index int"
DECLS = "declaration_id string, domain_classification struct<warnings:array<struct<code:string,message:string,details:map<string,string>>>>, warnings string"


def test_spellings_wrappings_and_shapes(spark, rows):
    v = lambda *c: [None if x is None else {"code": x, "message": "m"} for x in c]
    plain = {"preSummary": {"violations": v("a", None, "b")}, "rewriteTrace": [{"postSummary": {"violations": v("c")}}, None, {"post_summary": {"violations": v("d")[0]}}]}
    texts = {
        "plain": json.dumps(plain),
        " snake ": json.dumps({"pre_summary": {"violations": v("a")}, "post-summary": {"VIOLATIONS": v("b")}}),
        "wrapped": json.dumps({"policyDiagnostics": plain}, indent=2),
        "encoded": json.dumps(json.dumps({"policy_diagnostics": json.dumps(plain)})),
        "cut": json.dumps(plain)[:-5],
        "tail": json.dumps(plain) + " x",
        "blank": "  ",
        "list": "[1, 2]",
        "number": "3",
    }
    data = [(k, t, "x", "y") for k, t in texts.items()] + [("plain", texts["plain"], None, None), (None, texts["plain"], None, None), ("null", None, None, None)]
    got = rows(nested.flatten_diagnostics(spark.createDataFrame(data, NODES))["violations"].select("owner_key", "child_path", "ordinals", "code"))
    full = [("preSummary.violations", "0", "a"), ("preSummary.violations", "2", "b"), ("rewriteTrace.postSummary.violations", "0.0", "c"), ("rewriteTrace.postSummary.violations", "2.0", "d")]
    expected = [(k, *f) for k in ("plain", "wrapped", "encoded") for f in full] + [("snake", "preSummary.violations", "0", "a"), ("snake", "postSummary.violations", "0", "b")]
    assert got == sorted(expected, key=repr)
    rewrites = rows(nested.flatten_diagnostics(spark.createDataFrame(data, NODES))["rewrites"].select("owner_key", "ordinals"))
    assert rewrites == sorted([(k, o) for k in ("plain", "wrapped", "encoded") for o in ("0", "2")], key=repr)


def test_places_of_lines_and_warnings(spark, rows):
    jobs = spark.createDataFrame([("j1 ", [(3, "stdout", "x"), None, (1, None, None)], 9), ("j1", [(3, "stdout", "x"), None, (1, None, None)], 9), ("j2", None, 9), ("j3", [], 9), (None, [(1, "a", "b")], 9)], JOBS)
    decls = spark.createDataFrame([("d", ([("c", None, {"k": "v"}), None, ("e", "m", None)],), "w"), ("n", None, "w")], DECLS)
    nodes = spark.createDataFrame([], NODES)
    got = rows(nested.found(nodes, jobs, decls))
    assert got == [("lean_declarations", "d", "warnings", "0"), ("lean_declarations", "d", "warnings", "2"), ("verification_jobs", "j1", "logs", "0"), ("verification_jobs", "j1", "logs", "2")]


def test_any_number_of_layers_is_taken_off(spark):
    text = json.dumps({"preSummary": {"violations": {"code": "a", "message": "back\\slash \"quoted\""}}})
    for k in range(7):
        text = json.dumps(json.dumps({"policyDiagnostics": json.loads(text)} if k % 2 else json.loads(text)))
    data = [("deep", text, None, None)]
    got = nested.flatten_diagnostics(spark.createDataFrame(data, NODES))["violations"].collect()
    assert [(r.owner_key, r.ordinals, r.code, r.message) for r in got] == [("deep", "0", "a", 'back\\slash "quoted"')]
