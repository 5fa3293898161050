"""Formatter, shebang, grammar and type text."""

import json

import pytest

from sylvan import api
from sylvan.lang.analysis import compile_query
from sylvan.lang.ast import QueryError
from sylvan.lang.format import format_query, shebang
from sylvan.lang.grammar import check_grammar, observe
from sylvan.limits import fuel_for, memory_for
from sylvan.plans.emit import ddl, typescript
from sylvan.sources.nodes import depths, dump_json
from sylvan.sources.text_trees import parse_trees

TEXTS = [
    "Q=(r . (a)*?@xs .!(b == 'x\\n')@y :: text -f)",
    "; note\nItem = (pair key:(_)@k value:[(number)@n (string) @s])\nQ = (r {(Item)+ @items . _ \",\"}* @_ (MISSING \";\") (MISSING) (ERROR) (_ .))",
    "Q = (some_long_kind_name (another_long_kind_name) @first_capture (yet_another_long_kind_name =~ /a b/) @second_capture)",
    "Q = (r [A: (a) @x B: {(b) . (c)}] @v)",
]


@pytest.mark.parametrize("text", TEXTS)
def test_format_is_stable_and_keeps_types(text):
    once = format_query(text)
    assert format_query(once) == once
    assert compile_query(once).types == compile_query(text).types
    assert all(len(line) <= 80 for line in once.split("\n"))
    assert once.startswith("; note") == text.startswith("; note")


def test_format_needs_a_clean_query():
    with pytest.raises(QueryError):
        format_query("Q = (a")


def test_shebang():
    assert shebang("#!/usr/bin/env -S tool run -l json --entry Main\nMain = (a)") == {"lang": "json", "entry": "Main"}
    assert shebang("Q = (a)") == {}


def test_grammar(spark):
    docs = spark.createDataFrame([(1, '{"a": 1, "b": [true, "x"]}'), (2, "[null]")], "doc_id long, source string")
    g = observe(parse_trees(docs, "json"), "json")
    assert g.roots == {"document"} and g.fields["pair"] == {"key": True, "value": True} and "{" in g.tokens
    assert ("pair", True) in g.kids["object"] and '(pair key: _ value: _ ":"' in g.render()

    def kinds(text):
        return [d.kind for d in check_grammar(compile_query(text), g)]

    assert kinds("Q = (document (object (pair key: (string) @k)))") == []
    assert kinds("Q = (document (objct))") == ["UnknownNodeKind"]
    assert "did you mean `object`" in check_grammar(compile_query("Q = (document (objct))"), g)[0].message
    assert kinds("Q = (document (object (pair kee: (string))))") == ["UnknownGrammarField"]
    assert sorted(kinds("Q = (document (object key: (string)))")) == ["GrammarFieldNotOnNodeKind", "InvalidChildType"]
    assert kinds("Q = (document (pair))") == ["InvalidChildType"]
    assert kinds("Q = (document (array (null (string))))") == ["ChildUnderLeafToken"]
    assert kinds("Q = (document (object (pair -key)))") == ["NegatedRequiredField"]
    assert kinds("Q = (document (MISSING object))") == ["MissingKindNotToken"]
    assert kinds('Q = (document (object == "x"))') == ["PredicateOnNonLeaf"]
    assert kinds("Q = (object)") == ["EntryPointNeverMatchesRoot"]


def test_type_text():
    q = compile_query("Q = (r (a)+ @xs [A: (b) @b B: (c)]? @v (z)? @z :: bool)")
    assert ddl(q).startswith("struct<xs:array<struct<kind:string,text:string,span:array<int>>>")
    assert 'xs: [Node, ...Node[]]; v: { $tag: "A"; $data: { b: Node } } | { $tag: "B" } | null; z: boolean' in typescript(q)
    assert ddl(compile_query("N = (n [(a) @leaf (N) @in])")) == "variant"
    assert ddl(compile_query("Q = (program)")) is None


def test_limits_stats_and_errors(spark):
    docs = spark.createDataFrame([(1, "[[1], [2], [3]]"), (2, "[]")], "doc_id long, source string")
    nodes = parse_trees(docs, "json")
    q = "Q = (document (array (array (number) @n)* @xs))"
    got = {r["doc_id"]: r for r in api.run(nodes, q, stats=True, provenance=True).collect()}
    assert got[1]["status"] == "match" and got[1]["run_stats"]["fuel_used"] > 4 and got[1]["run_stats"]["peak_bytes"] > 0
    places = {p["path"]: (p["query_span"], p["source_span"]) for p in got[1]["result_provenance"]}
    assert places["/xs/1/n"] == ([q.index("(number)"), q.index("@n") + 2], [7, 8]) and places["/xs"][0] == [q.index("(array (n"), q.index("@xs") + 3]
    assert {r["status"] for r in api.run(nodes, q, fuel=1).collect()} == {"out of fuel"}
    assert {r["doc_id"]: r["status"] for r in api.run(nodes, q, memory="1KiB").collect()} == {1: "out of memory", 2: "match"}
    assert {r["status"] for r in api.run(nodes, q, fuel="unbounded", memory="unbounded").collect()} == {"match"}
    shown = {r["doc_id"]: json.loads(r["json"]) for r in api.envelope(api.run(nodes, "Q = (document (array (array) @a))", stats=True, provenance=True)).collect()}
    assert shown[1]["result"]["a"]["text"] == "[1]" and shown[1]["result_provenance"][0]["source_span"] == [1, 4]
    assert shown[2]["error"] == "no match" and shown[2]["result"] is None and shown[2]["run_stats"]["fuel_used"] > 0


@pytest.mark.parametrize(("text", "fuel", "memory"), [(None, 1_000_000 + 1024 * 10, (64 << 20) + 2560), ("auto", 1_010_240, (64 << 20) + 2560), ("7", 7, 7), (9, 9, 9)])
def test_limit_values(text, fuel, memory):
    assert (fuel_for(text, 10), memory_for(text, 10)) == (fuel, memory)


def test_limit_sizes_and_faults():
    assert memory_for("2MiB", 1) == 2 << 20 and memory_for(" 1 gib", 1) == 1 << 30 and fuel_for("unbounded", 1) > 1 << 60
    for bad in (lambda: fuel_for("2MiB", 1), lambda: memory_for("2MB", 1), lambda: memory_for("-1", 1)):
        with pytest.raises(ValueError, match="invalid limit"):
            bad()


def test_trees_as_json_and_depths(spark):
    docs = spark.createDataFrame([(1, '{"a": [1]}'), (2, "[" * 300 + "]" * 300)], "doc_id long, source string")
    nodes = parse_trees(docs, "json")
    named = {r["doc_id"]: json.loads(r["tree"]) for r in dump_json(nodes).collect()}
    pair = named[1]["children"][0]["children"][0]
    assert named[1]["kind"] == "document" and pair["kind"] == "pair" and [(c["kind"], c.get("field"), c["range"]) for c in pair["children"]] == [("string", "key", [1, 4]), ("array", "value", [6, 9])]
    every = json.loads(dump_json(nodes, anonymous=True).where("doc_id = 1").first()["tree"])
    assert [c["kind"] for c in every["children"][0]["children"]] == ["{", "pair", "}"]
    assert depths(nodes).where("doc_id = 2").agg({"depth": "max"}).first()[0] >= 300


def test_trace_and_inspection(spark):
    nodes = parse_trees(spark.createDataFrame([(1, "[1, 2]")], "doc_id long, source string"), "json")
    steps = api.trace(nodes, "Q = (document (array (number == \"2\") @n))").orderBy("step").collect()
    assert [(s["kind"], s["fits"]) for s in steps if s["kind"] == "number"] == [("number", False), ("number", True)]
    assert [s["step"] for s in steps] == list(range(1, len(steps) + 1))
    bundle = api.inspect("Q = (a [X: (b) @b Y: (c)?] @v -f)")
    assert bundle["entry"] == "Q" and "alternation" in bundle["pattern"]["Q"] and "option X" in bundle["pattern"]["Q"]
    assert api.inspect("Q = (a")["diagnostics"][0]["line"] == 1 and api.languages() == ["html", "json"]
