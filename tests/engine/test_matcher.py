"""The matcher on hand-made trees, and relational plans against it on random ones."""

import cProfile
import json
import pstats
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylvan import api
from sylvan.lang.analysis import compile_query
from sylvan.operators.kernel import Matcher, Tree
from sylvan.plans import relational
from sylvan.sources.nodes import DDL, depths, dump, flat_trees
from sylvan.sources.text_trees import html_tree, json_tree, parse_trees, resolve


def rows_of(spec, doc=0):
    """Nodes of a nested spec: 'kind' or ('kind', [children]); 'f:kind' has a field, a quote makes a token, ~ an extra."""
    rows = []

    def add(s, parent, ix):
        kind, kids = (s, []) if isinstance(s, str) else s
        field = None
        if ":" in kind and kind[0] != '"':
            field, kind = kind.split(":")
        me = len(rows)
        rows.append({"doc_id": doc, "node_id": me, "parent_id": parent, "child_ix": ix, "kind": kind.strip('"').rstrip("~"), "named": kind[0] != '"', "extra": kind.endswith("~"), "missing": kind.endswith("^"), "field": field, "start_byte": me, "end_byte": me + 1, "text": f"{kind.strip(chr(34)).rstrip('~')}{me}"})
        for i, k in enumerate(kids):
            add(k, me, i)

    add(spec, None, 0)
    return rows


def run(query, spec, **options):
    status, value, _ = Matcher(compile_query(query), **options).run(Tree.of(rows_of(spec)))

    def short(v):
        if isinstance(v, dict):
            return v["text"] if "span" in v else {k: short(x) for k, x in v.items()}
        return [short(x) for x in v] if isinstance(v, list) else v

    return short(value) if status == "match" else status


R = ("r", ["a", '","', "b", "a", "c~", "b", '";"', "a"])
NO = "no match"
CASES = [
    ("Q = (r (a) @x . (b) @y)", R, {"x": "a1", "y": "b3"}),
    ("Q = (r (a) @x .! (b) @y)", R, NO),
    ('Q = (r (a) @x . "," @t)', R, {"x": "a1", "t": ",2"}),
    ('Q = (r "," . (b) @y)', R, {"y": "b3"}),
    ('Q = (r (c) . "," @t)', R, NO),
    ("Q = (r (a)* @xs (b) @y)", R, {"xs": ["a1", "a4"], "y": "b6"}),
    ("Q = (r (a)*? @xs (b) @y)", R, {"xs": [], "y": "b3"}),
    ("Q = (r (a)+? @xs (b) @y)", R, {"xs": ["a1"], "y": "b3"}),
    ("Q = (r (a)?? @x (b) @y)", R, {"x": None, "y": "b3"}),
    ("Q = (r {(a) @x . (b) @y}* @ps)", R, {"ps": [{"x": "a1", "y": "b3"}, {"x": "a4", "y": "b6"}]}),
    ("Q = (r (a) @x .)", R, {"x": "a8"}),
    ("Q = (r (b) @x .)", R, NO),
    ("Q = (r . (a) @x)", R, {"x": "a1"}),
    ("Q = (r .! (b) @x)", R, NO),
    ("Q = (r [(b) @b (c) @c])", R, {"b": "b3", "c": None}),
    ("Q = (r [X: (c) @c Y: (b)] @v)", R, {"v": {"$tag": "Y"}}),
    ("Q = (r .)", ("r", ["c~", '"x"']), None),
    ("Q = (r .)", ("r", ["c~", "a"]), NO),
    ("Q = (r .!)", ("r", ["c~"]), NO),
    ("Q = (r .!)", "r", None),
    ("Q = (r {(l)? @a . (d) @b})", ("r", ["d", "x"]), {"a": None, "b": "d1"}),
    ("Q = (r {(l)? @a . (d) @b})", ("r", ["l", "x", "d"]), NO),
    ("Q = (r {(l)? @a . (d) @b})", ("r", ["l", "c~", "d"]), {"a": "l1", "b": "d3"}),
    ("Q = (r {(l)? @a . (d) @b .})", ("r", ["d", "x"]), NO),
    ("Q = (r {(l)? @a . (d) @b .})", ("r", ["d"]), {"a": None, "b": "d1"}),
    ("Q = (r {(b)* @xs .})", ("r", ["c~"]), {"xs": []}),
    ("Q = (r {(b)* @xs .})", ("r", ["a"]), NO),
    ("Q = (r . (v)* @v)", ("r", ["v", "c~", "v", "x", "v"]), {"v": ["v1", "v3"]}),
    ("Q = (r f: (_) @x -g)", ("r", ["a", "f:b"]), {"x": "b2"}),
    ("Q = (r f: (_) @x -g)", ("r", ["f:b", "g:a"]), NO),
    ("Q = (r f: [(a) (b)]* @xs)", ("r", ["f:a", "b", "f:b"]), {"xs": ["a1", "b3"]}),
    ("Q = (r (a == \"a4\") @x)", R, {"x": "a4"}),
    ("Q = (r (a !~ /1$/) @x)", R, {"x": "a4"}),
    ("Q = (r (z)? @z :: bool (a) @t :: text)", R, {"z": False, "t": "a1"}),
    ("Q = (r (a)* @ts :: text)", R, {"ts": ["a1", "a4", "a8"]}),
    ("Q = (r {(a) @x (b) @y} @_ (a) @z)", R, {"z": "a4"}),
    ("P = (p k: (_) @k)\nQ = (r (P)* @ps (P))", ("r", [("p", ["k:a"]), ("p", ["k:b"])]), {"ps": [{"k": "a2"}]}),
    ("N = (n [(a) @leaf (N) @in])", ("n", [("n", ["a"])]), {"leaf": None, "in": {"leaf": "a2", "in": None}}),
    ("D = [(t) @t {(_ (D) @d)}]\nQ = (r (D) @d)", ("r", ["u", ("x", [("y", ["t"])])]), {"d": {"t": None, "d": {"t": None, "d": {"t": "t4", "d": None}}}}),
    ("A = (e (i) @id)? @x\nQ = (r (A)* @xs)", ("r", ["o", ("e", ["i"])]), {"xs": [{"x": {"id": "i3"}}]}),
    ("Q = (r (p (k) @k)* @ps)", ("r", [("p", ["k"]), ("p", ["k"])]), {"ps": [{"k": "k2"}, {"k": "k4"}]}),
    ("Q = (x)", R, NO),
    ("Q = (r _ @x)", ("r", ['"t"', "a"]), {"x": "t1"}),
    ("Q = (r (_) @x)", ("r", ['"t"', "a"]), {"x": "a2"}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_matcher(case):
    query, spec, want = CASES[case]
    assert run(query, spec) == want


@pytest.mark.parametrize(("query", "source", "want"), [
    ("Q = (document (array {(number) (number)} @x :: text))", "[1, 2, 3]", "1, 2"),
    ("Q = (document (array {(number) . (number) .} @x :: text))", "[1,  2, 3]", "2, 3"),
    ('Q = (document (array {"[" (number)} @x :: text))', "[é1, 2]".replace("é", ""), "[1"),
    ("Q = (document (array {(string) (number)?} @x :: text))", '["é" , 7]', '"é" , 7'),
    ("Q = (document (array [(string) {(null) (number)}] @x :: text))", "[true, null , 7]", "null , 7"),
    ("Q = (document (array {(string)?}? @x :: text))", "[1]", None),
])
def test_text_of_several_nodes_is_a_slice_of_the_source(spark, query, source, want):
    docs = spark.createDataFrame([(1, source)], "doc_id long, source string")
    assert api.run(parse_trees(docs, "json"), query).first()["result"]["x"] == want


def test_a_document_without_its_root_is_an_error():
    with pytest.raises(ValueError, match="no root"):
        Tree.of(rows_of(R)[1:])


def test_documents_stay_whole_when_small_partitions_are_merged(spark):
    """Roots and children come from differently sized sides of a union, which adaptive execution coalesces each for itself."""
    rows = spark.range(60_000).select((F.col("id") % 3000).alias("doc_id"), F.lit("a").alias("kind"), F.repeat(F.col("id").cast("string"), 40).alias("text"), "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = api.run_kernel(flat_trees(rows, "r", ["id"]), "Q = (r (a)* @xs)").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 3000 and {r["status"] for r in got} == {"match"}
    assert all(len(json.loads(r["result"])["xs"]) == 20 for r in got)


def test_fuel():
    storm = ("r", ["a"] * 60)
    assert run("Q = (r (a)* (a)* (a)* (b))", storm, fuel=1000) == "out of fuel"


def test_deep_chain():
    spec = "x"
    for _ in range(400):
        spec = ("n", [spec])
    value = run("N = [(x) @x {(n (N) @in)}]", spec)
    for _ in range(400):
        value = value["in"]
    assert value["x"] == "x400"


PLANS = ["(a) @x (b) @y", "(a) @x . (b) @y", "(a) @x .! (b) @y", ". (a) @x", ".! (b) @x", "(a) @x .", "(b) @x .!", "(a) @x . (b) @y . (a) @z", "(a)* @x", "(a)+ @x", "(a)? @x", "(a)*? @x", "(a)* @x (b) @y", "(a)+ @x (b) @y", "(a)? @x (b) @y", "(a)+? @x (b) @y", "(a)?? @x (b) @y", '"t" @x . (b) @y', "_ @x . (a) @y", ".", ".!", "f: (_) @x -g", "(a)? @x :: bool", "(a) @x :: text (b)", "(a =~ /[13]$/) @x"]


def test_plans_agree_with_the_matcher(spark):
    rng = random.Random(3)
    rows = [r for d in range(150) for r in rows_of(("r", [rng.choice(["a", "a", "b", "b", "c~", '"t"', "f:a", "g:b"]) for _ in range(rng.randrange(7))]), d)]
    nodes = spark.createDataFrame(rows, DDL).repartition(4).cache()
    for body in PLANS:
        q = compile_query(f"Q = (r {body})")
        assert relational.plan(nodes, q) is not None, body
        got = {r["doc_id"]: r.asDict(True) for r in api.run(nodes, q, tier="relational").collect()}
        want = {r["doc_id"]: r.asDict(True) for r in api.run(nodes, q, tier="kernel").collect()}
        assert got == want, body


MORE_PLANS = [
    "Q = (r (a) @x (b) @y (a) @z)", "Q = (r . (a) @x (b) @y (_) @z :: text)", "Q = (r (a) (b) @y (c))",
    "Q = (r . (a)* @x)", "Q = (r . (a)+ @x)", "Q = (r .! (a)* @x)", "Q = (r .! (b)+ @x :: text)", "Q = (r . (c)* @x)", 'Q = (r . "t"* @x)', "Q = (r . _* @x)", "Q = (r . (a)*)",
    "Q = (r [(a) @x (b) @y])", "Q = (r [(b) @x (_) @y (c) @z])", 'Q = (r [f: (_) @x "t" @x])', "Q = (r [(c) (b)])", "Q = (r [A: (a) @x B: (b)] @v)", "Q = (r [A: (c) @x B: (b) @y C: (_)] @v)", "Q = (r [A: (c) B: (g)] @v)",
    "Q = (r {(a) @x . (b) @y}* @ps)", "Q = (r {(a) @x . (b) @y}+ @ps)", "Q = (r {(a) @x .! (b)}* @ps)", 'Q = (r {"t" . (b) @y}* @ps)', "Q = (r {(c) @x . (a) @y}* @ps)", "Q = (r {(a) @x . (c) @y}* @ps)",
    "D = (a)\nQ = (r (D) . (b) @y)", "D = (a)\nQ = (r (D)* (b) @y)", "D = (a) @k\nQ = (r (D)* @xs)", "D = (a) @k\nQ = (r (D) @x . (b) @y)", "D = (a) @k\nQ = (r . (D)* @xs)",
]


def test_more_plans_agree_with_the_matcher(spark):
    rng = random.Random(4)
    rows = [r for d in range(200) for r in rows_of(("r", [rng.choice(["a", "a", "b", "b", "c~", "c", '"t"', "f:a", "g:b"]) for _ in range(rng.randrange(8))]), d)]
    nodes = spark.createDataFrame(rows, DDL).repartition(4).cache()
    for text in MORE_PLANS:
        q = compile_query(text)
        assert relational.plan(nodes, q) is not None, text
        got = {r["doc_id"]: r.asDict(True) for r in api.run(nodes, q, tier="relational").collect()}
        want = {r["doc_id"]: r.asDict(True) for r in api.run(nodes, q, tier="kernel").collect()}
        assert got == want, text


def test_no_plan_is_an_error(spark):
    nodes = spark.createDataFrame(rows_of(R), DDL)
    with pytest.raises(ValueError):
        api.run(nodes, "Q = (r [(a) (b)] @x)", tier="relational")


def test_text_trees(spark):
    n = list(json_tree('{"é": [1, {"a": "b"}').nodes())
    assert [x[3] for x in n if x[6]] == ["]", "}"] and n[0][9] == len('{"é": [1, {"a": "b"}'.encode())
    assert [x[3] for x in json_tree("").nodes()] == ["document"]
    assert "ERROR" in [x[3] for x in json_tree("{]").nodes()]
    h = list(html_tree('<p a="1">é<b>x</p><!-- c --></i><br><script>"</p>"</script>').nodes())
    assert [x[3] for x in h].count("end_tag") == 3 and [x[6] for x in h].count(True) == 1
    assert "ERROR" in [x[3] for x in h] and [x[5] for x in h].count(True) == 1
    raw = '<p a="1">é<b>x</p>'.encode()
    assert all(raw[x[8] : x[9]].decode() == x[10] for x in html_tree('<p a="1">é<b>x</p>').nodes())
    assert resolve("HTM") == "html"
    with pytest.raises(KeyError):
        resolve("cobol")
    docs = spark.createDataFrame([(1, '{"k": 2}'), (2, None), (None, "{}")], "doc_id long, source string")
    nodes = parse_trees(docs, "json")
    assert {r["doc_id"] for r in nodes.select("doc_id").distinct().collect()} == {1, 2}
    assert depths(nodes).agg(F.max("depth")).first()[0] == 3
    shown = {r["doc_id"]: r["tree"] for r in dump(nodes).collect()}
    assert shown[2] == "(document)" and shown[1].split("\n")[3] == "    (pair)"
    assert api.envelope(api.run(nodes, "Q = (document (object (pair value: (number) @v)))")).where("doc_id = 2").first()["json"] == '{"result":null,"error":"no match"}'


def test_matches_and_stream(spark, tmp_path):
    from sylvan.sources.text_trees import parse_trees
    from sylvan.streaming import run_stream

    docs = spark.createDataFrame([(1, '{"k": 2}'), (2, "[]")], "doc_id long, source string")
    docs.write.parquet(str(tmp_path / "in"))
    assert dict(api.matches(parse_trees(docs, "json"), "Q = (document (object))").collect()) == {1: True, 2: False}
    seen = {}
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    run_stream(stream, lambda d: parse_trees(d, "json"), "Q = (document (object (pair value: (number) @v)))", lambda r, n: seen.update({x["doc_id"]: x["status"] for x in r.collect()}), str(tmp_path / "c")).processAllAvailable()
    assert seen == {1: "match", 2: "no match"}


def test_empty(spark):
    nodes = spark.createDataFrame([], DDL)
    assert api.run(nodes, "Q = (r (a) @x)").count() == 0 and api.run(nodes, "Q = (r (a) @x)", tier="kernel").count() == 0


def test_documents_are_read_by_columns_and_not_by_rows():
    """Documents over several batches, with nodes that have no parent, field or text; there are fewer steps than rows."""
    rows = [r for d in range(400) for r in rows_of(("r", ["f:a", "b", '"c"', "e~"]), d)]
    for r in rows[::7]:
        r["text"] = None
    schema = pa.schema([("doc_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("child_ix", pa.int32()), ("kind", pa.string()), ("named", pa.bool_()), ("extra", pa.bool_()), ("missing", pa.bool_()), ("field", pa.string()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("text", pa.string())])
    whole = pa.RecordBatch.from_pylist(rows, schema)
    batches = [whole.slice(0, 3), whole.slice(3, 0), whole.slice(3, 4), whole.slice(7, 1), whole.slice(8)]
    steps = cProfile.Profile()
    got = steps.runcall(lambda: list(api._documents(iter(batches))))
    assert pstats.Stats(steps).total_calls < 2 * len(rows)
    assert [d for d, _ in got] == list(range(400))
    for d, columns in got:
        assert Tree.of_columns(d, *columns) == Tree.of([r for r in rows[5 * d : 5 * d + 5]])
        assert columns[1] == [None, 0, 0, 0, 0] and all(type(v) in (int, type(None)) for v in columns[1])


def test_roots_need_no_order_of_rows(spark):
    """The rows of a document are ordered once, for its children; the root's end is that of the last child."""
    rows = spark.createDataFrame([(1, "a", "été", 2), (1, "b", None, 1), (2, "a", "xy", 1), (None, "a", "z", 1)], "doc_id long, kind string, text string, at int")
    nodes = flat_trees(rows, "r", ["at"])
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    ends = {r["doc_id"]: r["end_byte"] for r in nodes.where("parent_id is null").collect()}
    assert ends == {r["doc_id"]: r["n"] for r in nodes.where("parent_id = 0").groupBy("doc_id").agg(F.max("end_byte").alias("n")).collect()} == {1: 6, 2: 2, None: 1}


@pytest.mark.parametrize("query", ['Q = (document (object {"{" (pair)} @p :: text))', 'Q = (document (object . "{" @t . (pair) @p :: text))', 'Q = (document (object (pair) . "}" @t .))', "Q = (document (object (pair key: (string) @k value: (number) @v)))", 'Q = (document (object "{" . (pair) @p :: text . "}"))'])
def test_trees_of_texts_are_matched_where_they_are_parsed(spark, query):
    """Texts, empty and broken ones among them, are parsed and matched without a table of nodes between, and with the same results."""
    texts = ['{"k": 5}', '{"é": 1, "k": "x"}', "{}", "", None, '{"a": {"b": 2}', "[1, 2]", '  {"k" 7} ', "]"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "{}")], "doc_id long, source string")
    nodes = parse_trees(docs, "json")
    here, dealt = api.run(nodes, query, stats=True), api.run(nodes.where("true"), query, stats=True)
    assert sorted(here.collect(), key=lambda r: r["doc_id"]) == sorted(dealt.collect(), key=lambda r: r["doc_id"])
    assert here.count() == len(texts)
    plan = [x._jdf.queryExecution().optimizedPlan().toString() for x in (here, dealt)]
    assert ["kind" in p.split("Repartition")[1] for p in plan] == [False, True] and [p.count("MapInArrow") for p in plan] == [1, 2]
