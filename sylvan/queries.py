"""Registered queries over the tables, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan import api
from sylvan.sources import relational, text_trees
from sylvan.sources.nodes import with_counts

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


TREES: dict[str, Build] = {
    "dialogue": lambda s, d: relational.dialogues(_t(s, d, "conversations")),
    "session": lambda s, d: relational.sessions(_t(s, d, "events")),
    "order": lambda s, d: relational.orders(_t(s, d, "orders"), _t(s, d, "lineitem")),
    "lines": lambda s, d: relational.lines(_t(s, d, "documents")),
    "account": lambda s, d: relational.accounts(_t(s, d, "customer"), _t(s, d, "orders").where("year(o_orderdate) = 1995")),
    "places": lambda s, d: relational.places(_t(s, d, "region"), _t(s, d, "nation")),
    "props": lambda s, d: text_trees.parse_trees(_t(s, d, "events"), "json", "event_id", "props"),
    "pages": lambda s, d: text_trees.parse_trees(_t(s, d, "pages"), "html", "page_id", "html"),
}


def flat(result: DataFrame) -> DataFrame:
    """doc_id and the fields of the results of matching documents as plain columns: node texts, lists of them joined by commas."""
    out = [F.col("doc_id")]
    shape = result.schema["result"].dataType if "result" in result.columns else None
    for f in shape.fields if shape is not None else ():
        v, kind = F.col("result").getField(f.name), f.dataType.simpleString()
        if kind.startswith("array"):
            of_nodes = kind.startswith("array<struct<kind:string,text")
            v = F.array_join(F.transform(v, lambda x: x["text"]) if of_nodes else v, ",")
        elif kind.startswith("struct<kind:string,text"):
            v = v["text"]
        out.append(v.alias(f.name))
    return result.where("status = 'match'").select(*out)


def pattern(name: str, tree: str, text: str, sql: str | None = None, tier: str = "auto") -> None:
    """Registers a pattern over a kind of tree."""
    QUERIES[name] = lambda s, d: flat(api.run(TREES[tree](s, d), text, tier=tier))
    if sql:
        ORACLE_SQL[name] = sql


_TURNS = "t AS (SELECT conv_id AS doc_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ix FROM conversations)"
_SOFT = "s AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM t WHERE role <> 'system' WINDOW w AS (PARTITION BY doc_id ORDER BY turn))"
_EV = "e AS (SELECT user_id AS doc_id, event_type AS kind, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ix FROM events)"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {0}) = 1"

for _tier, _suffix in (("auto", ""), ("kernel", "_kernel")):
    pattern(f"soft_adjacent_pair{_suffix}", "dialogue", "Q = (conversation (user) @u . (assistant) @a)", f"WITH {_TURNS}, {_SOFT} SELECT doc_id, text AS u, next_text AS a FROM s WHERE role = 'user' AND next_role = 'assistant' {_FIRST.format('ix')}", _tier)
    pattern(f"exact_adjacent_pair{_suffix}", "dialogue", "Q = (conversation (user) @u .! (assistant) @a)", f"WITH {_TURNS}, s AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY turn)) SELECT doc_id, text AS u, nt AS a FROM s WHERE role = 'user' AND nr = 'assistant' {_FIRST.format('ix')}", _tier)
    pattern(f"first_child_soft{_suffix}", "dialogue", "Q = (conversation . (user) @u)", f"WITH {_TURNS}, f AS (SELECT * FROM t WHERE role <> 'system' {_FIRST.format('ix')}) SELECT doc_id, text AS u FROM f WHERE role = 'user'", _tier)
    pattern(f"first_child_exact{_suffix}", "dialogue", "Q = (conversation .! (user) @u)", f"WITH {_TURNS} SELECT doc_id, text AS u FROM t WHERE ix = 1 AND role = 'user'", _tier)
    pattern(f"last_child_soft{_suffix}", "dialogue", "Q = (conversation (assistant) @a .)", f"WITH {_TURNS}, f AS (SELECT * FROM t WHERE role <> 'system' {_FIRST.format('ix DESC')}) SELECT doc_id, text AS a FROM f WHERE role = 'assistant'", _tier)
    pattern(f"last_child_exact{_suffix}", "dialogue", "Q = (conversation (assistant) @a .!)", f"WITH {_TURNS}, f AS (SELECT * FROM t {_FIRST.format('ix DESC')}) SELECT doc_id, text AS a FROM f WHERE role = 'assistant'", _tier)
    pattern(f"permissive_pair{_suffix}", "session", "Q = (session (click) @c (purchase) @p)", f"WITH {_EV}, c AS (SELECT doc_id, min(ix) AS i FROM e WHERE kind = 'click' GROUP BY 1), p AS (SELECT e.doc_id, i, min(ix) AS j FROM e JOIN c ON e.doc_id = c.doc_id AND ix > i WHERE kind = 'purchase' GROUP BY 1, 2) SELECT p.doc_id, x.event_id::VARCHAR AS c, y.event_id::VARCHAR AS p FROM p JOIN e x ON x.doc_id = p.doc_id AND x.ix = i JOIN e y ON y.doc_id = p.doc_id AND y.ix = j", _tier)
    pattern(f"star_tail{_suffix}", "session", "Q = (session (click)* @xs)", f"WITH {_EV} SELECT doc_id, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY ix) FILTER (kind = 'click'), '') AS xs FROM e GROUP BY 1", _tier)
    pattern(f"plus_tail{_suffix}", "session", "Q = (session (signup)+ @xs)", f"WITH {_EV} SELECT doc_id, string_agg(event_id::VARCHAR, ',' ORDER BY ix) AS xs FROM e WHERE kind = 'signup' GROUP BY 1", _tier)
    pattern(f"opt_tail{_suffix}", "session", "Q = (session (signup)? @x)", f"WITH {_EV} SELECT doc_id, arg_min(event_id, ix) FILTER (kind = 'signup')::VARCHAR AS x FROM e GROUP BY 1", _tier)
    pattern(f"lazy_star_tail{_suffix}", "session", "Q = (session (click)*? @xs)", "SELECT DISTINCT user_id AS doc_id, '' AS xs FROM events", _tier)
    _then = f"WITH {_EV}, b AS (SELECT doc_id, max(ix) AS hi FROM e WHERE kind = 'purchase' GROUP BY 1), x AS (SELECT b.doc_id, hi, {{xs}} AS xs, {{last}} AS lo FROM b LEFT JOIN e ON e.doc_id = b.doc_id AND kind = 'click' AND ix < hi GROUP BY 1, 2) SELECT x.doc_id, {{shown}}, (SELECT arg_min(event_id, ix) FROM e WHERE e.doc_id = x.doc_id AND kind = 'purchase' AND ix > lo)::VARCHAR AS y FROM x {{where}}"
    _all = {"xs": "string_agg(event_id::VARCHAR, ',' ORDER BY ix)", "last": "coalesce(max(ix), 0)"}
    pattern(f"star_then{_suffix}", "session", "Q = (session (click)* @xs (purchase) @y)", _then.format(**_all, shown="coalesce(xs, '') AS xs", where=""), _tier)
    pattern(f"plus_then{_suffix}", "session", "Q = (session (click)+ @xs (purchase) @y)", _then.format(**_all, shown="xs", where="WHERE xs IS NOT NULL"), _tier)
    pattern(f"opt_then{_suffix}", "session", "Q = (session (click)? @x (purchase) @y)", _then.format(xs="arg_min(event_id, ix)::VARCHAR", last="coalesce(min(ix), 0)", shown="xs AS x", where=""), _tier)
    pattern(f"lazy_then{_suffix}", "session", "Q = (session (click)*? @xs (purchase) @y)", f"WITH {_EV} SELECT doc_id, '' AS xs, arg_min(event_id, ix)::VARCHAR AS y FROM e WHERE kind = 'purchase' GROUP BY 1", _tier)
    pattern(f"field_equals{_suffix}", "order", 'Q = (order status: (_ == "F") priority: (_) @p)', "SELECT o_orderkey AS doc_id, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F'", _tier)
    for _n, _op, _v, _sql in (("eq", "==", '"user"', "kind = 'user'"), ("ne", "!=", '"1"', "text <> '1'"), ("prefix", "^=", '"The"', "starts_with(text, 'The')"), ("suffix", "$=", '"."', "ends_with(text, '.')"), ("contains", "*=", '"ing th"', "contains(text, 'ing th')"), ("regex", "=~", "/^[A-Z][a-z]+ of\\b/", "regexp_matches(text, '^[A-Z][a-z]+ of([^0-9A-Za-z_]|$)')"), ("not_regex", "!~", "/[a-z]{9}/", "NOT regexp_matches(text, '[a-z]{9}')")):
        if _n != "eq":
            pattern(f"text_{_n}{_suffix}", "lines", f"Q = (document (line {_op} {_v})* @xs)", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) SELECT doc_id, coalesce(string_agg(text, ',' ORDER BY i) FILTER ({_sql}), '') AS xs FROM l GROUP BY 1", _tier)
    pattern(f"wildcard_any{_suffix}", "dialogue", "Q = (conversation _* @xs)", f"WITH {_TURNS} SELECT doc_id, string_agg(text, ',' ORDER BY ix) AS xs FROM t GROUP BY 1", _tier)
    pattern(f"capture_bool{_suffix}", "dialogue", "Q = (conversation (system)? @has :: bool)", "SELECT conv_id AS doc_id, bool_or(role = 'system') AS has FROM conversations GROUP BY 1", _tier)
    pattern(f"capture_text{_suffix}", "dialogue", "Q = (conversation (assistant) @a :: text)", f"WITH {_TURNS} SELECT doc_id, arg_min(text, ix) AS a FROM t WHERE role = 'assistant' GROUP BY 1", _tier)

    pattern(f"regex_unicode{_suffix}", "dialogue", r"Q = (conversation (user =~ /^\p{Lu}\p{Ll}+[\s,.]/)* @xs)", f"WITH {_TURNS} SELECT doc_id, coalesce(string_agg(text, ',' ORDER BY ix) FILTER (role = 'user' AND regexp_matches(text, '^\\p{{Lu}}\\p{{Ll}}+[\\s,.]')), '') AS xs FROM t GROUP BY 1", _tier)
    pattern(f"regex_dotall{_suffix}", "dialogue", r"Q = (conversation (_ =~ /(?s)^[A-Z].*[a-z]{9}.*[.?]$/)* @xs)", f"WITH {_TURNS} SELECT doc_id, coalesce(string_agg(text, ',' ORDER BY ix) FILTER (regexp_matches(text, '(?s)^[A-Z].*[a-z]{{9}}.*[.?]$')), '') AS xs FROM t GROUP BY 1", _tier)
    _CHILD = "WITH k AS (SELECT c_custkey AS doc_id, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus <> 'F') AS solid FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND year(o_orderdate) = 1995 GROUP BY 1) SELECT doc_id FROM k WHERE "
    pattern(f"childless_trivia{_suffix}", "account", "Q = (account .)", _CHILD + "solid = 0 OR n = 0", _tier)
    pattern(f"childless_exact{_suffix}", "account", "Q = (account .!)", _CHILD + "n = 0", _tier)
    pattern(f"lazy_plus_tail{_suffix}", "session", "Q = (session (purchase)+? @xs)", f"WITH {_EV} SELECT doc_id, arg_min(event_id, ix)::VARCHAR AS xs FROM e WHERE kind = 'purchase' GROUP BY 1", _tier)
    pattern(f"lazy_opt_then{_suffix}", "session", "Q = (session (click)?? @x (purchase) @y)", f"WITH {_EV} SELECT doc_id, NULL::VARCHAR AS x, arg_min(event_id, ix)::VARCHAR AS y FROM e WHERE kind = 'purchase' GROUP BY 1", _tier)
    pattern(f"negated_field{_suffix}", "order", "Q = (order -missing status: (_) @s)", "SELECT o_orderkey AS doc_id, o_orderstatus AS s FROM orders", _tier)
    pattern(f"text_list{_suffix}", "session", "Q = (session (signup)* @xs :: text)", f"WITH {_EV} SELECT doc_id, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY ix) FILTER (kind = 'signup'), '') AS xs FROM e GROUP BY 1", _tier)

pattern("capture_text_composite", "props", 'Q = (document (object {"{" (pair)} @p :: text))', "SELECT event_id AS doc_id, rtrim(regexp_replace(props, '\\}\\s*$', '')) AS p FROM events")
pattern("first_token", "props", 'Q = (document (object . "{" @t . (pair) @p :: text))', "SELECT event_id AS doc_id, '{' AS t, trim(trim(props, '{}')) AS p FROM events")
pattern("last_token", "props", 'Q = (document (object (pair) . "}" @t .))', "SELECT event_id AS doc_id, '}' AS t FROM events")
for _tier, _suffix in (("auto", ""), ("kernel", "_kernel")):
    pattern(f"anchored_run{_suffix}", "session", "Q = (session . (view)* @v)", f"WITH {_EV}, k AS (SELECT doc_id, kind, event_id, ix, count(*) FILTER (kind NOT IN ('view', 'error')) OVER (PARTITION BY doc_id ORDER BY ix) AS broken FROM e) SELECT doc_id, string_agg(event_id::VARCHAR, ',' ORDER BY ix) AS v FROM k WHERE broken = 0 AND kind = 'view' GROUP BY 1 UNION ALL SELECT doc_id, '' FROM e GROUP BY 1 HAVING count(*) FILTER (kind <> 'error') = 0", _tier)
_ALT = f"WITH {_EV}, f AS (SELECT * FROM e WHERE kind IN ('click', 'purchase') {_FIRST.format('ix')})"
for _tier, _suffix in (("auto", ""), ("kernel", "_kernel")):
    pattern(f"alternation_merged{_suffix}", "session", "Q = (session [(click) @c (purchase) @p])", f"{_ALT} SELECT doc_id, CASE WHEN kind = 'click' THEN event_id::VARCHAR END AS c, CASE WHEN kind = 'purchase' THEN event_id::VARCHAR END AS p FROM f", _tier)
pattern("discard", "dialogue", "Q = (conversation {(user) @x (assistant) @y} @_ (user) @z)", f"WITH {_TURNS}, a AS (SELECT doc_id, min(ix) AS i FROM t WHERE role = 'user' GROUP BY 1), b AS (SELECT t.doc_id, min(ix) AS j FROM t JOIN a ON a.doc_id = t.doc_id AND ix > i WHERE role = 'assistant' GROUP BY 1), c AS (SELECT t.doc_id, arg_min(text, ix) AS z FROM t JOIN b ON b.doc_id = t.doc_id AND ix > j WHERE role = 'user' GROUP BY 1) SELECT doc_id, z FROM c")
for _tier, _suffix in (("auto", ""), ("kernel", "_kernel")):
    pattern(f"reference{_suffix}", "session", "Buy = (purchase)\nQ = (session (Buy) . (view) @v)", f"WITH {_EV}, s AS (SELECT *, lead(kind) OVER w AS nk, lead(event_id) OVER w AS ne FROM e WHERE kind <> 'error' WINDOW w AS (PARTITION BY doc_id ORDER BY ix)) SELECT doc_id, ne::VARCHAR AS v FROM s WHERE kind = 'purchase' AND nk = 'view' {_FIRST.format('ix')}", _tier)
pattern("nested_text", "props", "Q = (document (object (pair key: (string) @k value: (number) @v)))", "SELECT event_id AS doc_id, '\"k\"' AS k, json_extract_string(props, '$.k') AS v FROM events")
pattern("token", "props", 'Q = (document (object "{" . (pair) @p :: text . "}"))', "SELECT event_id AS doc_id, trim(trim(props, '{}')) AS p FROM events")


def alternation_labelled(spark: SparkSession, d: str) -> DataFrame:
    r = api.run(TREES["session"](spark, d), "Q = (session [Click: (click) @c Buy: (purchase) @p] @v)").where("status = 'match'")
    v = F.col("result.v")
    return r.select("doc_id", v.getField("$tag").alias("tag"), F.coalesce(v.getField("$data")["c"]["text"], v.getField("$data")["p"]["text"]).alias("event"))


ORACLE_SQL["alternation_labelled"] = f"{_ALT} SELECT doc_id, CASE kind WHEN 'click' THEN 'Click' ELSE 'Buy' END AS tag, event_id::VARCHAR AS event FROM f"


def record_list(spark: SparkSession, d: str) -> DataFrame:
    r = api.run(TREES["dialogue"](spark, d), "Q = (conversation {(user) @u . (assistant) @a}* @pairs)").where("status = 'match'")
    return r.select("doc_id", F.posexplode("result.pairs").alias("n", "p")).select("doc_id", "n", F.col("p.u.text").alias("u"), F.col("p.a.text").alias("a"))


ORACLE_SQL["record_list"] = f"WITH {_TURNS}, {_SOFT} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1)::INTEGER AS n, text AS u, next_text AS a FROM s WHERE role = 'user' AND next_role = 'assistant'"


def reference_list(spark: SparkSession, d: str) -> DataFrame:
    r = api.run(TREES["order"](spark, d), "Item = (item) @part\nQ = (order (Item)* @items)").where("status = 'match'")
    return r.select("doc_id", F.size("result.items").cast("long").alias("n"), F.aggregate("result.items", F.lit(0).cast("long"), lambda a, x: a + x["part"]["text"].cast("long")).alias("parts"))


ORACLE_SQL["reference_list"] = "SELECT o_orderkey AS doc_id, count(l_partkey)::BIGINT AS n, coalesce(sum(l_partkey), 0)::BIGINT AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


def option_of_record(spark: SparkSession, d: str) -> DataFrame:
    r = api.run(TREES["session"](spark, d), "Q = (session {(click) @c . (purchase) @p}? @pair)").where("status = 'match'")
    return r.select("doc_id", F.col("result.pair.c.text").alias("c"), F.col("result.pair.p.text").alias("p"))


ORACLE_SQL["option_of_record"] = f"WITH {_EV}, s AS (SELECT *, lead(kind) OVER w AS nk, lead(event_id) OVER w AS ne FROM e WHERE kind <> 'error' WINDOW w AS (PARTITION BY doc_id ORDER BY ix)), f AS (SELECT doc_id, event_id AS c, ne AS p FROM s WHERE kind = 'click' AND nk = 'purchase' {_FIRST.format('ix')}) SELECT DISTINCT e.doc_id, c::VARCHAR AS c, p::VARCHAR AS p FROM e LEFT JOIN f ON f.doc_id = e.doc_id"


def matches_mode(spark: SparkSession, d: str) -> DataFrame:
    return api.matches(TREES["dialogue"](spark, d), "Q = (conversation (system))")


ORACLE_SQL["matches_mode"] = "SELECT conv_id AS doc_id, bool_or(role = 'system') AS matched FROM conversations GROUP BY 1"


def node_counts(spark: SparkSession, d: str) -> DataFrame:
    n = with_counts(TREES["dialogue"](spark, d)).where("parent_id is not null")
    return n.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("tot_nt").cast("long").alias("solid"), F.max("end_byte").cast("long").alias("bytes"))


ORACLE_SQL["node_counts"] = "SELECT conv_id AS doc_id, count(*) AS n, count(*) FILTER (role <> 'system') AS solid, (sum(octet_length(encode(text)) + 1) - 1)::BIGINT AS bytes FROM conversations GROUP BY 1"


def tree_dump(spark: SparkSession, d: str) -> DataFrame:
    return api.dump(TREES["places"](spark, d))


ORACLE_SQL["tree_dump"] = "SELECT n_regionkey::BIGINT AS doc_id, '(region)' || string_agg(chr(10) || '  (nation)', '') AS tree FROM nation GROUP BY 1"


def deep_search(spark: SparkSession, d: str) -> DataFrame:
    """Recursive search for the first link of each page; its type contains itself, so results are variants."""
    q = 'Link = [Here: (attribute name: (attribute_name == "href") value: (attribute_value) @to) In: (_ (Link) @at)]'
    r = api.run(TREES["pages"](spark, d), q)
    return r.select("doc_id", "status", F.to_json("result").alias("result"))


def self_recursion(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose elements nest along first children, by a definition that refers to itself."""
    q = "Chain = (element (start_tag) . (Chain)? @inner)\nQ = (html_document (Chain) @c)"
    return api.run(TREES["pages"](spark, d), q).select("doc_id", "status", F.to_json("result").alias("result"))


def missing_tags(spark: SparkSession, d: str) -> DataFrame:
    q = "Open = (element (start_tag (tag_name) @name) (MISSING end_tag))\nFind = [(Open) @here {(_ (Find) @below)}]"
    return api.run(TREES["pages"](spark, d), q, entry="Find").select("doc_id", "status", F.to_json("result").alias("result"))


ORACLE_SQL["envelope"] = """WITH t AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'system') AS x, bool_or(role = 'system') AS has FROM conversations GROUP BY 1),
o AS (SELECT conv_id, turn, text, role, coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo, octet_length(encode(text)) AS n FROM conversations),
s AS (SELECT conv_id, arg_min(lo, turn) AS lo, arg_min(n, turn) AS n FROM o WHERE role = 'system' GROUP BY 1)
SELECT t.conv_id AS doc_id, CASE WHEN has THEN '{"result":{"s":{"kind":"system","text":' || to_json(x)::VARCHAR || ',"span":[' || lo || ',' || (lo + n) || ']}}}' ELSE '{"result":null,"error":"no match"}' END AS json FROM t LEFT JOIN s ON s.conv_id = t.conv_id"""


def kernel_fuel(spark: SparkSession, d: str) -> DataFrame:
    return api.run_kernel(TREES["session"](spark, d), "Q = (session (click)* (nothing))", fuel=50).select("doc_id", "status")


def envelope(spark: SparkSession, d: str) -> DataFrame:
    return api.envelope(api.run(TREES["dialogue"](spark, d), "Q = (conversation (system) @s)"))


QUERIES |= {f.__name__: f for f in (alternation_labelled, option_of_record, record_list, reference_list, matches_mode, node_counts, tree_dump, deep_search, self_recursion, missing_tags, kernel_fuel, envelope)}
