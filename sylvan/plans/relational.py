"""Relational plans of patterns over one parent.

Covered: a root node whose items are leaf patterns (kind, wildcard, token, field, text test, captures as node, text or bool, and
references to definitions that are such leaves), either in a chain with or without anchors, or one quantified item that is last or
stands before one plain item without anchors; one greedy repeat under a leading anchor; one alternation of leaves, labelled or not;
one captured repeat of two leaves of different kinds that an anchor joins.
A chain keeps the first embedding: of all combinations of children that fit, the one with the least array of positions, which
is the order in which the matcher tries them. Quantifiers have closed forms (see ``_repeated``). Everything else returns None
and is left to the matcher.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions.regex import for_java
from sylvan.lang.analysis import Query
from sylvan.lang.ast import Alt, Anchor, Capture, Definition, Field, Node, Pattern, Quant, Ref, Seq
from sylvan.sources.nodes import with_counts

SOFT, EXACT = 1, 2


@dataclass
class Leaf:
    node: Node
    field: str | None
    capture: str | None
    type: str | None
    quant: Quant | None = None
    inner: str | None = None  # the capture inside a definition that is referred to; the value is a record of it


def condition(n: Node, field: str | None = None) -> Column:
    """The test of a node's own columns, cheapest conjunct first."""
    c = F.lit(True)
    if n.kind is not None:
        c = c & (F.col("kind") == n.kind)
    if n.named is not None:
        c = c & (F.col("named") == n.named)
    if n.missing:
        c = c & F.col("missing")
    if field is not None:
        c = c & (F.col("field") == field)
    if n.predicate:
        op, v = n.predicate
        text = F.coalesce("text", F.lit(""))
        c = c & {
            "==": lambda: text == v,
            "!=": lambda: text != v,
            "^=": lambda: F.startswith(text, F.lit(v)),
            "$=": lambda: F.endswith(text, F.lit(v)),
            "*=": lambda: F.contains(text, F.lit(v)),
            "=~": lambda: F.rlike(text, F.lit(for_java(v))),
            "!~": lambda: ~F.rlike(text, F.lit(for_java(v))),
        }[op]()
    return c


def leaf(p: Pattern, defs: dict[str, Definition] | None = None) -> Leaf | None:
    """A single-node item without children, in whatever order its capture, quantifier and field are written."""
    name = kind = field = quant = inner = None
    captured = False
    while not isinstance(p, Node):
        if isinstance(p, Ref) and defs and p.name in defs:
            own = leaf(defs[p.name].body)
            # a captured reference has a record as its value if the definition captures, and none if it does not
            if own is None or own.quant or own.field or own.type or captured and name and not own.capture:
                return None
            inner, p = own.capture if captured and name else None, own.node
            if captured and name and kind:
                return None
            break
        if isinstance(p, Capture) and not captured:
            name, kind, captured = p.name, p.type, True
        elif isinstance(p, Quant) and quant is None:
            quant = p
        elif isinstance(p, Field) and field is None:
            field = p.name
        else:
            return None
        p = p.inner
    return None if p.items or p.absent else Leaf(p, field, name, kind, quant, inner)


def _node(suffix: str = "") -> Column:
    c = lambda n: F.col(n + suffix)
    return F.struct(c("kind").alias("kind"), c("text").alias("text"), F.array(c("start_byte"), c("end_byte")).alias("span"))


def _value(x: Leaf, suffix: str = "") -> Column:
    if x.type == "text":
        return F.col("text" + suffix)
    return F.struct(_node(suffix).alias(x.inner)) if x.inner else _node(suffix)


def plan(nodes: DataFrame, query: Query, entry: str | None = None) -> DataFrame | None:
    """(doc_id, result struct) of the documents that match; None if the entry is outside of what this covers."""
    d = query.entry(entry)
    t = query.types[d.name]
    root = d.body
    if not isinstance(root, Node) or root.predicate or t is not None and (t[0] != "record" or not t[1]):
        return None
    gaps, leaves, gap = [], [], 0
    for i in root.items:
        if isinstance(i, Anchor):
            gap = max(gap, EXACT if i.exact else SOFT)
            continue
        x = leaf(i, query.definitions)
        if x is None or x.type not in (None, "text", "bool"):
            return _special(nodes, query, root, t)
        gaps.append(gap)
        leaves.append(x)
        gap = 0
    counted = with_counts(nodes)
    tops = nodes.where("parent_id is null").where(condition(root)).select("doc_id")
    if root.absent:
        tops = tops.join(nodes.where("parent_id = 0").where(F.col("field").isin(root.absent)).select("doc_id"), "doc_id", "left_anti")
    kids = counted.where("parent_id = 0")
    quantified = [i for i, x in enumerate(leaves) if x.quant]
    if not leaves:
        return _childless(tops, kids, gap)
    if not quantified:
        out = _chain(tops, kids, leaves, gaps, gap)
    elif quantified == [0] and len(leaves) <= 2 and not any(gaps) and not gap:
        out = _repeated(tops, kids, leaves)
    elif quantified == [0] and len(leaves) == 1 and not gap and not leaves[0].quant.lazy and leaves[0].quant.many:
        out = _run(tops, kids, leaves[0], gaps[0])
    else:
        return None
    fields = [x.capture for x in leaves if x.capture]
    return out.select("doc_id", F.struct(*fields).alias("result")) if fields else out.select("doc_id")


def _childless(tops: DataFrame, kids: DataFrame, gap: int) -> DataFrame:
    if not gap:
        return tops
    return tops.join(kids.where("own_nt > 0" if gap == SOFT else "true").select("doc_id"), "doc_id", "left_anti")


def _chain(tops: DataFrame, kids: DataFrame, leaves: list[Leaf], gaps: list[int], tail: int) -> DataFrame:
    """One join for each item after the first. With an anchor it is an equality of prefix counts. Without any after the first item,
    the first embedding takes the nearest child each time, so that one row a document goes from join to join."""
    columns = ("child_ix", "kind", "text", "start_byte", "end_byte", "c_nt", "c_ne", "own_nt", "own_ne", "tot_nt", "tot_ne", "n_siblings")
    both = lambda i, j: all(leaves[k].node.named is True for k in (i, j) if k is not None)
    count = lambda i, j: "nt" if both(i, j) else "ne"
    parts = [kids.where(condition(x.node, x.field)).select("doc_id", *(F.col(c).alias(f"{c}_{i}") for c in columns)) for i, x in enumerate(leaves)]
    out = parts[0].join(tops, "doc_id", "left_semi")
    if gaps[0]:
        k = count(None, 0)
        out = out.where("child_ix_0 = 0" if gaps[0] == EXACT else f"c_{k}_0 - own_{k}_0 = 0")
    value = lambda i, x: (F.lit(True) if x.type == "bool" else _value(x, f"_{i}")).alias(f"v{i}")
    if not any(gaps[1:]) and not tail:
        taken: list[str] = []
        for i, x in enumerate(leaves):
            if i:
                out = parts[i].join(out, "doc_id").where(F.col(f"child_ix_{i}") > F.col("at"))
            first = out.groupBy("doc_id").agg(F.min_by(F.struct(*taken, value(i, x), F.col(f"child_ix_{i}").alias("at")), f"child_ix_{i}").alias("m"))
            taken.append(f"v{i}")
            out = first.select("doc_id", *(F.col(f"m.{c}").alias(c) for c in (*taken, "at")))
        return out.select("doc_id", *(F.col(f"v{i}").alias(x.capture) for i, x in enumerate(leaves) if x.capture))
    for i in range(1, len(leaves)):
        k = count(i - 1, i)
        if not gaps[i]:
            near = F.col(f"child_ix_{i}") > F.col(f"child_ix_{i - 1}")
        elif gaps[i] == EXACT:
            near = F.col(f"child_ix_{i}") == F.col(f"child_ix_{i - 1}") + 1
        else:
            near = (F.col(f"child_ix_{i}") > F.col(f"child_ix_{i - 1}")) & (F.col(f"c_{k}_{i}") - F.col(f"own_{k}_{i}") == F.col(f"c_{k}_{i - 1}"))
        out = out.join(parts[i], "doc_id").where(near)
    if tail:
        n, k = len(leaves) - 1, count(len(leaves) - 1, None)
        out = out.where(f"child_ix_{n} = n_siblings_{n} - 1" if tail == EXACT else f"c_{k}_{n} = tot_{k}_{n}")
    place = F.array(*(F.col(f"child_ix_{i}") for i in range(len(leaves))))
    out = out.groupBy("doc_id").agg(F.min_by(F.struct(*(value(i, x) for i, x in enumerate(leaves))), place).alias("m"))
    return out.select("doc_id", *(F.col(f"m.v{i}").alias(x.capture) for i, x in enumerate(leaves) if x.capture))


def _repeated(tops: DataFrame, kids: DataFrame, leaves: list[Leaf]) -> DataFrame:
    """One quantified item, last or before one plain item, with permissive gaps.

    Greedy and last: all that fit (``?``: the first). Before an item that fits at children B: those before the last of B, and
    then the first of B after the last one taken. Lazy: as few as allowed, and then the first of B.
    """
    x, y = leaves[0], leaves[1] if len(leaves) > 1 else None
    q = x.quant
    a = condition(x.node, x.field)
    b = condition(y.node, y.field) if y else F.lit(False)
    both = kids.select("doc_id", "child_ix", "kind", "text", "start_byte", "end_byte", a.alias("a"), b.alias("b")).where("a or b")
    item = F.struct("child_ix", _value(x).alias("v"))
    per = both.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("a"), item))).alias("_xs"),
        F.array_sort(F.collect_list(F.when(F.col("b"), F.struct("child_ix", (_value(y) if y else F.lit(None)).alias("v"))))).alias("_ys"),
    )
    per = tops.join(per, "doc_id", "left")
    xs, ys = F.coalesce("_xs", F.array().cast(per.schema["_xs"].dataType)), F.coalesce("_ys", F.array().cast(per.schema["_ys"].dataType))
    per = per.select("doc_id", xs.alias("_xs"), ys.alias("_ys"))
    if y:
        per = per.where(F.size("_ys") > 0).withColumn("_xs", F.filter("_xs", lambda v: v["child_ix"] < F.element_at("_ys", -1)["child_ix"]))
    if q.lazy:
        per = per.withColumn("_xs", F.slice("_xs", 1, q.least))
    elif not q.many:
        per = per.withColumn("_xs", F.slice("_xs", 1, 1))
    per = per.where(F.size("_xs") >= q.least)
    out = []
    if x.capture:
        vs = F.transform("_xs", lambda v: v["v"])
        out.append((F.size("_xs") > 0 if x.type == "bool" else vs if q.many else F.get(vs, 0)).alias(x.capture))
    if y and y.capture:
        last = F.when(F.size("_xs") > 0, F.element_at("_xs", -1)["child_ix"]).otherwise(-1)
        first = F.get(F.filter("_ys", lambda v: v["child_ix"] > last), 0)
        out.append((F.lit(True) if y.type == "bool" else first["v"]).alias(y.capture))
    return per.select("doc_id", *out)


def _run(tops: DataFrame, kids: DataFrame, x: Leaf, anchor: int) -> DataFrame:
    """A greedy repeat under a leading anchor: the children that fit before the first one that breaks the run.

    What breaks it is counted among the siblings up to each child. Where nothing is taken, the anchor holds for the end of the parent:
    nothing may stand there that it does not skip.
    """
    k = "own_nt" if x.node.named is True else "own_ne"
    fits = condition(x.node, x.field)
    breaks = ~fits if anchor == EXACT else ~fits & (F.col(k) > 0)
    so_far = Window.partitionBy("doc_id").orderBy("child_ix").rowsBetween(Window.unboundedPreceding, 0)
    # a child that fits but is itself an extra may be skipped or taken; the repeat takes it
    seen = kids.select("doc_id", "child_ix", _value(x).alias("v"), fits.alias("fits"), F.sum(breaks.cast("int")).over(so_far).alias("broken"), (F.col("own_nt") if anchor == SOFT else F.lit(1)).alias("solid"))
    per = seen.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("fits") & (F.col("broken") == 0), F.struct("child_ix", "v")))).alias("_xs"), F.max("solid").alias("_solid"))
    per = tops.join(per, "doc_id", "left")
    xs = F.coalesce("_xs", F.array().cast(per.schema["_xs"].dataType))
    per = per.select("doc_id", xs.alias("_xs"), F.coalesce("_solid", F.lit(0)).alias("_solid"))
    per = per.where((F.size("_xs") > 0) | ((F.col("_solid") == 0) if x.quant.least == 0 else F.lit(False)))
    if not x.capture:
        return per.select("doc_id")
    return per.select("doc_id", (F.size("_xs") > 0 if x.type == "bool" else F.transform("_xs", lambda v: v["v"])).alias(x.capture))


def _special(nodes: DataFrame, query: Query, root: Node, t: tuple | None) -> DataFrame | None:
    """Plans of roots with one item that is no leaf."""
    if len(root.items) != 1 or root.absent:
        return None
    item, capture = root.items[0], None
    if isinstance(item, Capture) and item.name and not item.type:
        item, capture = item.inner, item.name
    tops = nodes.where("parent_id is null").where(condition(root)).select("doc_id")
    if isinstance(item, Alt) and (capture is None and not item.labelled or capture and item.labelled):
        options = [(label, leaf(o, query.definitions)) for label, o in item.options]
        if any(x is None or x.quant or x.inner or x.type not in (None, "text") for _, x in options):
            return None
        return _alternation(tops, nodes.where("parent_id = 0"), options, capture, t)
    if isinstance(item, Quant) and capture and item.many and not item.lazy and isinstance(item.inner, Seq) and len(item.inner.items) == 3:
        a, anchor, b = item.inner.items
        if not isinstance(anchor, Anchor):
            return None
        x, y = leaf(a, query.definitions), leaf(b, query.definitions)
        if any(z is None or z.quant or z.inner or z.type not in (None, "text") for z in (x, y)) or not (x.capture or y.capture):
            return None
        if None in (x.node.kind, y.node.kind) or x.node.kind == y.node.kind:
            return None
        return _pairs(tops, with_counts(nodes).where("parent_id = 0"), x, y, EXACT if anchor.exact else SOFT, capture, item.least)
    return None


def _alternation(tops: DataFrame, kids: DataFrame, options: list[tuple[str | None, Leaf]], capture: str | None, t: tuple | None) -> DataFrame | None:
    """The first child that fits any option, by the first option that it fits."""
    which = F.coalesce(*(F.when(condition(x.node, x.field), i) for i, (_, x) in enumerate(options)))
    found = kids.withColumn("_o", which).where("_o is not null").join(tops, "doc_id", "left_semi")
    names = list(dict.fromkeys(x.capture for _, x in options if x.capture))
    kinds = {n: {x.type for _, x in options if x.capture == n} for n in names}
    if any(len(k) > 1 for k in kinds.values()):
        return None
    values = []
    for n in names:
        at = [i for i, (_, x) in enumerate(options) if x.capture == n]
        x = options[at[0]][1]
        values.append(F.when(F.col("_o").isin(at), _value(x)).alias(n))
    first = found.groupBy("doc_id").agg(F.min_by(F.struct(F.col("_o").alias("_o"), *values), "child_ix").alias("m"))
    if capture is None:
        return first.select("doc_id", F.struct(*(F.col(f"m.{n}").alias(n) for n in names)).alias("result")) if names else first.select("doc_id")
    tag = F.coalesce(*(F.when(F.col("m._o") == i, F.lit(label)) for i, (label, _) in enumerate(options))).alias("$tag")
    full = [i for i, (_, x) in enumerate(options) if x.capture]
    data = [F.when(F.col("m._o").isin(full), F.struct(*(F.col(f"m.{n}").alias(n) for n in names))).alias("$data")] if names else []
    return first.select("doc_id", F.struct(F.struct(tag, *data).alias(capture)).alias("result"))


def _pairs(tops: DataFrame, kids: DataFrame, x: Leaf, y: Leaf, anchor: int, capture: str, least: int) -> DataFrame:
    """All pairs of children that an anchor joins, in order. Kinds differ, so that no child is in two pairs as different items."""
    k = "nt" if x.node.named is True and y.node.named is True else "ne"
    columns = ("child_ix", "kind", "text", "start_byte", "end_byte", f"c_{k}", f"own_{k}")
    side = lambda z, n: kids.where(condition(z.node, z.field)).select("doc_id", *(F.col(c).alias(f"{c}_{n}") for c in columns))
    if anchor == EXACT:
        near = F.expr("child_ix_b = child_ix_a + 1")
    else:
        near = F.expr(f"child_ix_b > child_ix_a and c_{k}_b - own_{k}_b = c_{k}_a")
    both = side(x, "a").join(side(y, "b"), "doc_id").where(near)
    # where extras fit, a child can have several partners: the nearest after it, and of those that share one the first
    item = F.struct(*(_value(z, f"_{n}").alias(z.capture) for z, n in ((x, "a"), (y, "b")) if z.capture))
    one = both.groupBy("doc_id", "child_ix_a").agg(F.min_by(F.struct("child_ix_b", item.alias("item")), "child_ix_b").alias("m"))
    one = one.groupBy("doc_id", F.col("m.child_ix_b").alias("b")).agg(F.min_by(F.struct("child_ix_a", F.col("m.item").alias("item")), "child_ix_a").alias("m"))
    per = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("m.child_ix_a").alias("at"), F.col("m.item").alias("item")))).alias("xs"))
    per = tops.join(per, "doc_id", "left")
    items = F.coalesce(F.transform("xs", lambda v: v["item"]), F.array().cast(per.select(F.transform("xs", lambda v: v["item"]).alias("i")).schema["i"].dataType))
    return per.select("doc_id", items.alias(capture)).where(F.size(capture) >= least).select("doc_id", F.struct(capture).alias("result"))
