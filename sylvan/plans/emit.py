"""Result types as text: Spark DDL and TypeScript."""

from __future__ import annotations

from sylvan.lang.analysis import Query
from sylvan.plans.schema import result_type


def ddl(query: Query, entry: str | None = None) -> str | None:
    """The Spark type of an entry's result as DDL text; None if it is match only."""
    t = result_type(query, entry)
    return t.simpleString() if t is not None else None


def typescript(query: Query) -> str:
    """Declarations of all definitions with a value."""
    out = ["export interface Node {\n  kind: string;\n  text: string;\n  span: [number, number];\n}"]

    def show(t: tuple) -> str:
        if t[0] in ("node", "text", "bool"):
            return {"node": "Node", "text": "string", "bool": "boolean"}[t[0]]
        if t[0] == "ref":
            return t[1]
        if t[0] == "option":
            return f"{show(t[1])} | null"
        if t[0] == "list":
            inner = show(t[1])
            inner = f"({inner})" if " | " in inner else inner
            return f"[{inner}, ...{inner}[]]" if t[2] else f"{inner}[]"
        if t[0] == "record":
            return "{ " + "; ".join(f"{k}: {show(v)}" for k, v in t[1].items()) + " }"
        return " | ".join(f'{{ $tag: "{k}"' + (f"; $data: {show(v)}" if v else "") + " }" for k, v in t[1].items())

    for name, t in query.types.items():
        if t is not None:
            out.append(f"export type {name} = {show(t)};")
    return "\n\n".join(out)
