"""Location tokens, tags, and the tree markup's writer and readers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: coordinates go from 0 to NORM, and one outer element holds the screen.
NORM = 500
_OPEN, _CLOSE = "<screentag>", "</screentag>"
_LOCS = re.compile(r"<loc_(\d+)><loc_(\d+)><loc_(\d+)><loc_(\d+)>")
_LOC = re.compile(r"<loc_\d+>")
_NAMED = re.compile(r"<([a-zA-Z0-9_-]+)>")


def token(v: Column, norm: int = NORM) -> Column:
    """<loc_n> of a share of the page: clamped to 0..1, times ``norm``, rounded half to even."""
    return F.concat(F.lit("<loc_"), F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * norm).cast("int").cast("string"), F.lit(">"))


def location(l: Column, t: Column, r: Column, b: Column, width, height, norm: int = NORM) -> Column:  # noqa: E741
    w, h = F.lit(width) if isinstance(width, int) else width, F.lit(height) if isinstance(height, int) else height
    four = F.concat(token(F.least(l, r) / w, norm), token(F.least(t, b) / h, norm), token(F.greatest(l, r) / w, norm), token(F.greatest(t, b) / h, norm))
    return F.when((w <= 0) | (h <= 0), F.lit("<loc_0>" * 4)).otherwise(four)


def tag_name(label: Column, type_: Column, tag: Column) -> Column:
    known = lambda c: F.when(~F.lower(F.trim(c)).isin("", "unknown"), F.trim(c))
    raw = F.coalesce(known(label), known(type_), tag, F.lit("element"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "[^a-zA-Z0-9_-]", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(clean == "", F.lit("element")).otherwise(clean)


def denormalized(v: Column, size, norm: int = NORM) -> Column:
    return F.greatest(F.lit(0.0), F.least(v.cast("double"), F.lit(float(norm)))) / norm * size


def write(rows: list[dict]) -> str:
    """Markup of a screen's rows (idx, parent, x, y, head, tag, text): roots and children by (y, x, idx), depth first.

    ``head`` is the four location tokens. Rows that no root leads to, as in a cycle of parents, are not in it.
    """
    below: dict[int | None, list[dict]] = {}
    for row in sorted(rows, key=lambda r: (r["y"], r["x"], r["idx"])):
        below.setdefault(row["parent"], []).append(row)
    out, todo = [_OPEN], [("open", r) for r in reversed(below.get(None, []))]
    while todo:
        what, row = todo.pop()
        if what == "close":
            out.append(f"</{row['tag']}>")
            continue
        out.append(f"<{row['tag']}>{row['head']}{row['text']}")
        todo.append(("close", row))
        todo += [("open", r) for r in reversed(below.get(row["idx"], []))]
    return "".join([*out, _CLOSE])


def _body(markup: str) -> str:
    body = markup.strip()
    body = body[len(_OPEN) :] if body.startswith(_OPEN) else body
    return body[: -len(_CLOSE)] if body.endswith(_CLOSE) else body


def read(markup: str | None) -> list[dict]:
    """Nodes of the markup in preorder: node_id, parent_id, depth, tag, l, t, r, b, text.

    Text may stand anywhere in an element. Only the innermost element's end tag ends it; any other is text, and what
    never ends, ends with the markup. Elements without four location tokens are at zero. Outside of elements all else is skipped.
    """
    body = _body(markup or "")
    nodes: list[dict] = []
    stack: list[tuple[int, list[str], str]] = []  # node, its pieces of text and its end tag
    at, n = 0, len(body)

    def end():
        k, pieces, _ = stack.pop()
        nodes[k]["text"] = "".join(pieces).strip()

    while at < n:
        if body[at] != "<":
            to = body.find("<", at)
            to = n if to < 0 else to
            if stack:
                stack[-1][1].append(body[at:to])
            at = to
            continue
        if stack and body.startswith(stack[-1][2], at):
            at += len(stack[-1][2])
            end()
            continue
        loc = body.startswith("<loc_", at)
        if loc and stack and (m := _LOC.match(body, at)):
            at = m.end()
            continue
        to = -1 if loc or body.startswith("</", at) else body.find(">", at)
        if to < 0:
            if stack:
                stack[-1][1].append("<")
            at += 1
            continue
        locs = _LOCS.match(body, to + 1)
        l, t, r, b = map(int, locs.groups()) if locs else (0, 0, 0, 0)  # noqa: E741
        tag = body[at + 1 : to]
        nodes.append({"node_id": len(nodes), "parent_id": stack[-1][0] if stack else None, "depth": len(stack), "tag": tag, "l": l, "t": t, "r": r, "b": b, "text": ""})
        stack.append((len(nodes) - 1, [], f"</{tag}>"))
        at = locs.end() if locs else to + 1
    while stack:
        end()
    return nodes


def read_strict(markup: str | None, width: int, height: int) -> list[dict]:
    """Nodes in preorder with pixel boxes (shares of 500, cut to whole pixels), by the stricter reading.

    A start tag counts only with a plain name and four location tokens; an element's text is what stands before its
    first tag. An end tag ends the nearest open element of its name, counting those of the same name within.
    """
    body = _body(markup or "")
    nodes: list[dict] = []
    stack: list[int] = []
    for m in re.finditer(r"<(/?)([a-zA-Z0-9_-]+)>", body):
        name = m[2]
        if m[1]:
            if any(nodes[k]["tag"] == name for k in stack):
                while nodes[stack.pop()]["tag"] != name:
                    pass
            continue
        locs = _LOCS.match(body, m.end())
        if not locs or name.startswith("loc_"):
            continue
        l, t, r, b = map(int, locs.groups())  # noqa: E741
        to = body.find("<", locs.end())
        text = body[locs.end() : to if to >= 0 else len(body)].strip()
        nodes.append(dict(node_id=len(nodes), parent_id=stack[-1] if stack else None, depth=len(stack), tag=name, l=int(l / NORM * width), t=int(t / NORM * height), r=int(r / NORM * width), b=int(b / NORM * height), text=text))
        stack.append(len(nodes) - 1)
    return nodes


def tree_text(nodes: list[dict]) -> str:
    """The tree drawn line by line under a root of the whole page."""
    below: dict[int | None, list[dict]] = {}
    for x in nodes:
        below.setdefault(x["parent_id"], []).append(x)
    out = [f"screentag [0,0,{NORM},{NORM}]"]
    todo = [(x, "", k == 0) for k, x in enumerate(reversed(below.get(None, [])))]
    while todo:
        x, indent, last = todo.pop()
        text = x["text"] if len(x["text"]) <= 50 else f"{x['text'][:20]}...{x['text'][-15:]}"
        out.append(f"{indent}{'└── ' if last else '├── '}{x['tag']} [{x['l']},{x['t']},{x['r']},{x['b']}]" + (f' "{text}"' if text else ""))
        kids = below.get(x["node_id"], [])[::-1]
        todo += [(y, indent + ("    " if last else "│   "), k == 0) for k, y in enumerate(kids)]
    return "\n".join(out)
