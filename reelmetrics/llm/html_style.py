"""Which elements of a page its style sheets hide: the cascade of ``display`` and ``visibility``.

Read are rules for the screen, with type, class, id and attribute selectors, the four combinators, :not, :is, :where,
:root and :first-child, :last-child. Rules whose selectors hold anything else, such as :hover, do not apply. Media
queries are answered for a screen of VIEWPORT pixels without other preferences.
"""

from __future__ import annotations

import operator
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

VIEWPORT = {"width": 1280.0, "height": 800.0}
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
PART = re.compile(r"""[{};]|(?:[^{};"'\\]+|\\.|"(?:[^"\\]|\\.)*(?:"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)|\\\Z)+""", re.S)
VALUES = {
    "display": set("none block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group table-caption list-item contents flow flow-root run-in ruby math -webkit-box -webkit-inline-box -webkit-flex -ms-flexbox inherit initial unset revert revert-layer".split()),
    "visibility": set("visible hidden collapse inherit initial unset revert revert-layer".split()),
}
IDENT = r"(?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\.)+"
SIMPLE = re.compile(rf"\*|(?P<tag>{IDENT})|\.(?P<cls>{IDENT})|#(?P<id>{IDENT})|\[\s*(?P<attr>{IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*[iIsS]?\s*)?\]|:(?P<fn>not|is|where)\((?P<arg>[^()]*)\)|:(?P<pseudo>root|first-child|last-child)(?![\w(-])", re.I)
COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)
FEATURE = re.compile(r"\(\s*(min-|max-)?(width|height)\s*(:|[<>]=?)\s*(\d+(?:\.\d*)?|\.\d+)\s*(px|em|rem)\s*\)\Z")
COMPARED = {"min-": operator.ge, "max-": operator.le, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, ":": operator.eq}
HOLDS = {"(orientation: landscape)", "(hover: hover)", "(hover)", "(pointer: fine)", "(color)", "(prefers-color-scheme: light)", "(prefers-reduced-motion: no-preference)"}

Value = tuple[bool, str]  # important, value


def declarations(body: str) -> dict[str, Value]:
    """The display and visibility that a list of declarations sets; invalid ones are passed over."""
    found: dict[str, Value] = {}
    for part in body.lower().split(";"):
        name, _, value = part.partition(":")
        name = name.strip()
        if name not in VALUES:
            continue
        value, mark, important = value.partition("!")
        words = value.split()
        if not words or not all(v in VALUES[name] for v in words) or mark and important.strip() != "important":
            continue
        if mark or not found.get(name, (False, ""))[0]:
            found[name] = (bool(mark), " ".join(words))
    return found


def on_screen(query: str) -> bool:
    """Whether one of the media queries of a list holds."""
    return not query.strip() or any(_holds(q) for q in query.lower().split(","))


def _holds(query: str) -> bool:
    query = re.sub(r"\s*:\s*", ": ", " ".join(query.split()))
    negated, query = query.startswith("not "), re.sub(r"^(not|only) ", "", query)
    holds = True
    for part in re.split(r" and ", query):
        m = FEATURE.match(part)
        if m:
            size = float(m[4]) * (1 if m[5] == "px" else 16)
            holds &= COMPARED[m[1] or m[3]](VIEWPORT[m[2]], size)
        else:
            holds &= part in ("all", "screen") or part in HOLDS
    return holds != negated


def rules_of(sheet: str) -> Iterator[tuple[str, str, bool]]:
    """(selectors, declarations, whether in a layer) of the rules that count on a screen, in order."""
    open_blocks: list[tuple[str, bool, bool, bool]] = []  # kind, applies, in a layer, of nested rules
    head, bodies = "", []
    for part in PART.findall(COMMENT.sub(" ", sheet.replace("<!--", " ").replace("-->", " "))):
        if part == "{":
            name = head.strip()
            _, applies, layer, _ = open_blocks[-1] if open_blocks else ("", True, False, False)
            in_rule = bool(open_blocks) and open_blocks[-1][0] != "@"
            if name.startswith("@"):
                word, _, rest = name[1:].partition(" ") if not name.lower().startswith("@media(") else ("media", "", name[6:])
                word = word.lower()
                own = word == "media" and on_screen(rest) or word == "layer" or word == "supports" and not rest.strip().lower().startswith("not")
                open_blocks.append(("@", applies and own and not in_rule, layer or word == "layer", True))
            else:
                open_blocks.append((name or "?", applies and not in_rule, layer, False))
                bodies.append("")
            head = ""
        elif part == "}":
            if open_blocks:
                kind, applies, layer, _ = open_blocks.pop()
                if kind != "@":
                    body = bodies.pop() + head
                    if applies:
                        yield kind, body, layer
            head = ""
        elif part == ";":
            if open_blocks and open_blocks[-1][0] != "@":
                bodies[-1] += head + ";"
            head = ""
        else:
            head += part
    if open_blocks and open_blocks[-1][0] != "@" and open_blocks[-1][1]:  # the end of a sheet closes its blocks
        yield open_blocks[-1][0], bodies[-1] + head, open_blocks[-1][2]


def _name(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] and 0 < int(m[1], 16) < 0x110000 else m[2] or "", text)


def _split(selectors: str) -> list[str]:
    """The selectors of a list, cut at the commas outside brackets."""
    found, depth = [""], 0
    for part in re.findall(r"\\.|[,()\[\]]|[^\\,()\[\]]+", selectors, re.S):
        depth += (part in ("(", "[")) - (part in (")", "]"))
        if part == "," and depth <= 0:
            found.append("")
        else:
            found[-1] += part
    return found


def selector(text: str) -> tuple[list, tuple[int, int, int]] | None:
    """[(combinator before, tests)] from left to right, and the specificity; None where it is not understood."""
    text, at = text.strip(), 0
    steps: list[tuple[str, list]] = [("", [])]
    weight = [0, 0, 0]
    while at < len(text):
        m = SIMPLE.match(text, at)
        if m is None:
            c = COMBINATOR.match(text, at)
            if c is None or not steps[-1][1]:
                return None
            steps.append((c[1] or " ", []))
            at = c.end()
            continue
        if m["tag"] and steps[-1][1]:
            return None
        if m["fn"]:
            inner = [selector(s) for s in _split(m["arg"])]
            if not inner or any(s is None or len(s[0]) != 1 for s in inner):
                return None
            test = (m["fn"].lower() == "not", "any", [s[0][0][1] for s in inner])
            if m["fn"].lower() != "where":
                weight = [a + b for a, b in zip(weight, max(s[1] for s in inner))]
        elif m["tag"]:
            test, weight[2] = (False, "tag", _name(m["tag"]).lower()), weight[2] + 1
        elif m["id"]:
            test, weight[0] = (False, "id", _name(m["id"])), weight[0] + 1
        elif m["cls"] or m["attr"] or m["pseudo"]:
            weight[1] += 1
            if m["cls"]:
                test = (False, "class", _name(m["cls"]))
            elif m["attr"]:
                test = (False, "attribute", (_name(m["attr"]).lower(), m["op"], _name((m["val"] or "").strip("\"'"))))
            else:
                test = (False, m["pseudo"].lower(), None)
        else:
            test = (False, "all", None)
        steps[-1][1].append(test)
        at = m.end()
    return (steps, tuple(weight)) if steps[-1][1] else None


@dataclass(eq=False)
class Node:
    """An element with its place among the others."""

    element: object
    parent: Node | None
    before: Node | None
    last: bool
    classes: frozenset[str]


def _attribute(value: str | None, op: str | None, want: str) -> bool:
    if value is None or op is None:
        return value is not None
    if op == "=":
        return value == want
    if op == "~=":
        return want in value.split()
    if op == "|=":
        return value == want or value.startswith(want + "-")
    return bool(want) and (value.startswith(want) if op == "^=" else value.endswith(want) if op == "$=" else want in value)


def _meets(node: Node, tests: list) -> bool:
    e = node.element
    for negated, kind, want in tests:
        if kind == "any":
            ok = any(_meets(node, t) for t in want)
        elif kind == "tag":
            ok = e.name == want
        elif kind == "class":
            ok = want in node.classes
        elif kind == "id":
            ok = e.attributes.get("id") == want
        elif kind == "attribute":
            ok = _attribute(e.attributes.get(want[0]), want[1], want[2])
        elif kind == "root":
            ok = node.parent is None
        elif kind == "first-child":
            ok = node.before is None
        elif kind == "last-child":
            ok = node.last
        else:
            ok = True
        if ok == negated:
            return False
    return True


def _matches(node: Node, steps: list, i: int, known: dict) -> bool:
    """Whether the steps up to the i-th lead to the node; each pair is looked into once."""
    key = (id(steps), i, node)
    if key not in known:
        known[key] = False
        if _meets(node, steps[i][1]):
            how, found = steps[i][0], i == 0
            if how in (">", "+"):
                other = node.parent if how == ">" else node.before
                found = other is not None and _matches(other, steps, i - 1, known)
            elif how:
                found = _leads(node, steps, i - 1, how, known)
            known[key] = found
    return known[key]


def _leads(node: Node, steps: list, i: int, how: str, known: dict) -> bool:
    passed, found = [], False
    while (node := node.parent if how == " " else node.before) is not None:
        key = (id(steps), i, how, node)
        if key in known:
            found = known[key]
            break
        passed.append(key)
        if _matches(node, steps, i, known):
            found = True
            break
    for key in passed:  # whether the node or one before it matches
        known[key] = found
    return found


def apply_sheets(root, sheets: list[str]) -> None:
    """Give each element's ``styles`` the display and visibility that the sheets set."""
    by_mark: dict[tuple[str, str], list] = defaultdict(list)
    order = 0
    for sheet in sheets:
        for selectors, body, layer in rules_of(sheet):
            found = declarations(body)
            if not found:
                continue
            read = [selector(s) for s in _split(selectors)]
            if any(s is None for s in read) and len(read) == 1:
                continue
            order += 1
            for s in filter(None, read):
                steps, weight = s
                tests = {kind: want for negated, kind, want in steps[-1][1] if not negated and kind in ("id", "class", "tag")}
                mark = next(((kind, tests[kind]) for kind in ("id", "class", "tag") if kind in tests), ("", ""))
                by_mark[mark].append((steps, weight, order, layer, found))
    if not by_mark:
        return
    known: dict = {}
    waiting = [Node(root, None, None, True, frozenset(root.attributes.get("class", "").split()))]
    while waiting:
        node = waiting.pop()
        e = node.element
        marks = [("", ""), ("tag", e.name), ("id", e.attributes.get("id")), *(("class", c) for c in node.classes)]
        best: dict[str, tuple] = {}
        for mark in marks:
            for steps, weight, n, layer, found in by_mark.get(mark, ()):
                if _matches(node, steps, len(steps) - 1, known):
                    for name, (important, value) in found.items():
                        rank = (important, layer if important else not layer, weight, n)
                        if name not in best or best[name][0] <= rank:
                            best[name] = (rank, (important, value))
        e.styles = {name: value for name, (_, value) in best.items()}
        before, children = None, [c for c in e.children if not isinstance(c, str)]
        for c in children:
            before = Node(c, node, before, c is children[-1], frozenset(c.attributes.get("class", "").split()))
            waiting.append(before)
