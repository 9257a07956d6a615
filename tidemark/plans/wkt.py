"""A reader and writer of well-known text: KEYWORD[argument, ...], arguments being quoted, bare, or nodes themselves."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(r"""\s*(?:"((?:[^"]|"")*)"|'([^']*)'|[“]([^”"]*)[”"]|([\[\](),])|([^\[\](),"'“]+))""")


@dataclass
class Node:
    keyword: str
    args: list[str | Node] = field(default_factory=list)

    def every(self, keyword: str) -> Iterator[Node]:
        """Nodes of a keyword in the order of the text, this one included."""
        if self.keyword == keyword:
            yield self
        for a in self.args:
            if isinstance(a, Node):
                yield from a.every(keyword)

    def children(self) -> list[Node]:
        return [a for a in self.args if isinstance(a, Node)]

    def first(self, keyword: str) -> Node:
        found = next(self.every(keyword), None)
        if found is None:
            raise ValueError(f"no {keyword} in {self.keyword}")
        return found

    def name(self) -> str:
        return next((a for a in self.args if isinstance(a, str)), "")


def parse(text: str) -> Node:
    """The first node of a text; empty arguments are passed over."""
    root, at = Node(""), 0
    stack, word = [root], None
    while at < len(text) and (m := _TOKEN.match(text, at)):
        at = m.end()
        quoted, mark, bare = next((g for g in m.group(1, 2, 3) if g is not None), None), m[4], m[5]
        if mark in ("[", "("):
            node = Node(word or "")
            stack[-1].args.append(node)
            stack.append(node)
            word = None
            continue
        if word:
            stack[-1].args.append(word)
            word = None
        if quoted is not None:
            stack[-1].args.append(quoted.replace('""', '"'))
        elif bare is not None:
            word = bare.strip()
        elif mark in ("]", ")") and len(stack) > 1:
            stack.pop()
            if len(stack) == 1:
                return root.args[0]
    if root.args and isinstance(root.args[0], Node):
        return root.args[0]
    raise ValueError(f"no node in {text[:80]!r}")


def pretty(text: str, indent: int = 2) -> str:
    """The same text with each nested node on a line of its own, indented by its depth."""
    out, depth, quoted = [], 0, False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        if not quoted and c == "[":
            depth += 1
        elif not quoted and c == "]":
            depth -= 1
        out.append(c)
        if c == "," and not quoted and re.match(r"\s*[A-Z]+\[", text[i + 1 :]):
            out.append("\n" + " " * indent * depth)
    return "".join(out)


def is_compound(text: str) -> bool:
    """Whether a text is of two systems, of which the second is vertical and the first is not."""
    try:
        node = parse(text)
    except ValueError:
        return False
    parts = [n for n in node.children() if n.keyword.endswith("CRS")]
    return node.keyword == "COMPOUNDCRS" and len(parts) == 2 and parts[1].keyword == "VERTCRS" and parts[0].keyword != "VERTCRS"
