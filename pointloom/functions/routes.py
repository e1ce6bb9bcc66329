"""Routes with parameters: the best of many patterns for a path, as one expression.

Patterns are put in a trie of segments on the driver; the expression walks it: at each segment a fixed text comes
before a parameter (``:name``), and that before ``*``, which takes the rest; where a branch ends without a pattern
the next one is tried. So a path is compared with the children of the nodes it passes, not with every pattern.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The application's routes.
ROUTES = ["/", "/login", "/register", "/samples", "/profile", "/projects", "/project/:projectId", "/project/:projectId/:tab", "*"]
_FOUND = "struct<pattern:string,params:map<string,string>>"


@dataclass
class Node:
    fixed: dict[str, Node] = field(default_factory=dict)
    parameter: Node | None = None
    pattern: str | None = None
    names: tuple[str, ...] = ()
    rest: tuple[str, tuple[str, ...]] | None = None


def trie(patterns: list[str]) -> Node:
    """The trie of the patterns; of two that differ in the names of parameters alone the first counts."""
    root = Node()
    for pattern in patterns:
        node, names = root, []
        segments = [s for s in pattern.split("/") if s]
        for i, segment in enumerate(segments):
            if segment == "*":
                if i != len(segments) - 1:
                    raise ValueError(f"* must end a pattern: {pattern}")
                node.rest = node.rest or (pattern, tuple(names))
                break
            if segment.startswith(":"):
                names.append(segment[1:])
                node.parameter = node.parameter or Node()
                node = node.parameter
            else:
                node = node.fixed.setdefault(segment.lower(), Node())
        else:
            if node.pattern is None:
                node.pattern, node.names = pattern, tuple(names)
    return root


def best_route(path: Column, patterns: list[str] = ROUTES) -> Column:
    """struct(pattern, params) of the best pattern for a path, or null without one.

    Case does not matter in fixed segments; empty segments, as between or behind slashes, count for nothing; what ``*`` took is
    the parameter ``*``. A null path has no route.
    """
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    small = F.transform(segments, lambda s: F.lower(s))

    def found(pattern: str, values: list[tuple[str, Column]]) -> Column:
        pairs = [x for name, value in values for x in (F.lit(name), value)]
        return F.struct(F.lit(pattern).alias("pattern"), (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("params")).cast(_FOUND)

    def walk(node: Node, depth: int, taken: list[Column]) -> Column:
        tries = []
        if node.pattern is not None:
            tries.append(F.when(F.size(segments) == depth, found(node.pattern, list(zip(node.names, taken, strict=True)))))
        own = F.get(small, F.lit(depth))
        if node.fixed:
            choice = None
            for segment, child in node.fixed.items():
                choice = (F if choice is None else choice).when(own == segment, walk(child, depth + 1, taken))
            tries.append(choice)
        if node.parameter:
            tries.append(F.when(F.size(segments) > depth, walk(node.parameter, depth + 1, [*taken, F.get(segments, F.lit(depth))])))
        if node.rest:
            pattern, names = node.rest
            rest = F.array_join(F.slice(segments, depth + 1, F.greatest(F.size(segments) - depth, F.lit(0))), "/")
            tries.append(F.when(F.size(segments) >= depth, found(pattern, [*zip(names, taken, strict=True), ("*", rest)])))
        return F.coalesce(*tries)

    return F.when(path.isNotNull(), walk(trie(patterns), 0, []))
