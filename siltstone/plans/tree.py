"""Reading Catalyst's plan trees from Python."""

from __future__ import annotations

from collections.abc import Iterator

#: Expressions that hold a plan of their own.
WITH_PLAN = frozenset(("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "UnresolvedScalarSubquery", "UnresolvedExists", "UnresolvedListQuery"))


def kind(node) -> str:
    return node.getClass().getSimpleName()


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def nodes(plan) -> Iterator:
    """A plan's nodes, those of subqueries and of common table expressions too."""
    yield plan
    for child in (*items(plan.children()), *(x for x in items(plan.innerChildren()) if hasattr(x, "expressions"))):
        yield from nodes(child)
    for e in expressions(plan):
        if kind(e) in WITH_PLAN:
            yield from nodes(e.plan())


def expressions(plan) -> Iterator:
    """All expressions of one node."""
    todo = items(plan.expressions())
    while todo:
        e = todo.pop()
        yield e
        todo += items(e.children())
