"""Paths are checked by what they promise: every matching row lies within its path."""

import itertools

import pytest

from keyloom.engine.catalog import TableInfo
from keyloom.errors import MalformedQuery
from keyloom.plans import access_path as P
from keyloom.plans import ast as A
from keyloom.plans.expressions import fold
from keyloom.plans.parser import parse

PARTS = TableInfo("part", "", "p_partkey", {"p_partkey": "I64", "p_size": "I64", "p_brand": "VARCHAR", "p_weight": "I64"}, indexes={"p_size": "active"})
#: One condition of each kind of path: key, index, and neither.
LEAVES = ["p_partkey == 4", "p_partkey > 2", "p_partkey >= 3", "p_partkey < 6", "p_partkey <= 1", "p_size == 5", "p_size > 4", "p_size <= 2", "p_weight == 3", "p_partkey != 2", "p_weight < p_size"]
ROWS = [{"p_partkey": k, "p_size": s, "p_weight": w} for k, s, w in itertools.product(range(8), [None, *range(7)], [None, 3, 4])]


def path(where):
    return P.path_of(fold(parse(f"SELECT * FROM part WHERE {where};").where), PARTS)


def value(e, row):
    """Truth of a predicate on a row, three-valued."""
    if isinstance(e, A.Literal):
        return e.value
    if isinstance(e, A.Name):
        return row[e.name]
    a, b = value(e.left, row), value(e.right, row)
    if e.op == "AND":
        return False if False in (a, b) else None if None in (a, b) else True
    if e.op == "OR":
        return True if True in (a, b) else None if None in (a, b) else False
    if e.op in ("==", "!="):
        return (a == b) == (e.op == "==")
    return None if None in (a, b) else {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op]


def covers(p, row):
    if isinstance(p, P.Full):
        return True
    if isinstance(p, P.Merge):
        sides = covers(p.left, row), covers(p.right, row)
        return any(sides) if p.kind == "Union" else all(sides)
    x = row[p.column]
    return x is not None and (x == p.value if isinstance(p, P.Point) else p.holds(x))


def columns(p):
    return columns(p.left) | columns(p.right) if isinstance(p, P.Merge) else set() if isinstance(p, P.Full) else {p.column}


@pytest.mark.parametrize("op", ["AND", "OR"])
def test_every_pair_of_conditions_is_covered_and_uses_the_key_or_the_index(op):
    for a, b in itertools.product(LEAVES, LEAVES):
        where = f"{a} {op} {b}"
        e, p = fold(parse(f"SELECT * FROM part WHERE {where};").where), path(where)
        assert all(covers(p, r) for r in ROWS if value(e, r)), where
        assert columns(p) <= {"p_partkey", "p_size"}
        led = [not isinstance(path(x), P.Full) for x in (a, b)]
        assert isinstance(p, P.Full) == (not any(led) if op == "AND" else not all(led)), where


def test_nested_conditions_are_covered():
    for a, b, c in itertools.product(LEAVES[:9], LEAVES[3:10], LEAVES[4:8]):
        for where in (f"({a} OR {b}) AND {c}", f"({a} AND {b}) OR {c}", f"({a} OR {b}) AND ({c} OR {a})"):
            e, p = fold(parse(f"SELECT * FROM part WHERE {where};").where), path(where)
            assert all(covers(p, r) for r in ROWS if value(e, r)), where


def test_a_conjunction_takes_the_narrower_side():
    for point in ("p_partkey == 4", "p_size == 5"):
        for other in ("p_partkey > 2", "p_size <= 2", "p_weight == 3"):
            for where in (f"{point} AND {other}", f"{other} AND {point}"):
                assert isinstance(path(where), P.Point) and str(path(where)) == str(path(point))
    assert path("p_size == 5 AND p_partkey == 4").primary


def test_only_a_column_against_a_literal_makes_a_path():
    for where in ("p_partkey - 1 == 2", "7 == p_partkey", "p_partkey != 7", "p_size == p_partkey", "p_brand == \"x\"", "-p_size > 3"):
        assert isinstance(path(where), P.Full), where
    assert str(path("p_size >= 2 * 3 AND p_size < 20 - 1")) == "Range p_size [6, 19)"


def test_meeting_ranges_hold_what_both_hold():
    ends = [None, 2, 4]
    ranges = [P.Range("p_size", low, low_in, high, high_in) for low, high in itertools.product(ends, ends) for low_in, high_in in itertools.product([False, True], repeat=2)]
    held = lambda r: {x / 2 for x in range(0, 14) if r.holds(x / 2)}
    for a, b in itertools.product(ranges, ranges):
        both = held(a) & held(b)
        try:
            assert held(a.meet(b)) == both == held(b.meet(a))
        except MalformedQuery:
            assert not both


def test_a_contradiction_is_a_path_and_no_error():
    assert str(path("p_partkey > 50 AND p_partkey < 40")) == "Intersection"
    assert str(path("p_partkey == 5 AND p_partkey == 6")) == "Exact primary (5)"


def lines(rest, columns="*"):
    s = parse(f"SELECT {columns} FROM part {rest};")
    return P.explain(type(s)(s.table, s.columns, fold(s.where), s.sort, s.limit), PARTS)


@pytest.mark.parametrize(("rest", "first"), [
    ("WHERE p_partkey > 3 ORDER BY p_partkey", "Filter (Query)"), ("WHERE p_partkey > 3 ORDER BY p_partkey DESC", "Reverse"), ("WHERE p_size > 3 ORDER BY p_size", "Filter (Query)"),
    ("ORDER BY p_weight DESC", "Full Sort (p_weight DESC)"), ("LIMIT 9", "Limit (9)"), ("ORDER BY p_brand LIMIT 9", "Top N Sort (p_brand ASC LIMIT 9)"), ("WHERE p_size > 3 ORDER BY p_partkey", "Full Sort (p_partkey ASC)"),
])
def test_a_sort_is_shown_where_the_path_does_not_give_the_order(rest, first):
    assert lines(rest)[0] == first


def test_lines_go_from_the_top_to_the_leaves():
    assert lines("WHERE p_partkey == 3 OR (p_size > 1 AND p_partkey < 9)") == ["Filter (Query)", "Union", " Intersection", "  Range p_partkey (_, 9)", "  Range p_size (1, _)", " Exact primary (3)"]
    assert lines("WHERE p_partkey > 1", "p_brand")[0] == "Projection (p_brand)"
    assert lines("") == ["Full Scan"]
