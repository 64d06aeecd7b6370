import pytest

from gridloom.plans.selection import SelectionError, axes_to_collapse, check_ordered_selection, check_selection, dense_enough, map_to_chunks, plan_axis, reduce_selection


def test_extents():
    assert check_selection([6, 5, 4], [None, [5], [3, 4]]) == (6, 1, 2)
    assert check_selection([15], [[14, 5, 8]], [[2, 0, 3]]) == (5,)
    assert check_selection([-1], [[3e9]]) == (1,)
    assert check_selection([3, 2]) == (3, 2)


@pytest.mark.parametrize("bad", [0, None, float("nan"), float("inf"), -float("inf"), 16])
def test_bad_starts(bad):
    with pytest.raises(SelectionError):
        check_selection([15], [[bad]])


def test_bad_counts():
    for counts in ([-1], [13], [float("nan")]):
        with pytest.raises(SelectionError):
            check_selection([15], [[4]], [counts])
    with pytest.raises(SelectionError):
        check_selection([15], [None], [[1]])
    with pytest.raises(SelectionError):
        check_ordered_selection([15], [[5, 4]])
    with pytest.raises(SelectionError):
        check_ordered_selection([15], [[4, 5]], [[2, 1]])


def test_runs():
    assert reduce_selection([15], [[2, 3, 4, 5, 7, 8, 9, 10]]) == [[(2, 4), (7, 4)]]
    assert reduce_selection([15], [[2, 5, 5, 6, 11, 11]], [[3, 0, 1, 4, 0, 5]]) == [[(2, 8), (11, 5)]]
    assert reduce_selection([15], [[2, 4]]) is None
    big = 3_000_000_000
    assert reduce_selection([-1], [range(big + 1, big + 11)]) == [[(big + 1, 10)]]


def test_chunks():
    assert map_to_chunks([range(13, 23)], [85], [10]) == [([8, 10], [1, 2])]
    assert map_to_chunks([[*range(1, 16), 49, 50, 51]], [85], [10]) == [([10, 15, 17, 18], [0, 1, 4, 5])]
    assert map_to_chunks([[6e9, 6e9 + 1]], [9_000_000_000], [3]) == [([1, 2], [1999999999, 2000000000])]
    assert map_to_chunks([None], [5], [2]) == [None]


def test_axis_plans():
    p = plan_axis(20, 5, [7, 3, 3, 20])
    assert p.order == (7, 3, 3, 20) and p.runs == ((3, 1), (7, 1), (20, 1)) and p.chunks == ((0, 2), (3, 1)) and p.extent == 4
    assert plan_axis(20, 5, [2, 9], [3, 1]).runs == ((2, 3), (9, 1)) and plan_axis(20, 5, [2, 9], [3, 1]).extent == 4
    with pytest.raises(SelectionError):
        plan_axis(20, 5, [9, 2], [1, 1])


def test_linear_or_random():
    assert dense_enough(None) and dense_enough([1, 6]) and not dense_enough([1, 11]) and not dense_enough([])


def test_collapse():
    assert axes_to_collapse([10, 6], [60]) == (0, 1)
    assert axes_to_collapse([10, 5, 7], [50, 7]) == (0, 1) and axes_to_collapse([10, 5, 7], [10, 35]) == (1, 2) and axes_to_collapse([10, 5, 7], [350]) == (0, 2)
    assert axes_to_collapse([15, 4, 7, 10], [15, 28, 10]) == (1, 2) and axes_to_collapse([10, 6], [10, 6]) is None
    for dim, new in (([10, 6], [11, 6]), ([10, 6], [5, 2, 6]), ([10, 6], [6, 10]), ([10, 5, 7], [10, 4, 7]), ([10, 5, 7], [10, 5, 7, 1]), ([10, 5, 7], [2, 25, 7]), ([10, 5, 7], [5, 10, 7])):
        with pytest.raises(SelectionError):
            axes_to_collapse(dim, new)
