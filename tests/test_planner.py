import pytest

from quiverlake.plans import planner as p


@pytest.mark.parametrize(
    ("case", "layout", "degree"),
    [
        ((128, 1, 20, 1.0, 23), (447, 18), 24), ((128, 1, 12, 0.0, 28), (199, 7), 28), ((128, 1, 12, 0.0, 23), (191, 8), 23),
        ((100, 1, 18, 1.0, 25), (523, 20), 26), ((96, 4, 60, 1.0, 31), (255, 8), 31), ((64, 4, 16, 1.0, 8), (127, 14), 9),
        ((64, 4, 16, 0.5, 8), (106, 11), 9), ((64, 4, 16, 0.0, 8), (89, 9), 9),
    ],
)
def test_layouts(case, layout, degree):
    assert p.page_layout(*case) == layout
    assert p.recommended_degree(*case) == degree


@pytest.mark.parametrize(("gb", "lsh", "pq"), [(3.6, 1.0, 1.0), (2.4, 0.6426, 1.0), (1.2, 0.0, 0.412), (0.06, 0.0, 0.0), (0.05, -1, -1)])
def test_cache_shares(gb, lsh, pq):
    a, b = p.cache_shares(gb, 20, 10**8)
    assert abs(a - lsh) < 0.002 and abs(b - pq) < 0.002


def test_chunks():
    assert p.chunk_offsets(10, 4) == [0, 3, 6, 8, 10] and p.chunk_offsets(7, 3) == [0, 3, 5, 7]
    assert [b - a for a, b in zip(p.chunk_offsets(100, 18), p.chunk_offsets(100, 18)[1:])] == [6] * 10 + [5] * 8
    assert p.pq_chunks(0.003, 10**5, 128) == 32 and p.pq_chunks(2.2, 10**8, 128) == 20
    assert p.page_layout(5000, 4, 16, 1.0, 8) == (0, 0)
    assert p.cache_plan(10, 10, 4) == "all" and p.cache_plan(1, 1000, 200) == "map" and p.cache_plan(400, 1000, 200) == "array"
