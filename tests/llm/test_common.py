"""What a Python worker holds between its tasks."""

import functools

from pagetab.llm import common


def test_a_task_lets_go_of_what_it_does_not_use(monkeypatch):
    monkeypatch.setattr(common, "_HELD", [])
    first, second = (common.held(functools.lru_cache(maxsize=2)(lambda x: [x])) for _ in range(2))
    run = lambda batches: (first(b) for b in batches)
    kept = first(1)
    second(1)
    assert list(common.tidied(run, uses=(first,))([1, 2])) == [[1], [2]]
    assert first(1) is kept and not second.cache_info().currsize
    second(1)
    assert list(common.tidied(lambda batches: batches)([])) == []
    assert not first.cache_info().currsize and not second.cache_info().currsize
