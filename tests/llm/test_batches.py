"""What tasks leave behind in a worker that lives on."""

from __future__ import annotations

import os

import pytest

from barloom.llm import batches, components, decontaminate, line_dedup, quality, sentencepiece, simhash


def resident_mb() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def greedy(rows):
    # every second piece stays until after the others, so that freed memory lies below memory in use
    held = [bytes(2000) for _ in range(100_000)]
    rest = held[-1:]
    del held
    yield from rows
    pin.append(rest)


pin: list = []


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="memory is read from /proc")
def test_a_task_gives_its_memory_back():
    batches.give_back()
    before = resident_mb()
    assert list(batches.lean(greedy)(iter([1, 2]))) == [1, 2]
    assert resident_mb() - before < 60


def test_memory_is_given_back_by_tasks_that_fail_or_are_left(monkeypatch):
    calls = []
    monkeypatch.setattr(batches, "give_back", lambda: calls.append(1))

    def fails(rows):
        yield from rows
        raise ValueError

    with pytest.raises(ValueError):
        list(batches.lean(fails)(iter([1])))
    left = batches.lean(lambda rows: (r for r in rows))(iter([1, 2]))
    assert next(left) == 1
    left.close()
    assert calls == [1, 1]


@pytest.mark.parametrize("module", [components, decontaminate, line_dedup, quality, sentencepiece, simhash])
def test_every_task_of_the_pipeline_does(module):
    with open(module.__file__) as f:
        source = f.read()
    assert source.count("mapInArrow(") == source.count("mapInArrow(lean(")
