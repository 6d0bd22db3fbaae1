"""Alignment of lines: the same as by the whole table, in memory that grows with the lines."""

import random
import tracemalloc

from bazaarlake.llm import html


def by_table(x, y):
    table = [[0] * (len(y) + 1)]
    for p in x:
        row, above = [0], table[-1]
        for j, q in enumerate(y):
            row.append(above[j] + 1 if p == q else max(above[j + 1], row[j]))
        table.append(row)
    out, i, j = [], len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_same_places_as_by_the_table():
    random.seed(3)
    for case in range(1500):
        kinds = random.randint(1, 12)
        x, y = ([random.randrange(kinds) for _ in range(random.randint(1, 40))] for _ in "xy")
        assert list(html.aligned(x, y)) == by_table(x, y), (x, y)


def test_long_pages():
    lines = list(range(20_000))
    tracemalloc.start()
    assert html.shared_lines([-1, *lines, -2], [-3, *lines, -4]) == set(range(1, 20_001))
    assert html.shared_lines([-1, *[5] * 20_000, -2], [-3, *[5] * 20_000, -4]) == set(range(1, 20_001))
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
