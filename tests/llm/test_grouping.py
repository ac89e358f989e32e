import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factline.llm.grouping import suffix_orders


def orders(strings):
    symbols = np.concatenate([np.append(np.array(s, np.int64) + 1, 0) for s in strings])
    base = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])))
    got = suffix_orders(symbols, base)
    return [(got[a:b] - a).tolist() for a, b in zip(base[:-1], base[1:], strict=True)]


def naive(s):
    s = [x + 1 for x in s] + [0]
    return sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=8))
def test_suffix_orders_equal_sorting(strings):
    assert orders(strings) == [naive(s) for s in strings]


@pytest.mark.parametrize("word", ["", "a", "aaaaaaaa", "abababab", "banana", "mississippi", "zyxwvu", "abcabcabd"])
def test_words(word):
    assert orders([list(word.encode())]) == [naive(list(word.encode()))]
