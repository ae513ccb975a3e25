"""Shingle hashes against the shingles themselves, on texts of few distinct words."""

import itertools

import numpy as np
import pytest

from quern.llm import shingles


@pytest.mark.parametrize("words", ["ab", "abc", "01", ("yes", "no", "n/a")])
def test_shingles_over_few_words_are_told_apart(words):
    texts = [" ".join(t) for n in range(1, shingles.WIDTH + 1) for t in itertools.product(words, repeat=n)]
    found = [shingles.shingle_set(t) for t in texts]
    assert all(len(s) == 1 for s in found)
    assert len({int(s[0]) for s in found}) == len(texts)


def test_a_long_text_over_few_words_has_the_shingles_that_brute_force_finds():
    rng = np.random.default_rng(5)
    for kinds in (2, 3, 4):
        words = rng.integers(0, kinds, 3000).tolist()
        brute = {tuple(words[i : i + shingles.WIDTH]) for i in range(len(words) - shingles.WIDTH + 1)}
        assert len(shingles.shingle_set(" ".join(map(str, words)))) == len(brute)


def test_signed_sums_of_the_multipliers():
    for signs in itertools.product((-1, 0, 1), repeat=shingles.WIDTH):
        if any(signs):
            assert sum(s * int(m) for s, m in zip(signs, shingles._PLACES, strict=True)) % 2**6
