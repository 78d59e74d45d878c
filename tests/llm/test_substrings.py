import random

import pytest

from brute import cut_repeats
from tidemark.llm import substrings


def _rows():
    rng = random.Random(3)
    rows = [(i, None if i == 3 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(50)]
    return rows + [(7, rows[7][1]), (70, rows[9][1] + " " + rows[9][1]), (71, "a " * 120), (72, ""), (None, "A b c")]


@pytest.mark.parametrize("length", [2, 5, 13])
def test_equals_brute_force(docs, length):
    rows = _rows()
    got = sorted(map(tuple, substrings.digests(docs(rows, tid=1, kept="x"), length).collect()), key=repr)
    assert got == cut_repeats(rows, length)


def test_remove_keeps_columns(docs):
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(1, "one  two\n" + shared), (2, shared + " three"), (3, "clean   text"), (4, None)]
    got = {r.doc_id: r.text for r in substrings.remove(docs(rows, tid=5, n_removed="n", kept="k", cand=1), 50).collect()}
    assert got == {1: "one two", 2: "three", 3: "clean   text", 4: None}
    assert substrings.remove(docs([], tid=1), 50).count() == 0


def _opposites(size):
    """Two different words of ``size`` letters on which polynomial hashes modulo powers of two agree."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [64, 65, 1024, 8192])
def test_long_words_that_differ(docs, size):
    x, y = _opposites(size)
    shared = " ".join(f"s{i}" for i in range(34))
    rows = [(1, f"{shared} {x}"), (2, f"{shared} {y}"), (3, f"{shared} {x} {y}"), (4, " ".join(_opposites(64)[0]))]
    for some in (rows[:2], rows):
        assert sorted(map(tuple, substrings.digests(docs(some), 35).collect()), key=repr) == cut_repeats(some, 35)


def test_long_runs_of_words_that_mirror_each_other(docs):
    x, y = (" ".join(w) for w in _opposites(2048))
    rows = [(1, x), (2, y), (3, "z " + x)]
    assert sorted(map(tuple, substrings.digests(docs(rows), 1500).collect()), key=repr) == cut_repeats(rows, 1500)


@pytest.mark.parametrize("length", [1, 3, 17, 40, 90])
def test_levels(docs, length, monkeypatch):
    """From one word to several doublings, also with more cells than partitions and packs of a few entries."""
    from tidemark.llm import exchange

    lengths = substrings.levels(length)
    assert lengths[-1] == length and lengths[0] <= 16 and all(a <= b <= 2 * a for a, b in zip(lengths, lengths[1:]))
    monkeypatch.setattr(exchange, "MOST", 5)
    rng = random.Random(length)
    word = lambda n: [rng.choice("abcdefghijklmnop") + rng.choice("qrstuvw") for _ in range(n)]
    common = [word(rng.randint(length // 2, length * 3)) for _ in range(6)]
    rows = [(i, " ".join(word(rng.randint(0, 60)) + rng.choice(common)[rng.randint(0, length) :] + word(rng.randint(0, 9)))) for i in range(60)]
    rows += [(100, " ".join(common[0] * 3)), (101, " ".join(word(300))), (102, None)]
    got = sorted(map(tuple, substrings.digests(docs(rows), length).collect()), key=repr)
    assert got == cut_repeats(rows, length)


def test_nothing_survives_a_level(docs):
    """All that repeats is shorter than the second of the longer levels."""
    rng = random.Random(1)
    shared = [f"s{i}" for i in range(45)]
    rows = [(i, " ".join([*(f"x{i}_{k}" for k in range(150)), *shared, *(f"y{i}_{k}" for k in range(rng.randint(100, 200)))])) for i in range(5)]
    got = sorted(map(tuple, substrings.digests(docs(rows), 200).collect()), key=repr)
    assert got == cut_repeats(rows, 200) and all(r[2] == 0 for r in got)
