"""Every template found alone, repeated, cut and between its own words, against an alignment of all windows."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from neurolake.llm import licenses

AROUND = "the files of this software and the license of the work are in any part of the copyright notice and shall be for all of this"


def found(texts):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    return [{x["license"]: x for x in f} for _, f in scanner.scan(pa.array(texts))]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_template_in_all_forms(name):
    rng = random.Random(name)
    t = licenses.TEMPLATES[name]
    words = t.split()
    cut = [w for i, w in enumerate(words) if len(words) < 12 or i not in set(rng.sample(range(len(words)), len(words) // 12))]
    shuffled = words[:]
    while len(words) > 8 and sum(a == b for a, b in zip(shuffled, words)) > 2:
        rng.shuffle(shuffled)
    forms = [t, t.upper(), f"{AROUND} {t} {AROUND}", f"{AROUND} {t} {t} {AROUND}", f"{t} the {t} of {t}", f"{AROUND} {' '.join(cut)} and {' '.join(cut)} {AROUND}", "lorem ipsum " * 3000 + t + " dolor sit " * 3000]
    got = found(forms)
    assert [name in g for g in got] == [True] * len(forms)
    assert all(g[name]["coverage"] == 1.0 for g in got[:5]) and got[6][name]["first_word"] == 6000
    if len(words) > 12:
        assert name not in found([" ".join(words[: len(words) // 2])])[0] and name not in found([" ".join(shuffled)])[0]


def test_best_place_is_that_of_the_best_window():
    """Brute force: the alignment of every window of up to twice the template's words."""
    rng = random.Random(5)
    name = "gpl-3-line"
    want = [w.decode() for w in licenses._WORD.findall(licenses.TEMPLATES[name].encode().lower())]
    for _ in range(12):
        words = [rng.choice([*want, *AROUND.split()]) for _ in range(20)]
        at = rng.randrange(20)
        words[at:at] = [w for w in want if rng.random() < 0.93]
        number = {w: i for i, w in enumerate(dict.fromkeys([*want, *words]))}
        best = 0
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + 2 * len(want)) + 1):
                got = licenses.align([number[w] for w in words[a:b]], [number[w] for w in want])
                if got and len(got) / (got[-1][0] - got[0][0] + 1) >= licenses.DENSITY:
                    best = max(best, len(got))
        mine = found([" ".join(words)])[0].get(name)
        if best >= licenses.COVERAGE * len(want) + 1:
            assert mine is not None and mine["matched"] >= best - 1
        if mine is not None:
            assert best >= licenses.COVERAGE * len(want) - 1e-9
