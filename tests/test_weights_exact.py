import itertools
import random
import time
from fractions import Fraction

from bidloom.operators.multivalue import tokenize_weights


def brute(parts, need):
    """All choices of decimal commas, none left out; the nearest sum, the first of several."""
    best = None
    for some in itertools.combinations(range(len(parts) - 1), need):
        if any(b - a == 1 for a, b in itertools.pairwise(some)):
            continue
        out, k = [], 0
        while k < len(parts):
            step = 2 if k in some else 1
            out.append(",".join(parts[k : k + step]))
            k += step
        off = abs(sum(Fraction(x.replace(",", ".")) for x in out) - 100)
        if best is None or off < best[0]:
            best = (off, out)
    return best and best[1]


def test_many_marks():
    """17 marks, 5 of them decimal: 6188 choices, the right one with its first comma near the end."""
    parts = "3 4 3 4 3 4 3 9 5 9 5 9 5 9 5 34 5".split() + ["1"]
    want = brute(parts, 5)
    assert want is not None and sum(Fraction(x.replace(",", ".")) for x in want) < 120
    assert tokenize_weights(",".join(parts), len(parts) - 5) == want
    late = [*["1"] * 8, *"17 5 17 5 17 5 17 5 22".split(), "0"]
    assert tokenize_weights(",".join(late), len(late) - 5) == [*["1"] * 8, "17,5", "17,5", "17,5", "17,5", "22,0"] == brute(late, 5)


def test_against_every_choice():
    rng = random.Random(4)
    for _ in range(300):
        parts = [str(rng.choice([0, 2, 5, 10, 25, 30, 125, 333])) for _ in range(rng.randint(3, 10))]
        need = rng.randint(1, len(parts) - 1)
        want = brute(parts, need)
        if want is not None and not (len(parts) % 2 == 0 and need == len(parts) // 2):
            assert tokenize_weights(",".join(parts), len(parts) - need) == want


def test_long_fields_end():
    rng = random.Random(5)
    began = time.time()
    parts = [str(rng.randint(0, 40)) for _ in range(80)]
    assert len(tokenize_weights(",".join(parts), 55)) == 55
    assert time.time() - began < 20
