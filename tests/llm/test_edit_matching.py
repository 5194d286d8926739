"""Edit matching of repetitive items and texts beside the full distance table."""

from __future__ import annotations

import random
import time

from quarryline.llm.decontaminate import Matcher, budget_of


def least_edits(item, text):
    """Fewest edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_every_item_within_its_budget_is_found():
    r = random.Random(4)
    for _ in range(60):
        letters = r.choice(["a", "ab", "abc", "abcdefgh"])
        unit = "".join(r.choice(letters) for _ in range(r.randint(1, 30)))
        items = [(unit * 200)[: r.randint(40, 150)], "".join(r.choice(letters) for _ in range(r.randint(60, 120)))]
        text = "".join(r.choice(letters) for _ in range(60))
        for item in items:
            copy = list(item)
            for _ in range(r.randint(0, budget_of(item) + 2)):
                copy[r.randrange(len(copy))] = r.choice(letters + "z")
            text += "".join(copy) + "".join(r.choice(letters) for _ in range(r.randint(0, 200)))
        matcher = Matcher(list(enumerate(items)))
        found = {i: (edits, start, end) for i, edits, start, end in matcher.matches(matcher.build(), text)}
        for i, item in enumerate(items):
            least = least_edits(item, text)
            assert (i in found) == (least <= budget_of(item))
            if i in found:
                edits, start, end = found[i]
                assert edits == least == least_edits(item, text[start:end])


def test_a_repetitive_item_ends_soon():
    started = time.time()
    for item, text in (("a" * 100_000, "a" * 50_000), ("ab" * 20_000, "ab" * 40_000), ("a" * 3_000, ("a" * 2_990 + "b") * 40)):
        matcher = Matcher([(7, item)])
        list(matcher.matches(matcher.build(), text))
    assert time.time() - started < 30
