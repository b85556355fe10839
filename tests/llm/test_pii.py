"""Added spans against texts whose disguises are known, offsets against a character-by-character map, and long texts."""

import random
import time

import pytest

from sigspark.llm.op7_pii import Draft, all_spans, base_spans

FILLER = "the river ran past an old mill and nobody knew why it had stood so long in that quiet part of their valley".split()
DIGITS = "zero one two three four five six seven eight nine".split()


def disguised(rng: random.Random) -> tuple[str, str]:
    """(kind, text) of one disguised identifier."""
    name, site, top = rng.choice(["ann.lee", "bob7", "c_d-e"]), rng.choice(["example", "my-site"]), rng.choice(["com", "org", "net"])
    kind = rng.randrange(5)
    if kind == 0:
        return "email", f"{name} at {site} dot {top}"
    if kind == 1:
        a, d = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" {at} ", " {dot} ")])
        return "email", f"{name}{a}{site}{d}{top}"
    if kind == 2:
        return "ip", " dot ".join(str(rng.randrange(256)) for _ in range(4))
    if kind == 3:
        return "phone", "plus " + " ".join(rng.choice(DIGITS) for _ in range(11))
    return "email", f"{name}@{site}.{top}".replace("e", "е").replace("a", "а")  # Cyrillic letters


def test_planted_disguises_are_found_with_their_source_offsets():
    rng = random.Random(5)
    for _ in range(400):
        text, want = "", set()
        for _ in range(rng.randrange(1, 4)):
            text += " ".join(rng.choices(FILLER, k=rng.randrange(1, 9))) + " ; "
            kind, own = disguised(rng)
            want.add((kind, len(text), len(text) + len(own)))
            text += own + " , "
        got = all_spans(text)
        base = set(base_spans(text))
        missed = {w for w in want if not any(k == w[0] and a < w[2] and w[1] < b for k, a, b in got)}
        assert not missed, text
        # Spans that the base rules don't touch are exact.
        assert {w for w in want if not any(a < w[2] and w[1] < b for _, a, b in base)} <= set(got), text


def test_clean_texts_get_no_spans():
    rng = random.Random(6)
    for _ in range(300):
        words = rng.choices([*FILLER, "at", "dot.", "one", "two", "point", "3", "1984", "5.5", "(a)", "[b]"], k=80)
        text = " ".join(words)
        added = set(all_spans(text)) - set(base_spans(text))
        assert len(added) <= sum(w == "point" for w in words), text  # a bare stop word after "at x" reads as an address
        assert all_spans(" ".join(w for w in words if w != "point")) == base_spans(" ".join(w for w in words if w != "point"))


def test_offsets_are_those_of_a_character_map():
    rng = random.Random(7)
    for _ in range(300):
        draft = Draft("".join(rng.choices("abcdef", k=30)))
        maps = [(i, i + 1) for i in range(30)]
        for _ in range(3):
            at, changes = 0, []
            while (a := at + rng.randrange(1, 6)) < len(draft.text) - 1:
                at = min(len(draft.text), a + rng.randrange(1, 4))
                changes.append((a, at, "XYZ"[: rng.randrange(0, 4)]))
            new, last = [], 0
            for a, b, text in changes:
                new += maps[last:a] + [(maps[a][0], maps[b - 1][1])] * len(text)
                last = b
            maps, draft = new + maps[last:], draft.replaced(changes)
        assert len(maps) == len(draft.text)
        for _ in range(20):
            if len(maps):
                a = rng.randrange(len(maps))
                b = rng.randrange(a + 1, len(maps) + 1)
                assert draft.source(a, b) == (maps[a][0], maps[b - 1][1])


@pytest.mark.parametrize("unit, n", [(u, 5_000_000) for u in ("a", "1", " ", "bob at mail dot com ")] + [(u, 800_000) for u in ("at dot ", "at . ", "(", "+1 (", "one two ", "a@b.co ", "[at]", "1.", "\n")])
def test_time_grows_with_the_length_only(unit, n):
    def seconds(n: int) -> float:
        text = unit * (n // len(unit)) + " dot point"
        began = time.process_time()
        all_spans(text)
        return time.process_time() - began

    short, long = max(seconds(100_000), 0.02), seconds(n)
    assert long < 4 * n / 100_000 * short + 1, (unit, short, long)
