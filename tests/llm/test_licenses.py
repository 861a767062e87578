"""License scans: templates are ranked by compression, and whole texts give what a plain scan gives."""

import random

from orbifold.llm import licenses
from orbifold.llm.licenses import TEMPLATES, alignments, ranked, scan_text, words

from .conftest import prose


def plain_scan(text):
    """The notices by trying every template at every place, ranked by compression of the blocks around."""
    block = words(text)
    most = {w: int(licenses.DIFFERENT * len(words(w))) for own in TEMPLATES.values() for w in own}
    inside = {}
    for w in most:
        a = words(w)
        n, inside[w] = len(a), set()
        own = [x in a for x in block]
        for i in range(len(block)):
            if own[i] and sum(own[i : i + n + most[w]]) >= n - most[w]:
                inside[w] |= set(range(i, min(len(block), i + n + most[w])))
    every = sorted(set().union(*inside.values()))
    blocks = []
    for k in every:
        joined = blocks and k == blocks[-1][-1] + 1 and any({k - 1, k} <= inside[w] and _one(inside, block, most, w, k) for w in most)
        blocks[-1].append(k) if joined else blocks.append([k])
    taken, out = {}, []
    for own in blocks:
        low, high = own[0], own[-1] + 1
        found = []
        for rank, (w, _, _) in enumerate(ranked(block[low:high])):
            name = next(n for n, ws in TEMPLATES.items() if w in ws)
            found += [(m + d > 0, rank, m, d, low + i, low + j, name) for m, d, i, j in alignments(words(w), block[low:high]) if m + d <= most[w]]
        for inexact, _, m, d, i, j, name in sorted(found):
            others = set().union(*(taken.get(k, ()) for k in range(i, j)))
            if name not in others and (not inexact or not others):
                for k in range(i, j):
                    taken.setdefault(k, set()).add(name)
                out.append((name, m, d, i, j))
    return sorted(out)


def _one(inside, block, most, w, k):
    """Whether one window of the template ``w`` spans the words k - 1 and k."""
    a = words(w)
    n = len(a) + most[w]
    return any(block[i] in a and sum(x in a for x in block[i : i + n]) >= len(a) - most[w] for i in range(max(0, k - n + 1), k))


def edited(rng, wording):
    """A wording with as many words changed, dropped or added as may be."""
    out = words(wording)
    for _ in range(rng.randint(0, int(licenses.DIFFERENT * len(out)))):
        k = rng.randrange(1, len(out) - 1)
        if rng.random() < 0.5:
            del out[k]
        else:
            out.insert(k, "verily")
    return " ".join(out)


def test_texts_are_scanned_as_plainly():
    rng = random.Random(6)
    every = [w for own in TEMPLATES.values() for w in own]
    seen = 0
    for _ in range(60):
        parts = [rng.choice([prose(rng, rng.randint(1, 30)), edited(rng, rng.choice(every)), rng.choice(every), "the license of the software is under the terms"]) for _ in range(5)]
        text = rng.choice([" ", "\n", ". "]).join(parts)
        found = scan_text(text)
        spans = [m.span() for m in licenses._WORD.finditer(text)]
        starts, ends = {s: k for k, (s, _) in enumerate(spans)}, {e: k + 1 for k, (_, e) in enumerate(spans)}
        got = sorted((f["license"], f["missing"], f["added"], starts[f["start"]], max(n for e, n in ends.items() if e <= f["end"])) for f in found)
        assert got == plain_scan(text), text
        seen += len(got)
    assert seen > 80


def test_ranking_decides_between_near_templates():
    for name, other, word in (("GPL-3.0", "GPL-2.0", "redistribute"), ("LGPL-3.0", "AGPL-3.0", "modify"), ("GPL-2.0", "GPL-3.0", "published")):
        wording = TEMPLATES[name][-1].replace(word, "pass on", 1)
        order = [next(n for n, ws in TEMPLATES.items() if w in ws) for w, _, _ in ranked(words(wording))]
        assert order[0] == name and other in order
        a, b = words(TEMPLATES[other][-1]), words(wording)
        assert min(m + n for m, n, _, _ in alignments(a, b)) <= licenses.DIFFERENT * len(a)  # the other would be confirmed as well
        assert [f["license"] for f in scan_text(f"Here it is. {wording} And so on.")] == [name]
    for name, wordings in TEMPLATES.items():
        for w in wordings:
            order = ranked(words(w))
            assert w in {x for x, n, _ in order if n >= order[0][1] - 1}, name  # a digit alone may save nothing; exact wordings come first
            assert [f["license"] for f in scan_text(w)] == [name]


def test_edited_notices_save_enough_in_long_texts():
    rng = random.Random(8)
    around = prose(rng, 3_000)
    for name, wordings in TEMPLATES.items():
        for w in wordings:
            for _ in range(6):
                text = edited(rng, w)
                found = {f["license"] for f in scan_text(f"{around} {text} {around}")}
                assert name in found or found and not set(words(w)) <= set(words(text)), text  # without a telling word others are as near
                assert licenses.savings(words(text))[w] >= licenses.REDUCTION * licenses._own_savings()[w], text


def test_every_notice_is_triggered():
    import re

    for wordings in TEMPLATES.values():
        for w in wordings:
            assert re.search(licenses.TRIGGER, w), w
