"""Template automata against regular expressions over the words, and complete licence texts."""

import random
import re

from tessella.llm import licenses
from tests_support import words


def pattern(template):
    """The template as a regular expression over words with a blank after each."""
    out = ""
    for t in re.findall(r"\[\[|\]\]|\{\{\d+,\d+\}\}|[^\s\[\]{}]+", template):
        out += "(?:" if t == "[[" else ")?" if t == "]]" else rf"(?:\S+ ){t[1:-1]}" if t[0] == "{" else re.escape(t) + " "
    return re.compile("(?:(?<= )|^)" + out)


def filled(template, rng):
    """A text that the template accepts."""
    out, keep = [], [True]
    for t in re.findall(r"\[\[|\]\]|\{\{\d+,\d+\}\}|[^\s\[\]{}]+", template):
        if t == "[[":
            keep.append(keep[-1] and rng.random() < 0.5)
        elif t == "]]":
            keep.pop()
        elif keep[-1] and t[0] == "{":
            low, high = map(int, t[2:-2].split(","))
            out += [rng.choice(["Jane", "the", "is", "2024", "software", "copyright"]) for _ in range(rng.randint(low, high))]
        elif keep[-1]:
            out.append(t)
    return out


def test_templates_against_regular_expressions():
    rng = random.Random(7)
    texts = []
    for template in licenses.TEMPLATES.values():
        for _ in range(6):
            w = filled(template, rng)
            texts.append(w)
            broken = list(w)
            broken[rng.randrange(len(w))] = rng.choice(["other", "the"])
            texts += [broken, w[: len(w) // 2], ["before", *w, "after", *w], w + filled(rng.choice(list(licenses.TEMPLATES.values())), rng)]
    hits = 0
    for w in texts:
        text = ", ".join(w).title()
        joined = "".join(x + " " for x in words(text))
        want = {k for k, t in licenses.TEMPLATES.items() if pattern(t).search(joined)}
        found = licenses.scan(text.encode())
        assert {x["label"] for x in found["spans"]} == want, w
        assert all(pattern(licenses.TEMPLATES[x["label"]]).match(joined, len("".join(y + " " for y in words(text)[: x["start"]]))) for x in found["spans"])
        assert 0 <= found["score"] <= 1 and (found["score"] > 0.5) == bool(want)
        hits += len(want)
    assert hits > 200


def test_complete_texts():
    year = "Copyright (c) 2021, Jane Doe. All rights reserved.\n\n"
    bsd3 = year + " ".join(filled(licenses.TEMPLATES["bsd-3-clause"], random.Random(1)))
    labels = licenses.scan(bsd3.encode())["labels"]
    assert "bsd-3-clause" in labels and "bsd-2-clause" not in labels and "reserved-notice" in labels
    assert licenses.scan(b"")["score"] == 0.0 == licenses.scan(b"nothing of that kind")["score"]
