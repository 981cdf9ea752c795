"""Subsection spans against a plain reading of each text, over random mixtures of lines."""

import random
import re

import pytest

from cairnwork.operators import slices

WANTED = ["B2", "C1", "C9", "C13", "C14", "D13", "G5", "H5", "J3"]


def plain(text, code):
    """The rule read line by line."""
    if text is None:
        return "unresolved", None, None, ""
    lines, place = text.split("\n"), {c: i for i, c in enumerate(slices.CODES)}
    marks = []
    for at, line in enumerate(lines):
        bare = line.lstrip()
        style = 0 if bare.startswith("## ") else 1 if bare.startswith("### ") else 3 if bare.startswith("**") else 2
        for sign in ("### ", "## ", "# ", "- ", "* "):
            bare = bare[len(sign) :].lstrip() if bare.startswith(sign) else bare
        found = re.match(r"\s*([A-Za-z]\d+)(?=\s*[.:]|\s|$)", bare.removeprefix("**"))
        if found and found[1].upper() in place:
            marks.append((at, found[1].upper(), style))
    own = sorted((style, at) for at, c, style in marks if c == code)
    said = [at for at, line in enumerate(lines) if any(p in line.lower() for p in slices.PHRASES.get(code, ()))]
    before = sorted((-place[c], at) for at, c, _ in marks if place[c] < place[code])
    for rank, start in [*own[:1], *[(4, at) for at in said[:1]], *[(5, at) for _, at in before[:1]]]:
        most = start + (400 if rank == 5 else 200)
        stop = min([at for at, c, _ in marks if start < at < most and place[c] > place[code]] + [most, len(lines)])
        if rank == 5 and stop - start >= 250:
            break
        return slices.STRATEGIES[rank], start, stop, "\n".join(lines[start:stop])
    return "unresolved", None, None, ""


def texts():
    draw = random.Random(11)
    signs = ["## ", "### ", "# ", "- ", "* ", "**", "  ", "## - ", "- ## ", "**  "]
    phrases = [p for c in WANTED for p in slices.PHRASES.get(c, ())]
    for _ in range(300):
        lines = []
        for _ in range(draw.randrange(1, 25)):
            kind = draw.random()
            if kind < 0.45:
                lines.append(draw.choice(signs) + draw.choice([*WANTED, "b2", "C2", "C100", "Z1", "D1"]) + draw.choice(["", ".", " :", " . text", " text", ")", "x", "-"]))
            elif kind < 0.55:
                lines.append("x " + draw.choice(phrases).upper() + " y")
            elif kind < 0.62:
                lines += ["filler"] * draw.choice([3, 199, 200, 248, 249, 410])
            else:
                lines.append(draw.choice(["", "see C13 below", "| a | b |", "H55 no"]))
        yield "\n".join(lines)


def test_slices_equal_a_plain_reading(spark):
    rows = list(enumerate([None, "", "C13", *texts()]))
    docs = spark.createDataFrame(rows, "id bigint, body string").repartition(4)
    got = {(r.id, r.code): (r.strategy, r.start, r.stop, r.text) for r in slices.slices(docs, "id", "body", WANTED).collect()}
    assert got == {(k, c): plain(t, c) for k, t in rows for c in WANTED}
    assert {s for s, *_ in got.values()} == set(slices.STRATEGIES)


def test_unknown_codes_are_refused_and_plans_have_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "## C1")], "id bigint, body string")
    with pytest.raises(ValueError):
        slices.slices(docs, "id", "body", ["Q1"])
    assert "Exchange" not in slices.slices(docs, "id", "body", ["C1"])._jdf.queryExecution().executedPlan().toString()
