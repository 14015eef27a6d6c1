"""Ordered diffs: applied to the old text they give the new one, and they are those of a plain patience diff."""

from __future__ import annotations

import random
import re

from custodia.operators import ordered_diff
from tests.conftest import rows, scripts


def applied(old: str, diff: str) -> str:
    """The old text after a unified diff; fails where a line isn't what the diff says."""
    lines, out, at = re.findall(r"[^\n]*\n|[^\n]+", old), [], 0
    diff = re.sub(r"\n\\ No newline at end of file\n", "\0", diff)
    for part in re.findall(r"[^\n\0]*[\n\0]", diff)[2:]:
        body = part[1:-1] + ("\n" if part.endswith("\n") else "")
        if head := re.match(r"@@ -(\d+),(\d+) \+(\d+),(\d+) @@", part):
            start, size = int(head[1]), int(head[2])
            upto = start - 1 if size else start
            out += lines[at:upto]
            at = upto
            assert len(out) == (int(head[3]) - 1 if int(head[4]) else int(head[3]))
            continue
        if part[0] in " -":
            assert lines[at] == body
            at += 1
        if part[0] in " +":
            out.append(body)
    return "".join(out + lines[at:])


CASES = [
    ("x = 1\ny = 2\n", "x = 1\ny = 3\nz = 4\n"),
    ("a\nb\nc\n", "c\na\nb\n"),
    ("", "new\n"),
    ("same\n", "same\n"),
    ("kept\n", ""),
    ("no break", "no break\n"),
    ("a\nb", "a\nc"),
    ("a\n", "a\nb"),
    ("x\nx\nx\n", "x\nx\n"),
    ("a\r\nb\r\n", "a\nb\n"),
    ("\n\n\n", "\n\nq\n\n"),
    ("".join(f"l{n}\n" for n in range(30)), "".join(f"l{n}{'!' if n in (2, 9, 17, 18) else ''}\n" for n in range(30))),
    ("void one\n{\n}\n\nvoid two\n{\n}\nend\n", "start\nvoid two\n{\n}\n\nvoid one\n{\n}\n"),
]


def random_case(rng: random.Random) -> tuple[str, str]:
    words = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 40))]
    other = list(words)
    for _ in range(rng.randrange(0, 8)):
        at = rng.randrange(0, len(other) + 1)
        other[at : at + rng.randrange(0, 3)] = [rng.choice("ijkabc") for _ in range(rng.randrange(0, 3))]
    if rng.random() < 0.3:
        rng.shuffle(other)
    ends = [rng.choice(["", "\n"]) for _ in range(2)]
    return "\n".join(words) + ends[0], "\n".join(other) + ends[1]


def test_applying_the_diff_gives_the_new_text(spark):
    rng = random.Random(6)
    cases = CASES + [random_case(rng) for _ in range(200)]
    old, new = scripts(spark, *[a for a, _ in cases]), scripts(spark, *[b for _, b in cases])
    got = dict(rows(ordered_diff.unified(old.repartition(3), new.repartition(5), "script_id", "code")))
    for n, (a, b) in enumerate(cases):
        assert (n in got) == (a != b and b != "")
        if n in got:
            assert got[n].startswith("--- original.py\n+++ rewritten.py\n@@ ")
            assert applied(a, got[n]) == b


def test_as_printed(spark):
    (a, b), (c, d) = CASES[0], CASES[-2]
    got = dict(rows(ordered_diff.unified(scripts(spark, a, c), scripts(spark, b, d), "script_id", "code")))
    assert got[0] == "--- original.py\n+++ rewritten.py\n@@ -1,2 +1,3 @@\n x = 1\n-y = 2\n+y = 3\n+z = 4\n"
    assert [h for h in got[1].split("\n") if h.startswith("@@")] == ["@@ -1,13 +1,13 @@", "@@ -15,8 +15,8 @@"]


def test_moved_blocks_stay_whole(spark):
    """Functions that swap places: the lines both have once decide, not the brackets."""
    a, b = CASES[-1]
    steps = ordered_diff.steps(a.splitlines(), b.splitlines())
    kept = [a.splitlines()[i] for i, j in steps if i >= 0 and j >= 0]
    assert kept == ["void two", "{", "}"]


def plain_longest(values: list[int]) -> int:
    best = [1] * len(values)
    for i, v in enumerate(values):
        best[i] += max((best[k] for k in range(i) if values[k] < v), default=0)
    return max(best, default=0)


def test_longest_rising():
    rng = random.Random(1)
    for _ in range(300):
        values = rng.sample(range(50), rng.randrange(0, 25))
        found = [values[n] for n in ordered_diff.longest_rising(values)]
        assert found == sorted(found) and len(found) == plain_longest(values)


def test_rows_that_are_no_pair(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None), (None, "a"), (5, "a")], "id int, code string")
    new = spark.createDataFrame([(1, "c"), (2, "b"), (2, "c"), (3, "n\n"), (None, "b"), (4, "only new\n"), (6, None)], "id int, code string")
    got = rows(ordered_diff.hunks(old, new, "id", "code").select("id", "header"), "id")
    assert got == [(None, "@@ -1,1 +1,1 @@"), (3, "@@ -0,0 +1,1 @@"), (4, "@@ -0,0 +1,1 @@")]
    assert ordered_diff.unified(old.limit(0), new.limit(0), "id", "code").collect() == []


def test_long_texts_and_two_shuffles(spark):
    text = "".join(f"line {n}\n" for n in range(100_000))
    other = text.replace("line 5\n", "").replace("line 77777\n", "line 77777\nnew\n") + "end"
    found = ordered_diff.unified(scripts(spark, text), scripts(spark, other), "script_id", "code")
    assert applied(text, found.first()["diff"]) == other
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ArrowEvalPython") == 1
