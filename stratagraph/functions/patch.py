"""Unified diffs without context: which lines of the new file they touch, and what they add."""

from __future__ import annotations

import re

_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def parse_patch(patch: str | None) -> tuple[list[int], str]:
    """(sorted touched line numbers of the new side, added text).

    Every added line counts, also one whose text begins with ``++``; a pure deletion touches nothing; the
    remark about a missing newline is no line. A null patch touches nothing.
    """
    touched, added, at, left = [], [], 0, 0
    for line in (patch or "").split("\n"):
        hunk = _HUNK.match(line)
        if hunk:
            at, left = int(hunk[1]), int(hunk[2] or 1)
        elif left and line.startswith("+"):
            touched.append(at)
            added.append(line[1:])
            at, left = at + 1, left - 1
        elif left and line.startswith(" "):
            at, left = at + 1, left - 1
    return sorted(set(touched)), "\n".join(added)


def touches(lines: list[int], start: int, end: int) -> bool:
    """Whether a sorted list of lines has one in [start, end]."""
    from bisect import bisect_left

    i = bisect_left(lines, start)
    return i < len(lines) and lines[i] <= end
