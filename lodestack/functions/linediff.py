"""Line diffs in unified form: making, applying, counting. No Spark here."""

from __future__ import annotations

import re
from array import array

MOST_CELLS = 4_000_000


class DiffError(ValueError):
    """A diff that can't be read or doesn't fit the text."""


def split_lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def edits(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """(sign, place in old, place in new) along a longest common subsequence, deletions before insertions.

    Beyond MOST_CELLS pairs of lines everything is deleted and inserted.
    """
    n, m = len(old), len(new)
    if n * m > MOST_CELLS:
        return [("-", i, 0) for i in range(n)] + [("+", 0, j) for j in range(m)]
    lead = 0
    while lead < min(n, m) and old[lead] == new[lead]:
        lead += 1
    width = m - lead + 1
    longest = [array("l", bytes(8 * width)) for _ in range(n - lead + 1)]
    for i in range(n - lead - 1, -1, -1):
        row, below, mine = longest[i], longest[i + 1], old[lead + i]
        for j in range(m - lead - 1, -1, -1):
            row[j] = below[j + 1] + 1 if mine == new[lead + j] else max(below[j], row[j + 1])
    out = [(" ", i, i) for i in range(lead)]
    i = j = 0
    while i < n - lead and j < m - lead:
        if old[lead + i] == new[lead + j]:
            out.append((" ", lead + i, lead + j))
            i, j = i + 1, j + 1
        elif longest[i + 1][j] >= longest[i][j + 1]:
            out.append(("-", lead + i, lead + j))
            i += 1
        else:
            out.append(("+", lead + i, lead + j))
            j += 1
    out += [("-", lead + x, m) for x in range(i, n - lead)]
    return out + [("+", n, lead + x) for x in range(j, m - lead)]


def unified(old_text: str, new_text: str, context: int = 3) -> str:
    """A unified diff, empty for equal lines; hunks whose contexts overlap are one."""
    old, new = split_lines(old_text), split_lines(new_text)
    ops = edits(old, new)
    windows: list[list[int]] = []
    for at, (sign, _, _) in enumerate(ops):
        if sign == " ":
            continue
        lo, hi = max(0, at - context), min(len(ops), at + 1 + context)
        if windows and (lo < windows[-1][1] or ops[at - 1][0] != " " and at):
            windows[-1][1] = hi
        else:
            windows.append([lo, hi])
    if not windows:
        return ""
    out = ["--- a/original", "+++ b/modified"]
    for lo, hi in windows:
        part = ops[lo:hi]
        left, right = sum(s != "+" for s, _, _ in part), sum(s != "-" for s, _, _ in part)
        out.append(f"@@ -{part[0][1] + 1},{left} +{part[0][2] + 1},{right} @@")
        out += [sign + (new[j] if sign == "+" else old[i]) for sign, i, j in part]
    return "\n".join(out) + "\n"


_HUNK = re.compile(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")


def apply(text: str, diff: str) -> str:
    """The text with the diff applied; its final line end stays as it is. Raises DiffError when lines differ."""
    old, out, at = split_lines(text), [], 0
    rows = split_lines(diff)
    start = 0
    while start < len(rows) and (rows[start] == "" or rows[start].startswith(("--- ", "+++ "))):
        start += 1
    inside = False
    for row in rows[start:]:
        if row.startswith("@@"):
            found = _HUNK.match(row)
            if not found:
                raise DiffError(f"bad hunk header: {row}")
            goal = max(int(found[1]) - 1, 0)
            out += old[at:goal]
            at, inside = max(at, min(goal, len(old))), True
        elif not inside:
            raise DiffError(f"expected hunk, got: {row}")
        elif row[:1] in (" ", "-"):
            if at >= len(old) or old[at] != row[1:]:
                raise DiffError(f"line {at + 1} is not {row[1:]!r}")
            if row[0] == " ":
                out.append(old[at])
            at += 1
        elif row[:1] == "+":
            out.append(row[1:])
        else:
            raise DiffError(f"unexpected line: {row}")
    return "\n".join(out + old[at:]) + ("\n" if text.endswith("\n") else "")
