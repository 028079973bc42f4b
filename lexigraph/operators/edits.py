"""Edits of texts: finding the place, replacing, re-indenting, differences. One text at a time; `edited` runs them over a table."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _at(lines: list[str], wanted: list[str], by) -> list[int]:
    n, want = len(wanted), [by(x) for x in wanted]
    have = [by(x) for x in lines]
    return [i for i in range(len(lines) - n + 1) if have[i : i + n] == want]


def find(text: str, old: str, near: int | None = None, around: int = 50) -> tuple[int, int, str] | None:
    """(first line, line after, how) of a passage: exactly, else but for blanks at line ends, else but for indentation, then only near
    the hinted line if there is one; the nearest of several to the hint, else the first."""
    lines, wanted = text.split("\n"), old.split("\n")
    for how, by in (("exact", lambda x: x), ("trimmed", str.rstrip), ("indent", str.strip)):
        hits = _at(lines, wanted, by)
        if how == "indent" and near is not None:
            hits = [i for i in hits if abs(i + 1 - near) <= around]
        if hits:
            at = min(hits, key=lambda i: (abs(i + 1 - near), i)) if near is not None else hits[0]
            return at, at + len(wanted), how
    return None


def find_block(lines: list[str], first: str, last: str, inner: list[str] = (), near: int | None = None) -> tuple[int, int] | None:
    """(start, end) of the block that starts and ends with these lines, blanks aside, and holds the inner ones in order;
    the shortest, or the nearest to the hint."""
    trimmed, found = [x.strip() for x in lines], []
    for s in (i for i, x in enumerate(trimmed) if x == first.strip()):
        for e in (j for j in range(s, len(trimmed)) if trimmed[j] == last.strip()):
            it = iter(trimmed[s : e + 1])
            if all(any(x == y.strip() for x in it) for y in inner):
                found.append((s, e + 1))
                break
    return min(found, key=lambda x: (abs(x[0] + 1 - near), x[0])) if found and near is not None else min(found, key=lambda x: (x[1] - x[0], x[0]), default=None)


def reindented(new: str, old: str) -> str:
    """The replacement, moved as a whole to the indentation of what it replaces."""
    depth = lambda t: min((len(x) - len(x.lstrip()) for x in t.split("\n") if x.strip()), default=0)
    move, was = depth(old) - depth(new), depth(new)
    sample = next((x[: depth(old)] for x in old.split("\n") if x.strip()), "")
    return "\n".join((sample + x[was:] if move else x) if x.strip() else x for x in new.split("\n"))


def apply_edits(text: str, edits: list[tuple[str, str]]) -> tuple[str | None, list[str]]:
    """All edits or none: the new text, or what couldn't be found."""
    errors = []
    for old, new in edits:
        lines, hit = text.split("\n"), find(text, old)
        if hit is None:
            errors.append(f"not found: {old[:60]}")
            continue
        s, e, how = hit
        made = reindented(new, "\n".join(lines[s:e])) if how == "indent" else new
        text = "\n".join([*lines[:s], *made.split("\n"), *lines[e:]])
    return (None, errors) if errors else (text, [])


def replace_symbols(text: str, edits: list[tuple[int, int, str]]) -> tuple[str | None, list[str]]:
    """Edits (first line, last line, body) in any order, in lines of the original; those that overlap are refused."""
    ordered = sorted(edits)
    if any(b[0] <= a[1] for a, b in zip(ordered, ordered[1:], strict=False)):
        return None, ["edits overlap"]
    lines, shift = text.split("\n"), 0
    for first, last, body in ordered:
        new = body.split("\n") if body else []
        lines[first - 1 + shift : last + shift] = new
        shift += len(new) - (last - first + 1)
    return "\n".join(lines), []


def diff(old: str, new: str, path: str = "file", context: int = 3) -> str:
    return "\n".join(difflib.unified_diff(old.split("\n"), new.split("\n"), f"a/{path}", f"b/{path}", lineterm="", n=context))


def resumed(tail: list[str], incoming: list[str], most: int = 500) -> list[str]:
    """Incoming lines without those at their head that the existing text already ends with."""
    tail = tail[-most:]
    for n in range(min(len(tail), len(incoming)), 0, -1):
        if tail[-n:] == incoming[:n]:
            return incoming[n:]
    return incoming


def payload(text: str) -> tuple[str, list[int], int | None] | None:
    """`symbol 1,2 ack:3` as (symbol, numbers, acknowledged)."""
    m = re.fullmatch(r"\s*(\S+)(?:\s+(\d+(?:\s*,\s*\d+)*))?(?:\s+ack:(\d+))?\s*", text)
    return m and (m[1], [int(x) for x in re.findall(r"\d+", m[2] or "")], int(m[3]) if m[3] else None)


def edited(docs: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc_id, text, errors, diff) of (doc_id, text, olds, news): arrays of what to find and what to put; null text where an edit fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, olds, news in zip(b[doc], b["text"], b["olds"], b["news"], strict=True):
                new, errors = apply_edits(text or "", list(zip(olds, news, strict=True)))
                out.append((i, new, errors, "" if new is None else diff(text or "", new)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "errors", "diff"])

    return docs.select(doc, "text", "olds", "news").mapInPandas(run, "doc_id long, text string, errors array<string>, diff string")
