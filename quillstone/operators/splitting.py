"""Splitting of a section's text into chunks of bounded size, by the kind of section: blocks, sentences, clauses, the middle.

Nothing is lost: what is too short for a chunk of its own goes to the one before. compat leaves it out, as has been observed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from quillstone.functions import structure_rules as R


@dataclass(frozen=True)
class Limits:
    least: int = 150
    best: int = 800
    most: int = 1500
    overlap: int = 150


_ENDS = [re.compile(p) for p in R.SENTENCE_ENDS]
_CLAUSES = [re.compile(p, re.IGNORECASE) for p in R.CLAUSE_ENDS]
_MARK = re.compile(r"[.!?]+")
_NUMBERED = re.compile(r"^\s*\d+\.\s+", re.MULTILINE)
_BULLET = re.compile(r"^\s*[•\-]\s+", re.MULTILINE)
_BLANK = re.compile(r"\n\s*\n+")
_TITLE_LINE = re.compile(r"(?=\n[A-ZÀÈÉÌÒÙ][A-ZÀÈÉÌÒÙa-zàèéìòù\s]*:?\n)")
_STEP = re.compile(r"(?=\d+\.\s+)")
_ITEM = re.compile(r"(?=[•\-*]\s+)")


def sentences(text: str) -> list[str]:
    """Of four ways to end a sentence the one that gives most parts, if their mean length is between 20 and 500; else the whole text. Parts of ten characters or fewer are no sentences."""
    best = [text]
    for end in _ENDS:
        parts: list[str] = []
        start = 0
        for m in end.finditer(text):
            parts.append(text[start : m.start()].strip() + (m.group(1) if m.lastindex else ""))
            start = m.end()
        parts = [p for p in (*parts, text[start:].strip()) if len(p) > 10]
        if len(parts) > max(1, len(best)) and 20 < sum(map(len, parts)) / len(parts) < 500:
            best = parts
    return best


def packed(parts: list[str], glue: str, most: int, broken: Callable[[str], list[str]] | None = None) -> list[str]:
    """Parts in order, joined while they stay within most; a part beyond it stands alone, or is broken up."""
    out: list[str] = []
    open_ = ""
    for part in parts:
        both = (open_ + glue + part).strip() if open_ else part
        if len(both) <= most:
            open_ = both
            continue
        if open_:
            out.append(open_.strip())
        open_ = ""
        if len(part) > most and broken:
            out += broken(part)
        else:
            open_ = part
    return out + [open_.strip()] if open_ else out


def halves(text: str) -> list[str]:
    """Two halves at the white space nearest to the middle, within 100 characters; the first one says that it goes on."""
    middle = len(text) // 2
    spaces = [p for p in range(max(1, middle - 99), min(len(text), middle + 100)) if text[p].isspace()]
    cut = min(spaces, key=lambda p: (abs(p - middle), p), default=middle)
    left, right = text[:cut].strip(), text[cut:].strip()
    return [left if left.endswith((".", "!", "?", ";", ":")) else left + "...", right]


def last_resort(text: str, limits: Limits) -> list[str]:
    """By paragraphs, else by sentences, else in halves; parts that are still too long again."""
    for parts, glue in ((text.split("\n\n"), "\n\n"), (sentences(text), " ")):
        if len(parts) > 1:
            return packed(parts, glue, limits.most, lambda p: last_resort(p, limits))
    return halves(text)


def clauses(text: str, limits: Limits) -> list[str]:
    """Cut at the clause end that leaves the most even parts, the rest again while it is too long."""
    out: list[str] = []
    while len(text) > limits.most:
        cuts = {m.end() for p in _CLAUSES for m in p.finditer(text)}
        sides = [(text[:c].strip(), text[c:].strip()) for c in sorted(cuts)]
        fit = [(a, b) for a, b in sides if limits.least <= len(a) <= limits.most and len(b) >= limits.least]
        if not fit:
            return out + last_resort(text, limits)
        left, text = min(fit, key=lambda s: abs(len(s[0]) - len(s[1])))
        out.append(left)
    return [*out, text]


def by_sentences(text: str, limits: Limits) -> list[str]:
    return packed(sentences(text), " ", limits.most)


def large_block(text: str, limits: Limits) -> list[str]:
    return [c for part in by_sentences(text, limits) for c in ([part] if len(part) <= limits.most else clauses(part, limits))]


def is_protected(text: str, kind: str) -> bool:
    """The same rules as functions.structure.is_protected."""
    return bool(
        re.search(R.LONG_LIST, text, re.MULTILINE)
        or re.search(R.QUESTION_ANSWER, text)
        or text.count("|") >= 4
        or text.count("\t") >= 4
        or kind in ("definitions", "procedures")
        or any(re.search(p, text, re.IGNORECASE) for p in (R.DEFINES, R.PROCEDURE, R.TERMS))
    )


def _at(starts: re.Pattern, text: str) -> list[str]:
    cuts = [m.start() for m in starts.finditer(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


def blocks(text: str, kind: str, limits: Limits) -> list[str]:
    """Numbered or bulleted exclusions, cover below title lines, whole series of steps, else paragraphs; far too long ones by sentences."""
    if kind == "exclusions" and _NUMBERED.search(text):
        parts = _at(_NUMBERED, text)
    elif kind == "exclusions" and _BULLET.search(text):
        parts = _at(_BULLET, text)
    elif kind == "coverage" and _TITLE_LINE.search(text):
        parts = _TITLE_LINE.split(text)
    elif kind == "procedures" and _NUMBERED.search(text):
        parts = _at(re.compile(r"^\s*1\.\s+", re.MULTILINE), text)
    else:
        parts = _BLANK.split(text)
    parts = [p.strip() for p in parts if p.strip()]
    return [b for p in parts for b in (by_sentences(p, limits) if len(p) > 1.5 * limits.most else [p]) if b.strip()]


def split(text: str, kind: str = "general", limits: Limits = Limits(), compat: bool = False) -> list[str]:
    """Chunks of a section's text, each with the end of the one before where that is set."""
    if len(text) <= limits.best:
        return [text]
    if is_protected(text, kind):
        paragraphs = _BLANK.split(text)
        if len(text) <= limits.most or len(paragraphs) == 1:
            return [text]
        return _kept(packed(paragraphs, "\n\n", limits.most), limits, compat)
    chunks = packed(blocks(text, kind, limits), "\n\n", limits.most, lambda b: large_block(b, limits))
    return with_overlap(_kept(chunks, limits, compat), kind, limits)


def _kept(chunks: list[str], limits: Limits, compat: bool) -> list[str]:
    if compat:
        return [c for c in chunks if len(c) >= limits.least]
    out: list[str] = []
    for c in chunks:
        if out and (len(c) < limits.least or len(out[-1]) < limits.least):
            out[-1] += "\n\n" + c
        else:
            out.append(c)
    return out


def overlap_size(kind: str, limits: Limits) -> int:
    if kind in ("definitions", "procedures", "coverage"):
        return min(2 * limits.overlap, 300)
    return min(limits.overlap, 150) if kind == "exclusions" else limits.overlap


def tail(text: str, size: int, kind: str) -> str:
    """The end of a text that the next chunk repeats: a whole definition, step, item or sentence within size; nothing of a short text."""
    if len(text) <= size or size <= 0:
        return ""
    end = text[-2 * size :]
    parts = sentences(end)
    if kind == "definitions" and len(parts) > 1:
        return parts[-1] if len(parts[-1]) <= size else ""
    mark = _STEP if kind == "procedures" else _ITEM if kind in ("coverage", "exclusions") else None
    if mark is not None and mark.search(end):
        last = mark.split(end)[-1].strip()
        if len(last) <= size:
            return last
    for n in (1, 2):
        last = " ".join(parts[-n:])
        if len(parts) > n and len(last) <= size:
            return last
    return ""


def with_overlap(chunks: list[str], kind: str, limits: Limits) -> list[str]:
    size = overlap_size(kind, limits)
    ends = ["", *(tail(c, size, kind) for c in chunks[:-1])]
    return [f"{e.strip()}\n\n[goes on]\n{c}" if e else c for e, c in zip(ends, chunks, strict=True)]


def whole_sentences(text: str) -> str:
    """A text up to its last whole sentence, if the end of it is none; lists stay as they are."""
    text = text.strip()
    if re.search(r"[.!?]\s*$", text) or re.search(R.LIST_ITEM, text, re.MULTILINE):
        return text
    parts = sentences(text)
    ends = next((i for i, s in enumerate(parts) if not re.search(r"[.!?]\s*$", s)), len(parts))
    return " ".join(parts[:ends]) if len(parts) > 1 and ends else text
