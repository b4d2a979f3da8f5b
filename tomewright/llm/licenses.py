"""Licence notices and identifier tags, found by one Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tomewright.llm.common import id_and_text

#: The phrases of the base scan and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notice phrases, as words.
NOTICES = {
    "affero general public license": "agpl",
    "apache license": "apache",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
}

#: How freely a text under each label may be used, from 0 to 1.
FREEDOM = {
    "reserved": 0.0, "cc-by-nc": 0.2, "cc-by-nd": 0.3, "agpl": 0.4, "gpl": 0.5, "cc-by-sa": 0.6, "lgpl": 0.6, "mpl": 0.7, "epl": 0.7,
    "cc-by": 0.8, "apache": 0.9, "bsd": 0.9, "mit": 0.9, "cc0": 1.0, "public-domain": 1.0,
}

#: Identifier beginnings, as words, for the names that tags use; the longest that fits counts.
FAMILIES = {
    "0bsd": "bsd", "agpl": "agpl", "apache": "apache", "bsd": "bsd", "cc by": "cc-by", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa", "cc0": "cc0", "epl": "epl", "gpl": "gpl", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "public-domain",
}

_TAG = "spdx license identifier"
_WORD = re.compile(rb"[^ ]+")
_COLON = re.compile(r"[ \t]*:?")
_SYMBOL = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+-]+)")
_BINDS = {"or": 1, "and": 2, "with": 3}

#: Bytes to spaces unless they are in words; A-Z to a-z.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def family(identifier: str) -> str | None:
    words = f"{re.sub(r'[^a-z0-9]+', ' ', identifier.lower()).strip()} "
    fits = [k for k in FAMILIES if words.startswith(f"{k} ") or words.startswith(k) and words[len(k)].isdigit()]
    return FAMILIES[max(fits, key=len)] if fits else None


def postfix(text: str, at: int = 0) -> list[str] | None:
    """Shunting-yard: ``with`` binds before ``and`` before ``or``. The longest
    well-formed beginning of what stands from ``at`` to the end of the line is
    taken, as prose may follow; None without one."""
    out: list[str] = []
    held: list[str] = []
    best, operand, depth = None, False, 0

    while m := _SYMBOL.match(text, at):
        s, at = m[1], m.end()
        low = s.lower()
        if low in _BINDS:
            if not operand:
                break
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = False
        elif s == "(":
            if operand:
                break
            held.append(s)
            depth += 1
        elif s == ")":
            if not operand or not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            if operand:
                break
            out.append(s)
            operand = True
        if operand and not depth:
            best = len(out), held[::-1]  # outside parentheses at most three are held
    return out[: best[0]] + best[1] if best else None


def evaluate(symbols: list[str]) -> tuple[float, set[str]]:
    """Freedom and labels: ``or`` lets the reader choose the freer side, ``and``
    binds to the stricter; an exception (``with``) lifts freedom half way to 1."""
    stack: list[tuple[float, set[str]]] = []
    for s in symbols:
        if s in _BINDS:
            (b, lb), (a, la) = stack.pop(), stack.pop()
            stack.append((max(a, b), la | lb) if s == "or" else (min(a, b), la | lb) if s == "and" else ((1 + a) / 2, la))
        else:
            label = family(s)
            stack.append((FREEDOM.get(label, 0.5), {label} if label else set()))
    return stack[-1]


class Scanner:
    def __init__(self):
        self.found = ahocorasick.Automaton()
        for phrase in {*BASE, *NOTICES, _TAG}:
            self.found.add_word(f" {phrase} ", phrase)
        self.found.make_automaton()

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        raw = text.encode("utf-8", "replace")
        folded = raw.translate(_FOLD)
        words = folded.split()
        flat = f" {b' '.join(words).decode()} "
        base, more, starts, tags = set(), set(), [], []
        for end, phrase in self.found.iter(flat):
            if phrase in BASE:
                base.add(BASE[phrase])
                starts.append(end - len(phrase) - 1)
            elif phrase in NOTICES:
                more.add(NOTICES[phrase])
            else:
                tags.append(flat.count(" ", 0, end))  # so many words end here
        score = min((FREEDOM[x] for x in base | more), default=None)
        if tags:
            ends = [m.end() for m in _WORD.finditer(folded)]
            for k in tags:
                line = raw[ends[k - 1] : raw.find(b"\n", ends[k - 1]) + 1 or None].decode("utf-8", "ignore")
                if symbols := postfix(line, _COLON.match(line).end()):
                    free, labels = evaluate(symbols)
                    more |= labels
                    score = free if score is None else min(score, free)
        first, last = (flat.count(" ", 0, min(starts)), flat.count(" ", 0, max(starts))) if starts else (None, None)
        return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if score is None else score


_scanner: list[Scanner] = []


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``score`` is how freely the text may be used: 1 without any notice, else the
    least over all notices and tag expressions found. The automaton finds the tags,
    as words, so hyphens, spaces and case don't matter; the expression is what
    follows on the line, after a colon or not. A null text is empty: no words, empty
    labels, null places. Phrases at one place all count. Rows are independent and
    may repeat: no shuffle; a task holds some ten times the text at hand.
    """
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        scan = _scanner[0].scan
        for b in batches:
            rows = [scan(x.as_py() or "") for x in b.column(1)]
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
