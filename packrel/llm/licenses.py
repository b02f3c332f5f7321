"""License scan: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

A text's words, lower-cased (A-Z), are joined by single blanks; one automaton of all phrases, each
between blanks, then finds every place where a phrase's words stand consecutively, overlaps
included.  Base phrases give the base columns.  The method adds more notice phrases and identifier
tags ("SPDX-License-Identifier: ..."): the expression behind a tag is cut into identifiers, AND,
OR, WITH and brackets, brought to postfix by the shunting-yard algorithm (WITH binds closest, then
AND, then OR) and evaluated: to the licences it names, and (``permits``) to whether given licences
satisfy it.  The automaton also tells where tags stand; a second one, run over the texts that hold
one, gives their places in the text as it is written.  All of it is linear in the text.

Defined cases: null and empty texts have no words, no places and no labels ('' and null); of what
stands behind a tag the longest well-formed expression up to the line's end counts, however long,
and a tag without one gives no label; every row is scanned, repeated ones too; other columns are
not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices.  A label's longest phrase need not hold the others.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl-1",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "creative commons zero": "cc0",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Labels of identifiers whose version isn't part of the label.
IDENTIFIERS = {"mit": "mit", "apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "mpl-2.0": "mpl-2", "bsl-1.0": "bsl-1", "cc0-1.0": "cc0"}
#: The words of an identifier tag, as they stand among a text's words, and the tag as it is written.
TAG_WORDS, TAG = "spdx license identifier", "spdx-license-identifier:"
#: An expression ends with its line, at the latest.
_LINE_END = re.compile(rb"[\r\n\x0b\x0c\"'<>*]")
_TOKEN = re.compile(r"[()]|[^\s()]+")
_IDENTIFIER = re.compile(r"[a-z0-9][a-z0-9.+:-]*\Z")
#: ASCII that is neither digit nor letter parts words.
_BLANK = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))
PRIORITY = {"or": 1, "and": 2, "with": 3}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_BLANK).split()


def postfix(expression: str) -> list[str] | None:
    """The expression's tokens in postfix order; None if it isn't well formed."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # what has to come next
    for token in re.findall(r"[()]|[^\s()]+", expression):
        low = token.lower()
        if low in PRIORITY:
            if operand:
                return None
            while held and held[-1] != "(" and PRIORITY[held[-1]] >= PRIORITY[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                return None
            out.append(low)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> tuple[frozenset[str], frozenset[frozenset[str]]] | None:
    """(identifiers named, alternatives that satisfy the expression)."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[frozenset, frozenset]] = []
    for token in order:
        if token not in PRIORITY:
            stack.append((frozenset([token]), frozenset([frozenset([token])])))
            continue
        (names_b, ways_b), (names_a, ways_a) = stack.pop(), stack.pop()
        if token == "with":  # an exception belongs to its licence
            stack.append((names_a, ways_a))
        elif token == "or":
            stack.append((names_a | names_b, ways_a | ways_b))
        else:
            stack.append((names_a | names_b, frozenset(a | b for a in ways_a for b in ways_b)))
    return stack[0]


def permits(order: list[str], allowed: frozenset[str] | set[str]) -> bool:
    """Whether the licences in ``allowed`` satisfy an expression in postfix order; one step a token."""
    stack: list[bool] = []
    for token in order:
        if token not in PRIORITY:
            stack.append(token in allowed)
            continue
        b, a = stack.pop(), stack.pop()
        stack.append(a if token == "with" else a or b if token == "or" else a and b)
    return stack[0]


def named(order: list[str]) -> set[str]:
    """The licences, without exceptions, that an expression in postfix order names."""
    stack: list[list[str]] = []  # what each operand begins with; an exception is one token before WITH
    out: set[str] = set()
    for token in order:
        if token not in PRIORITY:
            stack.append([token])
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            out.update(a)
            stack.append([])
        else:
            out.update(a, b)
            stack.append([])
    out.update(*stack)
    return out


def longest_expression(line: str) -> str:
    """The longest well-formed expression that a line begins with, '' if there is none.

    One pass: a place ends an expression if an operand has just been completed outside brackets.
    """
    end = depth = 0
    operand = True
    for m in _TOKEN.finditer(line):
        token = m[0].lower()
        if token == "(":
            if not operand:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth -= 1
        elif token in PRIORITY:
            if operand:
                break
            operand = True
        else:
            bare = token.rstrip(".,;:")
            if not operand or not _IDENTIFIER.match(bare):
                break
            operand = False
            if not depth:
                end = m.start() + len(bare)
            if bare != token:  # punctuation ends the expression
                break
            continue
        if not operand and not depth:
            end = m.end()
    return line[:end].strip()


def label_of(identifier: str) -> str:
    bare = re.sub(r"(-only|-or-later|\+)$", "", identifier)
    return IDENTIFIERS.get(bare, bare)


@lru_cache(maxsize=4)
def _automaton(phrases: tuple[tuple[str, str, bool], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label, base in phrases:
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, base))
    found.add_word(f" {TAG_WORDS} ", (0, "", False))
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def _tag_automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word(TAG, len(TAG))
    found.make_automaton()
    return found


def tags_of(text: str) -> list[tuple[str, list[str]]]:
    """Expressions behind the identifier tags of a text, and their postfix order."""
    raw = text.encode().lower()
    out = []
    for last, _ in _tag_automaton().iter(raw.decode("latin-1")):
        stop = _LINE_END.search(raw, last + 1)
        expression = longest_expression(raw[last + 1 : stop.start() if stop else len(raw)].decode("utf-8", "replace"))
        if expression and (order := postfix(expression)):
            out.append((expression, order))
    return out


def scan(text: str | None, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> dict:
    """n_words, base places [(first word, label)], labels of notices, evaluated tags and a score.

    score: 1 for a parsed identifier tag; else each label found by a phrase leaves a fifth of the
    doubt, and the mere word a further three fifths of it.
    """
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    known = {p for p in base}
    automaton = _automaton((*((p, x, True) for p, x in base.items()), *((p, x, False) for p, x in notices.items() if p not in known)))
    w = words(text)
    joined = b" " + b" ".join(w) + b" "
    plain = joined.decode("latin-1")  # one character a byte; the phrases are ASCII
    places, more, tagged = [], set(), False
    at = word = 0
    for end, (n, label, is_base) in automaton.iter(plain):
        if is_base:
            start = end - n + 1
            if start < at:
                at = word = 0
            word += joined.count(b" ", at, start)
            at = start
            places.append((word, label))
        elif label:
            more.add(label)
        else:
            tagged = True
    labels = more | {x for _, x in places}
    doubt = 0.2 ** len(labels) * (0.6 if b" license " in joined or b" licence " in joined else 1.0)
    tags = tags_of(text or "") if tagged else []
    for _, order in tags:
        labels |= {label_of(x) for x in named(order)}
    score = 1.0 if tags else 1.0 - doubt
    return {"n_words": len(w), "places": places, "labels": labels, "tags": tags, "score": score}


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, places (array of word, label), labels, expressions, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            got = [scan(t.as_py(), base, notices) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x["n_words"] for x in got], pa.int64()),
                    pa.array([[{"word": w, "label": s} for w, s in x["places"]] for x in got], place),
                    pa.array([sorted(x["labels"]) for x in got], pa.list_(pa.string())),
                    pa.array([[raw for raw, _ in x["tags"]] for x in got], pa.list_(pa.string())),
                    pa.array([x["score"] for x in got], pa.float64()),
                ],
                ["doc_id", "n_words", "places", "labels", "expressions", "score"],
            )

    schema = f"doc_id {kind}, n_words long, places array<struct<word:long,label:string>>, labels array<string>, expressions array<string>, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
