import re

import pytest

from packrel.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(places)


@pytest.mark.parametrize("text", ["", None, "Under the MIT License.", "under the mit licenses", "CC BY-NC 4.0 cc-by-nc-nd", "Apache License, Version 2.0 É under the mit license under THE mit-license", "x" * 10_000 + " cc by nc", "ſ cc by nc K"])
def test_base_places(text):
    got = L.scan(text)
    assert (got["n_words"], sorted(got["places"])) == brute(text)


def test_expressions():
    assert L.postfix("MIT OR Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0") == ["mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0", "with", "and", "or"]
    names, ways = L.evaluate("(MIT OR Apache-2.0) AND BSD-3-Clause")
    assert names == {"mit", "apache-2.0", "bsd-3-clause"} and ways == {frozenset(["mit", "bsd-3-clause"]), frozenset(["apache-2.0", "bsd-3-clause"])}
    for bad in ("", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT GPL", "()"):
        assert L.evaluate(bad) is None
    got = L.scan("// SPDX-License-Identifier: MIT OR GPL-2.0-only */\nSPDX-License-Identifier: ((\n")
    assert got["labels"] == {"mit", "gpl-2"} and got["score"] == 1.0 and len(got["tags"]) == 1
    assert L.scan("licensed under the GNU General Public License, version 3.")["labels"] == {"gpl-3"}


def test_rows(odd, none, odd_rows):
    got = L.scan_licenses(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert 0 <= r.score <= 1
    assert [r.labels for r in got if r.doc_id == 6] == [["mit"]]
    assert L.scan_licenses(none).collect() == []


def test_long_expressions_and_what_stands_behind_them():
    long = " AND ".join(["(MIT OR Apache-2.0)"] * 250)  # 2 ** 250 ways to satisfy it
    assert len(long) > 5000
    got = L.scan(f"// SPDX-License-Identifier: {long}\n")
    assert got["labels"] == {"mit", "apache-2"} and len(got["tags"]) == 1
    order = L.postfix(long)
    assert L.permits(order, {"mit"}) and not L.permits(order, {"gpl-2.0"})
    assert L.scan("SPDX-License-Identifier: MIT Copyright X")["labels"] == {"mit"}
    assert L.scan("x SPDX-License-Identifier: MIT.\x0bGPL-2.0")["labels"] == {"mit"}
    assert L.scan("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 OR MIT\x0cBSD")["labels"] == {"gpl-2", "mit"}
    assert L.scan("SPDX-License-Identifier: (MIT OR")["labels"] == set()
    assert L.scan("spdx license identifier: MIT")["tags"] == []
    order = L.postfix("MIT AND GPL-2.0 WITH Classpath-exception-2.0 OR BSD-3-Clause")
    assert L.permits(order, {"mit", "gpl-2.0"}) and L.permits(order, {"bsd-3-clause"}) and not L.permits(order, {"mit"})
    assert L.named(order) == {"mit", "gpl-2.0", "bsd-3-clause"}


def test_permits_agrees_with_the_ways():
    for text in ("MIT", "MIT OR A AND B", "(MIT OR A) AND (B OR C WITH x)", "A AND B AND C OR MIT"):
        names, ways = L.evaluate(text)
        order = L.postfix(text)
        assert L.named(order) == names
        for bits in range(1 << len(names)):
            allowed = {x for k, x in enumerate(sorted(names)) if bits >> k & 1}
            assert L.permits(order, allowed) == any(w <= allowed for w in ways)
