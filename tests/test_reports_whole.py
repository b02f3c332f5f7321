"""The extraction report over all entries, against a loop over the plan."""

import os

import pytest

from packrel.plans import catalog
from packrel.plans.relations import entries_docs

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_report_against_brute_force(spark):
    size = {(r.archive, r.entry_idx): (r.path, r.size) for r in entries_docs(spark, SF).collect()}
    want = {}
    for r in sorted(catalog.queries()["extraction_plan"](spark, SF).collect(), key=lambda r: r.entry_idx):
        w = want.setdefault(r.archive, {"seen": {}, "mkdir": 0, "symlink": 0, "hardlink": 0, "skip_ext": 0, "twice": 0, "code": None})
        if w["code"]:
            continue
        path, n = size[r.archive, r.entry_idx]
        path = "/".join(x for x in path.split("/") if x not in ("", "."))
        if r.code:
            w["code"] = r.code
        elif r.action != "write":
            w[r.action] += 1
        elif path in w["seen"]:
            w["twice"] += 1
        else:
            w["seen"][path] = n
    got = catalog.queries()["extraction_report"](spark, SF).collect()
    assert {r.archive for r in got} == set(want)
    assert {r.error_code for r in got} - {None, "QUOTA_EXCEEDED"}
    for r in got:
        w = want[r.archive]
        assert (r.files_extracted, r.bytes_written, r.duplicates_skipped) == (len(w["seen"]), sum(w["seen"].values()), w["twice"])
        assert (r.directories_created, r.symlinks_created, r.hardlinks_deferred, r.extensions_skipped, r.error_code) == (w["mkdir"], w["symlink"], w["hardlink"], w["skip_ext"], w["code"])
