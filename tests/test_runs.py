"""Run records: errors up to the root."""

import random
import time

from foliant.operators import runlog


def test_errors_climb_any_depth(spark):
    """Chains of a thousand spans, random trees, a ring, lost parents and null ids, against a walk from parent to parent."""
    rng = random.Random(1)
    rows = [("chain", k, k - 1 if k else None, "bad" if k in (990, 3) else None) for k in range(1000)]
    for t in range(20):
        rows += [(f"t{t}", k, rng.randrange(k) if k else None, "bad" if rng.random() < 0.05 else None) for k in range(60)]
    rows += [("ring", k, (k + 1) % 5, "bad" if k == 2 else None) for k in range(5)] + [("lost", 1, 99, "bad"), ("lost", 2, 1, None), ("null", None, 1, "bad"), ("null", 1, None, None), (None, 1, None, "bad")]
    parent = {(t, s): p for t, s, p, _ in rows}
    want = {(t, s) for t, s, _, e in rows if e}
    for t, s, _, e in rows:
        at, seen = (t, s), set()
        while e and s is not None and t is not None and at not in seen and at in parent and parent[at] is not None:
            seen.add(at)
            at = (t, parent[at])
            want.add(at)
    began = time.time()
    got = runlog.with_status(spark.createDataFrame(rows, "trace_id string, span_id long, parent_id long, error string")).collect()
    assert time.time() - began < 120 and len(got) == len(rows)
    assert {(r.trace_id, r.span_id) for r in got if r.status == "ERROR"} == {x for x in want if x in parent}
