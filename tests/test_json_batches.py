"""JSON functions hold the values of one run of a batch, not of all of it."""

import tracemalloc

import pyarrow as pa

from linewright.functions import json_values


class _Kept:
    def __init__(self, kept, function):
        kept.append(function)

    def asNondeterministic(self):
        return None


def test_values_of_a_large_batch_are_not_held_at_once(monkeypatch):
    kept = []
    monkeypatch.setattr(json_values.F, "arrow_udf", lambda function, kind: _Kept(kept, function))
    json_values.fix_line_udf.__wrapped__()
    batch = pa.array(['{"text":"' + "ab" * 1000 + '"}'] * 10_000)
    tracemalloc.start()
    found = kept[0](batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 10_000
    assert peak < batch.nbytes / 2
