"""The closed form against a sequential fold over random logs."""

import random

import pytest

from foldstore.plans.fold import EVENT, as_of, fold, registry

PK = "id"


def step(state, e):
    """One event on a dictionary (part, pk) -> {field: (type, value, off)}."""
    part, off, op, pk, doc, fields, prefixes, drop_all = e
    key = (part, pk)
    if op == "upsert":
        for f, (t, v) in doc.items():
            if 1 <= t <= 7:
                state.setdefault(key, {})[f] = (t, v, off)
    elif op == "delete_fields":
        for f in fields:
            state.get(key, {}).pop(f, None)
    elif op == "delete_doc":
        state.pop(key, None)
    elif op == "drop":
        mine = [k for k in state if k[0] == part]
        if fields or prefixes:
            for k in mine:
                for f in list(state[k]):
                    if f != PK and (f in fields or any(f.startswith(p) for p in prefixes)):
                        del state[k][f]
        elif drop_all:
            for k in mine:
                del state[k]


def random_log(seed, parts=40):
    r = random.Random(seed)
    out = []
    for part in range(parts):
        for off in range(r.randint(1, 60)):
            x, pk = r.random(), bytes([97 + r.randrange(4)])
            if x < 0.55:
                doc = {f: (r.choice([0, 5, 5, 5]), str(r.randrange(9)).encode()) for f in r.sample(["age", "agent", "city", "ci", "zip"], r.randrange(4))}
                doc[PK] = (5, pk)
                out.append((part, off, "upsert", pk, doc, [], [], False))
            elif x < 0.70:
                out.append((part, off, "delete_fields", pk, {PK: (5, pk)}, r.sample(["age", "agent", "city", PK, "none"], r.randrange(3)), [], False))
            elif x < 0.82:
                out.append((part, off, "delete_doc", pk, {PK: (5, pk)}, [], [], False))
            elif x < 0.96:
                names = r.sample(["age", "city", PK], r.randrange(2))
                prefixes = r.sample(["a", "ag", "ci", "CI", "", "i", "z"], r.randrange(2))
                out.append((part, off, "drop", None, None, names, prefixes, r.random() < 0.5))
            else:
                out.append((part, off, "noop", None, None, [], [], False))
    return out


def frame(spark, log):
    rows = [(p, o, op, pk and bytearray(pk), doc and {k: (t, bytearray(v)) for k, (t, v) in doc.items()}, f, x, a) for p, o, op, pk, doc, f, x, a in log]
    return spark.createDataFrame(rows, EVENT)


def expected(log):
    state = {}
    for e in sorted(log, key=lambda e: (e[0], e[1])):
        step(state, e)
    return sorted((p, k, f, t, v, o) for (p, k), doc in state.items() for f, (t, v, o) in doc.items())


def cells(df):
    return sorted((r.log_partition, bytes(r.pk), r.field, r.type, bytes(r.value), r.off) for r in df.collect())


@pytest.mark.parametrize("seed", [7, 8])
def test_closed_form_equals_sequential_fold(spark, seed):
    log = random_log(seed)
    assert cells(fold(frame(spark, log), PK)) == expected(log)


def test_snapshot_and_delta_and_redelivery(spark):
    log = random_log(11)
    base = fold(frame(spark, [e for e in log if e[1] < 25]), PK)
    want = expected(log)
    assert cells(fold(frame(spark, [e for e in log if e[1] >= 25]), PK, base)) == want
    assert cells(fold(frame(spark, [e for e in log if e[1] >= 15]), PK, base)) == want


def test_repeated_and_shuffled_events_change_nothing(spark):
    log = random_log(12, parts=8)
    twice = log + log
    random.Random(1).shuffle(twice)
    assert cells(fold(frame(spark, twice), PK)) == expected(log)


def test_as_of(spark):
    log = random_log(13, parts=8)
    assert cells(as_of(frame(spark, log), PK, 10)) == expected([e for e in log if e[1] <= 10])


def test_empty_log(spark):
    assert fold(spark.createDataFrame([], EVENT), PK).count() == 0


def test_registry_numbers_fields_by_first_use(spark):
    c = lambda *names: {n: (5, b"x") for n in names}
    log = [(0, 0, "upsert", b"a", c("name", PK), [], [], False), (0, 1, "upsert", b"a", c(PK, "city", "age"), [], [], False)]
    got = {r.field: (r.field_id, r.first_offset) for r in registry(frame(spark, log), PK).collect()}
    assert got == {PK: (0, 0), "name": (1, 0), "age": (2, 1), "city": (3, 1)}
