"""Chart updates as rows against a replay, edit by edit."""
from __future__ import annotations

import copy
import random

import pytest

from geolattice.operators import chart_updates as cu


def replay(records, attributes, lists, files):
    """records: {rec: (version, klass)}, attributes: {(rec, code, nat): value}, lists: {(rec, list): [values]}; files: [(file_no, [update])]."""
    state, last, failed = (dict(records), dict(attributes), {k: list(v) for k, v in lists.items()}), None, None
    for file_no, updates in files:
        r, a, l = copy.deepcopy(state)
        error = None
        for rec, op, version, klass, atts, ops in updates:
            if op == "insert":
                error = "inserts an existing record" if rec in r else None
                if not error:
                    a = {k: v for k, v in a.items() if k[0] != rec}
                    l = {k: v for k, v in l.items() if k[0] != rec}
                    r[rec] = (version, klass)
            elif rec not in r:
                error = "no such record"
            elif version != r[rec][0] + 1:
                error = "version mismatch"
            elif op == "delete":
                del r[rec]
            elif klass is not None and klass != r[rec][1]:
                error = "changes the class of a record"
            else:
                r[rec] = (version, r[rec][1])
            for step in sorted([(n, "a", x) for n, *x in atts] + [(n, "l", x) for n, *x in ops]):
                if error:
                    break
                if step[1] == "a":
                    code, nat, value = step[2]
                    if value is not None:
                        a[rec, code, nat] = value
                    elif a.pop((rec, code, nat), None) is None:
                        error = "deletes an absent attribute"
                else:
                    name, o, at, count, values = step[2]
                    v = l.setdefault((rec, name), [])
                    reach = at if o == "insert" else at + count
                    if at < 0 or count < 0 or reach > len(v) or (o != "delete" and len(values) != count):
                        error = "bad " + o
                    elif o == "insert":
                        v[at:at] = values
                    elif o == "delete":
                        del v[at:at + count]
                    else:
                        v[at:at + count] = values
            if error:
                failed = (file_no, rec, error)
                break
        if failed:
            break
        state, last = (r, a, l), file_no
    r, a, l = state
    return r, {k: v for k, v in a.items() if k[0] in r}, {k: v for k, v in l.items() if k[0] in r and v}, last, failed


def cell(rng, files=5, flaw=0.01):
    records = {r: (rng.randint(1, 3), rng.choice("AB")) for r in range(6)}
    attributes = {(r, c, 0): f"v{r}{c}" for r in records for c in range(3) if rng.random() < 0.7}
    lists = {(r, n): [float(10 * r + i) for i in range(rng.randint(0, 9))] for r in records for n in ("points", "edges") if rng.random() < 0.8}
    alive, at, size, made = {r: v[0] for r, v in records.items()}, dict(attributes), {k: len(v) for k, v in lists.items()}, []
    klass = {r: v[1] for r, v in records.items()}
    for f in range(1, files + 1):
        updates = []
        for _ in range(rng.randint(1, 6)):
            rec = rng.randrange(9)
            op = rng.choice(["modify", "modify", "modify", "delete"]) if rec in alive else "insert"
            if rng.random() < flaw:
                op = rng.choice(["insert", "delete", "modify"])
            version = (alive.get(rec, 0) + 1) if op != "insert" else rng.randint(1, 4)
            version += rng.random() < flaw
            kl = rng.choice("AB") if op == "insert" else klass.get(rec) if rng.random() < 0.3 else None
            atts, ops, n = [], [], 0
            if op == "insert":
                at = {k: v for k, v in at.items() if k[0] != rec}
                size = {k: v for k, v in size.items() if k[0] != rec}
                klass[rec] = kl
            if op != "delete":
                for _ in range(rng.randint(0, 5)):
                    n += 1
                    if rng.random() < 0.4:
                        code = rng.randrange(4)
                        value = None if (rec, code, 0) in at and rng.random() < 0.5 or rng.random() < flaw else f"x{f}{n}"
                        atts.append((n, code, 0, value))
                        at.pop((rec, code, 0), None) if value is None else at.__setitem__((rec, code, 0), value)
                    else:
                        name = rng.choice(["points", "edges"])
                        have = size.get((rec, name), 0)
                        o = rng.choice(["insert", "delete", "modify"]) if have else "insert"
                        k = rng.randint(0, have)
                        count = rng.randint(0, 3) if o == "insert" else rng.randint(0, have - k)
                        k += 9 * (rng.random() < flaw)
                        values = [] if o == "delete" else [float(1000 * f + 10 * n + j) for j in range(count + (rng.random() < flaw))]
                        ops.append((n, name, o, k, count, values))
                        size[rec, name] = have + (count if o == "insert" else -count if o == "delete" else 0)
                alive[rec] = version
            else:
                alive.pop(rec, None)
            updates.append((rec, op, version, kl, atts, ops))
        made.append((f, updates))
    return records, attributes, lists, made


@pytest.mark.parametrize("ops", [512, 3])
def test_updates_against_a_replay(spark, ops, monkeypatch):
    monkeypatch.setattr(cu, "OPS", ops)
    rng = random.Random(11)
    cells = {c: cell(rng, flaw=0.0 if c % 3 == 0 else 0.03) for c in range(30)}
    f = spark.createDataFrame
    base = {"records": f([(c, r, *v) for c, x in cells.items() for r, v in x[0].items()], "cell long, rec long, version int, klass string"),
            "attributes": f([(c, *k, v) for c, x in cells.items() for k, v in x[1].items()], "cell long, rec long, code int, national int, value string"),
            "lists": f([(c, r, n, i, v) for c, x in cells.items() for (r, n), vs in x[2].items() for i, v in enumerate(vs)], "cell long, rec long, list string, idx long, value double")}
    flat = [(c, no, seq, *u) for c, x in cells.items() for no, ups in x[3] for seq, u in enumerate(ups)]
    edits = {"records": f([u[:7] for u in flat], "cell long, file_no long, seq long, rec long, op string, version int, klass string"),
             "attributes": f([(*u[:3], n, u[3], *a) for u in flat for n, *a in u[7]], "cell long, file_no long, seq long, n long, rec long, code int, national int, value string"),
             "lists": f([(*u[:3], n, u[3], name, o, k, m) for u in flat for n, name, o, k, m, _ in u[8]], "cell long, file_no long, seq long, n long, rec long, list string, op string, at long, count long"),
             "values": f([(*u[:3], n, j, v) for u in flat for n, _, _, _, _, vs in u[8] for j, v in enumerate(vs)], "cell long, file_no long, seq long, n long, j long, value double")}
    got = {k: v.collect() for k, v in cu.apply_chart_updates(base, edits).items()}
    want = {c: replay(*x) for c, x in cells.items()}
    assert sorted((r.cell, r.rec, r.version, r.klass) for r in got["records"]) == sorted((c, r, *v) for c, w in want.items() for r, v in w[0].items())
    assert sorted((r.cell, r.rec, r.code, r.national, r.value) for r in got["attributes"]) == sorted((c, *k, v) for c, w in want.items() for k, v in w[1].items())
    assert sorted((r.cell, r.rec, r.list, r.idx, r.value) for r in got["lists"]) == sorted((c, r, n, i, v) for c, w in want.items() for (r, n), vs in w[2].items() for i, v in enumerate(vs))
    assert {r.cell: (r.last_file, r.failed_file and (r.failed_file, r.rec, r.error)) for r in got["cells"]} == {c: w[3:] for c, w in want.items()}
    assert len({w[4][2] for w in want.values() if w[4]}) > 3 and any(w[4] is None for w in want.values())
