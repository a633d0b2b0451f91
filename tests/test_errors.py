"""Alignment columns and difference lists against a walk over the operations."""

import random
import re

from tidemark.operators import errors, reads

SCHEMA = "id long, cigar string, query string, target string, qs int, ts int"


def made(n):
    rnd = random.Random(n)
    out = []
    for i in range(n):
        target = "".join(rnd.choice("ACGTN") for _ in range(120))
        query, t, ops = "", 10, []
        for k in range(rnd.randrange(1, 8)):
            op, size = ("M" if k % 2 == 0 else rnd.choice("ID")), rnd.randrange(1, 12)
            ops.append(f"{size}{op}")
            if op == "M":
                query += "".join(c if rnd.random() < 0.8 else rnd.choice("ACGTN") for c in target[t : t + size])
            elif op == "I":
                query += rnd.choice(["N" * size, "".join(rnd.choice("ACGTN") for _ in range(size))])
            t += size * (op != "I")
        out.append((i, "".join(ops), "GG" + query, target, 2, 10))
    return out


def walk(cigar, query, target, q, t):
    cols = []
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        for _ in range(int(n)):
            base, ref = ("" if op == "D" else query[q]), ("" if op == "I" else target[t])
            cols.append(("insertion" if op == "I" else "deletion" if op == "D" else "match" if base == ref else "mismatch", base, ref))
            q, t = q + (op != "D"), t + (op != "I")
    return cols


def named(cigar, query, target, q, t):
    at, names, bad = 1, [], 0
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        if op == "M":
            for k in range(n):
                if query[q + k] != target[t + k]:
                    bad += 1
                    names += [f"{at + k}{target[t + k]}>{query[q + k]}"] * (query[q + k] != "N")
        elif op == "I":
            bad += n
            names += [f"{at}+{query[q : q + n]}"] * bool(query[q : q + n].strip("N"))
        else:
            bad += n
            names += [f"{at + k}-{target[t + k]}" for k in range(n)]
        q, t, at = q + n * (op != "D"), t + n * (op != "I"), at + n * (op != "I")
    return " ".join(names) or "*", bad


def test_columns_and_lists(spark):
    rows = made(60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in errors.columns(df).orderBy("id", "i").collect():
        got.setdefault(r.id, []).append((r.kind, r.base, r.ref))
    assert got == {r[0]: walk(*r[1:]) for r in rows}
    want = {r[0]: named(*r[1:]) for r in rows}
    rates = {r[0]: 100 * want[r[0]][1] // len(r[2]) for r in rows}
    told = errors.differences(df, 40).collect()
    assert {r.id: (r.differences, r.errors) for r in told} == {i: w for i, w in want.items() if rates[i] <= 40}
    assert all(r.rate == rates[r.id] for r in told)


def test_alignments_that_cannot_be_read_are_left_out(spark):
    rows = [(1, "5S4M", "ACGTACGTA", "ACGTACGTA", 0, 0), (2, "10M", "ACGT", "ACGTACGTAC", 0, 0), (3, "4M3D", "ACGT", "ACGTA", 0, 0), (4, "4M", "ACGT", "ACGT", 0, 0), (5, "*", "ACGT", "ACGT", 0, 0)]
    assert [tuple(r) for r in errors.differences(spark.createDataFrame(rows, SCHEMA)).collect()] == [(4, "*", 0, 0)]
    cols = errors.columns(spark.createDataFrame(rows[:1], SCHEMA))
    assert [r.base for r in cols.orderBy("i").collect()] == list("CGTA")  # the letters behind the clipped ones
    assert sum(r.n for r in reads.error_rates(errors.known(cols)).collect()) == 4
