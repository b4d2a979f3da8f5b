"""Rules that make materials, against applying them one after the other."""

import random
from math import gcd

from tomewright.operators.rules import extended_by

UNITS = [("1", 1, "1"), ("g", 1, "g"), ("kg", 1000, "g"), ("dozen", 12, "1")]
UNIT = {n: (k, b) for n, k, b in UNITS}
RULES = "step int, pattern string, into string, uses int, uses_unit string, makes int, makes_unit string"
MATERIALS = "name string, amount_number int, amount_unit string, copper long, reference string"


def capture(name, pattern):
    low, (head, star, tail) = name.lower(), pattern.lower().partition("*")
    if not star:
        return "" if low == head else None
    fits = low.startswith(head) and low.endswith(tail) and len(low) >= len(head) + len(tail)
    return name[len(head) : len(name) - len(tail)] if fits else None


def apply(materials, rules, compat=False):
    """One rule after the other over all that is there. A rule's result is refused if
    its name is there or the rule makes it twice, or its unit doesn't agree."""
    have = {m[0].lower(): (*m, 0) for m in materials}
    refused = []
    for step, pattern, into, uses, uses_unit, makes, makes_unit in sorted(rules):
        new = []
        for name, number, unit, copper, ref, _ in list(have.values()):
            taken = capture(name, pattern)
            if taken is None:
                continue
            made = into.replace("*", taken)
            if uses is not None:
                u, m = uses * UNIT[uses_unit][0], makes * UNIT[makes_unit][0]
                if UNIT[uses_unit][1] != unit:
                    refused.append((step, made, "unit"))
                    continue
                packs, times = u // gcd(u, number), number // gcd(u, number)
                if compat:
                    packs, times = times, packs
                new.append((made, times * m, UNIT[makes_unit][1], packs * copper, ref, step))
            else:
                new.append((made, number, unit, copper, ref, step))
        keys = [n[0].lower() for n in new]
        for n, k in zip(new, keys, strict=True):
            if k in have:
                refused.append((step, n[0], "name is there" if have[k][5] == 0 else "name made before"))
            elif keys.count(k) > 1:
                refused.append((step, n[0], "made twice"))
        have |= {k: n for n, k in zip(new, keys, strict=True) if k not in have and keys.count(k) == 1}
    return set(have.values()), refused


def run(spark, materials, rules, **options):
    units = spark.createDataFrame(UNITS, "name string, base_number int, base_unit string")
    rows, bad = extended_by(spark.createDataFrame(materials, MATERIALS), spark.createDataFrame(rules, RULES), units, **options)
    return [tuple(r) for r in rows.collect()], [tuple(r) for r in bad.collect()]


def test_a_chain_of_three_rules(spark):
    materials = [("Iron Ore", 5, "g", 3, "p. 1"), ("gold ore", 2, "g", 70, None), ("rope", 1, "1", 4, None)]
    rules = [(1, "* ore", "* ingot", 12, "g", 1, "1"), (2, "* INGOT", "* nail", 1, "1", 2, "dozen"), (3, "* nail", "box of * nails", None, None, None, None), (4, "Rope", "cord", None, None, None, None)]
    rows, bad = run(spark, materials, rules)
    assert set(rows) == apply(materials, rules)[0] and len(rows) == 3 + 2 * 3 + 1 and bad == []
    compat, _ = run(spark, materials, rules, strict_compat=True)
    assert set(compat) == apply(materials, rules, compat=True)[0]


def test_random_rules(spark):
    """Rules of all kinds over colliding names; what one refusal frees another step may make."""
    for seed in range(4):
        rng = random.Random(seed)
        names = ["a x", "b x", "a y", "bb", "A Z", "x", "ba xx"]
        materials = [(n, rng.randint(1, 6), rng.choice(["1", "g"]), rng.randint(1, 9), None) for n in names]
        patterns = ["* x", "a *", "*", "bb", "*x", "b*x", "a y", "q*", "c *"]
        rules = []
        for step in range(1, 9):
            craft = rng.random() < 0.5
            amounts = (rng.randint(1, 4), rng.choice(["1", "g", "dozen"]), rng.randint(1, 3), rng.choice(["kg", "1"])) if craft else (None,) * 4
            rules.append((step, rng.choice(patterns), rng.choice(["* y", "c *", "q", "x*", "b *"]), *amounts))
        rows, bad = run(spark, materials, rules)
        want, refused = apply(materials, rules)
        assert set(rows) == want and len(rows) == len(want), seed
        assert {(s, n.lower(), r) for s, n, r in refused} <= {(s, n.lower(), r) for s, n, r in bad}
        assert all(r == "made of what is refused" or (s, n.lower(), r) in {(a, b.lower(), c) for a, b, c in refused} for s, n, r in bad)


def test_rules_that_cannot_be_read(spark):
    rules = [
        (1, "a*b*", "x", None, None, None, None), (2, "a", "b", 1, None, 1, "1"), (3, "a", "c", 0, "1", 1, "1"), (4, "a", "d", 1, "ell", 1, "1"),
        (5, "a", "e", None, None, None, None), (5, "a", "f", None, None, None, None), (0, "a", "g", None, None, None, None), (7, None, "h", None, None, None, None),
        (8, "a", "ok", None, None, None, None),
    ]
    rows, bad = run(spark, [("a", 1, "1", 2, None)], rules)
    assert {r[0] for r in rows} == {"a", "ok"}
    assert sorted((s, r) for s, _, r in bad) == [
        (0, "incomplete"), (1, "more than one star"), (2, "amount in part"), (3, "amount not above zero"), (4, "unknown unit"), (5, "step given twice"), (5, "step given twice"), (7, "incomplete"),
    ]


def test_no_rules_and_no_materials(spark):
    assert run(spark, [("a", 1, "1", 2, None)], []) == ([("a", 1, "1", 2, None, 0)], [])
    assert run(spark, [], [(1, "*", "x", None, None, None, None)]) == ([], [])
