"""Further materials by a table of rules, each of which sees what those before made.

Rules are rows ``(step, pattern, into, uses, uses_unit, makes, makes_unit)``: an
alias rule has nulls after ``into``, a crafting rule has amounts. A pattern has one
star at most. Materials carry the step that made them, 0 for given ones, and a
rule applies to what was made in steps before its own; so materials and rules are
joined again and again until nothing new comes, once for each link of the longest
chain, however many rules there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.parsing import gcd
from tomewright.operators.shared import looked_up, written

MATERIAL = ("name", "amount_number", "amount_unit", "copper", "reference")
RULE = ("step", "pattern", "into", "uses", "uses_unit", "makes", "makes_unit")


def read_rules(rules: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules with amounts in base units and split patterns, rejects with reason).

    ``units`` has name, base_number and base_unit. Rejects are patterns with more
    than one star, steps below 1 or given twice, amounts given in part or not
    above zero, and unknown units.
    """
    base = lambda of: units.select(F.col("name").alias(f"{of}_unit"), F.col("base_number").alias(f"{of}_base"), F.col("base_unit").alias(f"{of}_base_unit"))
    twice = rules.groupBy("step").agg(F.count(F.lit(1)).alias("same"))
    each = rules.select(*RULE).join(base("uses"), "uses_unit", "left").join(base("makes"), "makes_unit", "left").join(twice, "step", "left")
    given = [F.col(c).isNotNull() for c in ("uses", "uses_unit", "makes", "makes_unit")]
    number = sum((g.cast("int") for g in given), F.lit(0))
    stars = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("*")))
    reason = (
        F.when(F.col("pattern").isNull() | F.col("into").isNull() | F.coalesce(F.col("step") < 1, F.lit(True)), "incomplete")
        .when(F.col("same") > 1, "step given twice")
        .when((stars("pattern") > 1) | (stars("into") > 1), "more than one star")
        .when(number.isin(1, 2, 3), "amount in part")
        .when((number == 4) & ((F.col("uses") < 1) | (F.col("makes") < 1)), "amount not above zero")
        .when((number == 4) & (F.col("uses_base").isNull() | F.col("makes_base").isNull()), "unknown unit")
    )
    each = each.withColumn("reason", reason)
    starred = F.contains("pattern", F.lit("*"))
    good = each.where("reason is null").select(
        "step", "into", starred.alias("starred"),
        F.lower(F.substring_index("pattern", "*", 1)).alias("head"),
        F.when(starred, F.lower(F.substring_index("pattern", "*", -1))).otherwise("").alias("tail"),
        (F.col("uses").cast("long") * F.col("uses_base")).alias("uses"), F.col("uses_base_unit").alias("uses_unit"),
        (F.col("makes").cast("long") * F.col("makes_base")).alias("makes"), F.col("makes_base_unit").alias("makes_unit"),
    )
    return good, each.where("reason is not null").select(*RULE, "reason")


def _keyed(rules: DataFrame) -> DataFrame:
    """A rule under what a name must be, begin with or end with, the longer of both."""
    whole = ~F.col("starred")
    front = F.length("head") >= F.length("tail")
    kind = F.when(whole, "=").when(front, "^").otherwise("$")
    return rules.withColumn("at", F.concat(kind, F.when(whole | front, F.col("head")).otherwise(F.col("tail"))))


def _keys(name: Column) -> Column:
    """All keys under which a rule may hold a name: itself, its beginnings and endings."""
    low, n = F.lower(name), F.length(name)
    ends = F.sequence(F.lit(0), n)
    begins = F.transform(ends, lambda i: F.concat(F.lit("^"), F.left(low, i)))
    tails = F.transform(ends, lambda i: F.concat(F.lit("$"), F.right(low, i)))
    return F.concat(F.array(F.concat(F.lit("="), low)), begins, tails)


def _made(frontier: DataFrame, rules: DataFrame, strict_compat: bool) -> DataFrame:
    """What ``rules`` make of ``frontier``, with the id of the material made of."""
    met = frontier.select("*", F.explode(_keys(F.col("name"))).alias("at")).join(rules, "at").where("step > made")
    low = F.lower("name")
    taken = F.length("name") - F.length("head") - F.length("tail")
    fits = F.startswith(low, F.col("head")) & F.endswith(low, F.col("tail")) & (taken >= 0) & (F.col("starred") | (taken == 0))
    star = F.substring(F.col("name"), F.length("head") + 1, taken)
    name = F.when(F.contains("into", F.lit("*")), F.concat(F.substring_index("into", "*", 1), star, F.substring_index("into", "*", -1))).otherwise(F.col("into"))
    craft, g = F.col("uses").isNotNull(), gcd(F.col("uses"), F.col("amount_number"))
    packs, times = F.col("uses") / g, F.col("amount_number") / g
    if strict_compat:
        packs, times = times, packs
    agrees = ~craft | (F.col("amount_unit") == F.col("uses_unit"))
    return met.where(fits).select(
        name.alias("name"),
        F.when(craft, (times * F.col("makes")).cast("long")).otherwise(F.col("amount_number")).alias("amount_number"),
        F.when(craft, F.col("makes_unit")).otherwise(F.col("amount_unit")).alias("amount_unit"),
        F.when(craft, (packs * F.col("copper")).cast("long")).otherwise(F.col("copper")).alias("copper"),
        "reference", F.col("step").alias("made"), F.col("id").alias("of"), F.concat(F.col("step").cast("string"), F.lit(" "), "id").alias("id"), agrees.alias("agrees"),
    )


def _judged(derived: DataFrame, given: DataFrame) -> DataFrame:
    """``derived`` with a reason where a row is refused. A name belongs to the lowest
    step that makes it from a material that stands; a step that makes it twice loses
    both. A refused material makes nothing, which may free a name; so rows are
    judged in rounds, in each of which at least the lowest open step is settled."""
    n = derived.count()
    key = F.lower("name")
    first = given.select(key.alias("key"), F.lit(0).alias("made"), F.lit(1).cast("long").alias("n"))
    now = written(derived.select("id", "of", "made", key.alias("key"), F.when(~F.col("agrees"), "unit").alias("reason"), F.col("of").startswith("0 ").alias("live"), F.lit(False).alias("stands")))
    while True:
        # of each name: the lowest step still in question, what it makes and whether all of that is sure to be made
        asked = now.where("reason is null").groupBy("key", "made").agg(F.count(F.lit(1)).alias("n"), F.bool_and("live").alias("sure"))
        asked = asked.unionByName(first.withColumn("sure", F.lit(True)))
        lowest = asked.groupBy("key").agg(F.min(F.struct("made", "n", "sure")).alias("low"))
        seen = looked_up(now, "key", lowest, n)
        open_ = F.col("reason").isNull() & ~F.col("stands") & F.col("live")
        reason = F.when(open_ & (F.col("low.made") < F.col("made")) & F.col("low.sure"), F.when(F.col("low.made") == 0, "name is there").otherwise("name made before"))
        reason = reason.when(open_ & (F.col("low.made") == F.col("made")) & F.col("low.sure") & (F.col("low.n") > 1), "made twice")
        alone = open_ & (F.col("low.made") == F.col("made")) & F.col("low.sure") & (F.col("low.n") == 1)
        told = written(seen.withColumn("reason", F.coalesce("reason", reason)).withColumn("stands", F.col("stands") | alone).drop("low"))
        parents = told.where("stands or reason is not null").select(F.col("id").alias("of"), F.col("stands").alias("parent"))
        next_ = looked_up(told, "of", parents, n)
        lost = F.col("reason").isNull() & ~F.coalesce("parent", F.lit(True))
        next_ = written(next_.withColumn("live", F.col("live") | F.coalesce("parent", F.lit(False))).withColumn("reason", F.when(lost, "made of what is refused").otherwise(F.col("reason"))).drop("parent"))
        if next_.where("reason is null and not stands").isEmpty():
            return next_.select("id", F.when((F.col("reason") == "unit") & ~F.col("live"), "made of what is refused").otherwise(F.col("reason")).alias("reason"))
        now = next_


def extended_by(materials: DataFrame, rules: DataFrame, units: DataFrame, strict_compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(materials and what the rules make of them with the step ``made``, rejects).

    ``materials`` has MATERIAL, with names that are unique but for case and amounts
    in base units. Amounts of a crafting rule are those of one application: whole
    packs are bought so that none is left. Rejects have step, name and reason:
    rules that can't be read, units that don't agree, names that are there
    already, and what would be made of such. ``strict_compat`` exchanges the two
    multipliers, as older price lists did.
    """
    good, bad = read_rules(rules, units)
    keyed = written(_keyed(good))
    given = materials.select("name", F.col("amount_number").cast("long").alias("amount_number"), "amount_unit", F.col("copper").cast("long").alias("copper"), "reference")
    given = written(given.withColumn("made", F.lit(0)).withColumn("id", F.concat(F.lit("0 "), F.lower("name"))))
    found, frontier = [], given
    while True:
        new = written(_made(frontier, keyed, strict_compat))
        if new.isEmpty():
            break
        found.append(new)
        frontier = new.where("agrees")
    columns = [*MATERIAL, "made"]
    rejects = bad.select("step", F.col("pattern").alias("name"), "reason")
    if not found:
        return given.select(*columns), rejects
    derived = found[0]
    for f in found[1:]:
        derived = derived.unionByName(f)
    judged = _judged(derived, given)
    ends = derived.join(judged, "id")
    return given.select(*columns).unionByName(ends.where("reason is null").select(*columns)), rejects.unionByName(ends.where("reason is not null").select(F.col("made").alias("step"), "name", "reason"))
