"""Material tables of documents."""

from tomewright.operators.rules import extended_by
from tomewright.operators.tables import material_rows, materials_of, read_rows, rules_of, table_rows

UNITS = [("1", 1, "1"), ("g", 1, "g"), ("kg", 1000, "g"), ("flasks", 1, "1"), ("ml", 1, "ml")]
BODY = r"""Name & What & Price \\
Salt {\bf \\ white} & \grUnit{2 [kg]} & 3 \Cu \\
\grMaterial{oil}\grMaterial{fat} Oils & \grOtherUnit{12 flasks} of \grUnit*{20 [ml]} & 1 \Ag \\
Early & \grVariants{1 \Cu/2 \Cu} & \\
\grDeclareVariants{small/large} sizes & & \\
Rock & \grVariants{ 1 \Cu/ 2 \Ag } & \\
Stone & \grVariants{1 \Cu} & \\
\grDeclareVariants{one} \\
Gem & \grVariants{5 \Au} \\
\grMaterial{lost} & x & y \\
Half & \grOtherUnit{2 x} & \\
Both & \grUnit{1} \grVariants{1 \Cu} & 2 \Cu \\
Word & \grUnit{some kg} & 2 \Cu \\
Free & \grUnit{1} & nothing \\
Priced & \grUnit{1 [g]} \grPrice*{4 \Cu} & see note \\
Meas & \grUnit{1} \grOtherUnit{2 [kg]} & 1 \Cu \\
\begin{tabular}{l} a \\ b \& c \end{tabular} & plain \\
\grPost{Salt*}{500 [g]}{brine*}{2} \grPost{rock*}{}{pebble*}{}"""


def test_a_table(spark):
    tables = spark.createDataFrame([(1, "p. 4", BODY), (2, "p. 9", r"Lone & \grVariants{1 \Cu}"), (3, None, "")], "table_id int, reference string, body string")
    units = spark.createDataFrame(UNITS, "name string, base_number int, base_unit string")
    rows = read_rows(table_rows(tables)).cache()
    assert rows.where("table_id = 1").count() == 18 and rows.where("table_id = 3").count() == 0
    good, bad = material_rows(rows, units)
    made = {(r.name, r.amount_number, r.amount_unit, r.copper) for r in materials_of(good, ["table_id"]).collect()}
    assert made == {
        ("Salt white", 2, "kg", 3), ("oil", 240, "ml", 36), ("flasks of oil", 12, "1", 36), ("fat", 240, "ml", 36), ("flasks of fat", 12, "1", 36),
        ("small Rock", 1, "1", 1), ("large Rock", 1, "1", 72), ("one Gem", 1, "1", 5 * 432), ("Priced", 1, "g", 4),
    }
    assert sorted((r.table_id, r.row, r.reason) for r in bad.collect()) == [
        (1, 3, "variants without declaration"), (1, 6, "number of variants differs"), (1, 9, "incomplete material definition"), (1, 10, "other unit without unit"),
        (1, 11, "unit and variants mixed"), (1, 12, "bad amount"), (1, 13, "bad price"), (1, 15, "other unit is not dimensionless"), (2, 0, "variants without declaration"),
    ]
    rules = rules_of(rows, ["table_id"]).orderBy("row", "place").collect()
    assert [tuple(r)[3:] for r in rules] == [("Salt*", "brine*", 500, "g", 2, "1"), ("rock*", "pebble*", None, None, None, None)]
    materials = spark.createDataFrame([("Salt", 2000, "g", 3, None)], "name string, amount_number int, amount_unit string, copper long, reference string")
    table = spark.createDataFrame([(i + 1, *tuple(r)[3:]) for i, r in enumerate(rules)], "step int, pattern string, into string, uses int, uses_unit string, makes int, makes_unit string")
    out, _ = extended_by(materials, table, units)
    assert {(r.name, r.amount_number, r.copper) for r in out.collect()} == {("Salt", 2000, 3), ("brine", 8, 3)}
