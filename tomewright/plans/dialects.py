"""Dialects of three kinds of catalogue: which columns their terms look at, their
headers, and the comparers of columns that don't sort by their own value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright.functions.quantity import ACTION_UNITS, TURN_UNITS, distance, duration, least_quantity
from tomewright.functions.text import in_language
from tomewright.plans.search import Dialect


def _by(value, text: str):
    """Sort keys of a column: valid quantities by size, then the rest by text."""

    def keys() -> list[Column]:
        at = F.struct(value(F.col(text)).alias("v"), F.col(text).alias("t"))
        invalid = F.coalesce((at["v"] == 0) | F.isnan(at["v"]), F.lit(True))
        return [invalid, F.when(~invalid, at["v"]), F.when(invalid, at["t"])]

    return keys


def _placed(order: dict[str, int], column: str):
    """The number that a fixed list gives to each value."""

    def keys() -> list[Column]:
        return [F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in order.items()])]

    return keys


#: The difficulty of a power level, and the order of arcana.
POWER_LEVELS = {"Generalist": 15, "Petty": 15, "Lesser": 22, "Greater": 30, "Ritual": 0}
ARCANA = {"General": 0, "Nature": 1, "Elementalism": 2, "Charms": 3, "Conjuration": 4, "Divine": 5, "Ritual": 6, "Wytch": 7, "Celestial": 8}

# The columns that terms, full text and tables of each kind of catalogue name.

#: Entries with levels, schools and classes; terms reach hints and material costs.
LEVELLED = Dialect(
    level="level", exact=("school", "casting_time", "duration"), exact_lists=("classes",), flags=("verbal", "somatic", "ritual", "concentration", "upcast"),
    materials="materials", hint="hint", priced=True, prepared="prepared", texts=("description", "upcast", "stat_block"), cards=("level", "name"),
    headers=("level", "school", "casting_time", "ritual", "concentration", "source"),
    comparers={"casting_time": _by(lambda c: least_quantity(c, ACTION_UNITS), "casting_time")},
)

#: Entries with an arcanum and a power level; components are priced one by one.
ARCANE = Dialect(
    source=None, exact=("arcanum", "power_level", "distance", "duration", "casting_time"), flags=("combat", "reaction"), components="components",
    prepared="prepared", texts=("brief", "effect", "crit_success", "crit_fail", "extra"), cards=("name",),
    headers=("power_level", "arcanum", "casting_time", "duration", "distance", "combat", "reaction"),
    comparers={
        "power_level": _placed(POWER_LEVELS, "power_level"), "arcanum": _placed(ARCANA, "arcanum"),
        "casting_time": _by(lambda c: least_quantity(c, TURN_UNITS), "casting_time"), "duration": _by(duration, "duration"), "distance": _by(distance, "distance"),
    },
)

#: Entries with levels, tags and traditions, and a save by name. Their times are
#: known in seconds, their ranges in feet; of ranges without any, the text decides.
TRAITED = Dialect(
    source=None, level="level", exact=("range", "area", "duration", "casting_time"), exact_lists=("tags", "traditions"), save="save",
    component_text="components", prepared="prepared", texts=("description", "reaction", "summary"), cards=("name",), local=True,
    headers=("level", "range", "casting_time", "components"),
    comparers={
        "casting_time": lambda: [F.col("seconds")],
        "range": lambda: [F.col("feet"), F.when(F.col("feet") == 0, in_language(F.col("range")))],
        "components": lambda: [F.length("components"), in_language(F.col("components"))],
    },
)
