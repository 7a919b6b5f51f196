"""Classes of map objects by rules over (class, type), as column expressions and as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, list[tuple[str, list[str] | None]]]

# Rules over map classes and types; None stands for every type of the class. The first match wins.
CATEGORIES: list[Rule] = [
    ("alcohol_venue", [("amenity", ["bar", "pub", "nightclub", "biergarten"]), ("craft", ["brewery"])]),
    ("alcohol_retail", [("shop", ["alcohol", "wine"])]),
    ("social_facility", [("amenity", ["social_facility"])]),
    ("healthcare", [("amenity", ["hospital", "clinic", "doctors", "pharmacy"]), ("healthcare", ["clinic", "centre"])]),
    ("restaurant", [("amenity", ["restaurant", "cafe"])]),
    ("fast_food", [("amenity", ["fast_food", "food_court"])]),
    ("park", [("leisure", ["park", "nature_reserve", "garden", "recreation_ground"])]),
    ("grocery", [("shop", ["convenience", "supermarket", "general", "grocery"])]),
]
VISITS: list[Rule] = [
    ("alcohol_on_premise", [("amenity", ["bar", "pub", "nightclub", "biergarten", "casino", "stripclub"]), ("craft", ["brewery", "distillery", "winery"])]),
    ("alcohol_off_premise", [("shop", ["alcohol", "wine"])]),
    ("healthcare", [("amenity", ["hospital", "clinic", "doctors", "dentist", "pharmacy", "social_facility", "veterinary", "nursing_home"]), ("healthcare", None), ("emergency", ["emergency_ward_entrance", "ambulance_station"])]),
]
PREMISE_PINGS: list[Rule] = [("on_premise", [("amenity", ["bar", "pub", "nightclub", "biergarten"]), ("craft", ["brewery"])]), ("off_premise", [("shop", ["alcohol", "wine"])])]
PREMISE_GRID: list[Rule] = [("on_premise", [("amenity", ["bar", "pub", "nightclub", "biergarten"])]), ("off_premise", [("shop", ["alcohol", "wine"]), ("craft", ["brewery"])])]
NOT_VISITABLE: list[Rule] = [
    (
        "excluded",
        [
            ("man_made", None),
            ("military", None),
            ("amenity", "parking bench bicycle_parking shelter toilets waste_basket waste_disposal recycling post_box vending_machine atm charging_station loading_dock drinking_water fountain bicycle_repair_station clock post_depot letter_box telephone trolley_bay hunting_stand compressed_air vacuum_cleaner payment_terminal water_point dressing_room shower weighbridge sanitary_dump_station boat_storage bbq lounger smoking_area grit_bin give_box reception_desk binoculars check_in watering_place water table fridge kitchen stage piano dog_toilet dog_wash brake_check_area pet_relief_area bicycle_rental motorcycle_parking moped_parking parcel_locker public_bookcase library_dropoff polling_station outdoor_seating bell waste_transfer_station baking_oven street_vendor car_sharing".split() + ["Isolation tank"]),
            ("leisure", "pitch bleachers picnic_table slipway firepit fitness_station bicycle_rental yes scoreboard diving_board practice_pitch lazy_river pit long_jump paddling_pool outdoor_seating hot_tub".split()),
            ("tourism", ["information"]),
            ("historic", "railway memorial maritime monument marker police_phone police_telephone wayside_shrine bell".split()),
            ("emergency", "phone siren designated psap lifeguard life_ring defibrillator access_point fire_service_inlet fire_extinguisher water_tank assembly_point first_aid_kit suction_point fire_training".split()),
            ("natural", ["tree", "rock", "stone"]),
            ("shop", ["vacant"]),
        ],
    )
]
POI_CLASSES = ["amenity", "shop", "leisure", "tourism", "healthcare", "craft", "office", "historic", "emergency", "natural", "man_made", "military"]


def _test(cls: str, types: list[str] | None, class_col: Column, type_col: Column) -> Column:
    same = class_col == cls
    return same if types is None else same & type_col.isin(types)


def matches(rule: Rule, class_col: str | Column = "class", type_col: str | Column = "type") -> Column:
    """Whether a rule holds, in three-valued logic: a null class or type can leave it open."""
    c, t = (F.col(x) if isinstance(x, str) else x for x in (class_col, type_col))
    out = None
    for cls, types in rule[1]:
        one = _test(cls, types, c, t)
        out = one if out is None else out | one
    return out


def classify(rules: list[Rule], other: str | None = None, class_col: str | Column = "class", type_col: str | Column = "type") -> Column:
    """Label of the first rule that holds, else ``other``; nulls hold no rule."""
    case = F
    for r in rules:
        case = case.when(matches(r, class_col, type_col), r[0])
    return case.otherwise(F.lit(other)) if other is not None else case


def matches_sql(rule: Rule) -> str:
    parts = ["(class = '%s'%s)" % (c, "" if t is None else " AND type IN (" + ", ".join(f"'{x}'" for x in t) + ")") for c, t in rule[1]]
    return "(" + " OR ".join(parts) + ")"


def classify_sql(rules: list[Rule], other: str | None = None) -> str:
    return "CASE " + " ".join(f"WHEN {matches_sql(r)} THEN '{r[0]}'" for r in rules) + (f" ELSE '{other}'" if other else "") + " END"
