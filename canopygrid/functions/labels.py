"""Names of forest groups, forest types and ecozones.

Group and type codes are those of the national forest inventory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
FOREST_GROUPS = {
    0: "Non-forest",
    100: "White/Red/Jack Pine Group",
    120: "Spruce/Fir Group",
    140: "Longleaf/Slash Pine Group",
    160: "Loblolly/Shortleaf Pine Group",
    180: "Pinyon/Juniper Group",
    200: "Douglas-fir Group",
    220: "Ponderosa Pine Group",
    240: "Western White Pine Group",
    260: "Fir/Spruce/Mountain Hemlock Group",
    280: "Lodgepole Pine Group",
    300: "Hemlock/Sitka Spruce Group",
    320: "Western Larch Group",
    340: "Redwood Group",
    360: "Other Western Softwood Group",
    370: "California Mixed Conifer Group",
    380: "Exotic Softwoods Group",
    400: "Oak/Pine Group",
    500: "Oak/Hickory Group",
    600: "Oak/Gum/Cypress Group",
    700: "Elm/Ash/Cottonwood Group",
    800: "Maple/Beech/Birch Group",
    900: "Aspen/Birch Group",
    910: "Alder/Maple Group",
    920: "Western Oak Group",
    940: "Tanoak/Laurel Group",
    950: "Other Western Hardwoods Group",
    980: "Tropical Hardwoods Group",
    990: "Exotic Hardwoods Group",
}

# Fixed values.
FOREST_TYPES = {
    0: "Non-forest",
    101: "Jack pine",
    102: "Red pine",
    103: "Eastern white pine",
    104: "Eastern White pine / Eastern hemlock",
    105: "Eastern hemlock",
    121: "Balsam fir",
    122: "White spruce",
    123: "Red spruce",
    124: "Red spruce / balsam fir",
    125: "Black spruce",
    126: "Tamarack",
    127: "Northern white-cedar",
    141: "Longleaf pine",
    142: "Slash pine",
    161: "Loblolly pine",
    162: "Shortleaf pine",
    163: "Virginia pine",
    164: "Sand pine",
    165: "Table-mountain pine",
    166: "Pond pine",
    167: "Pitch pine",
    168: "Spruce pine",
    181: "Eastern redcedar",
    182: "Rocky Mountain juniper",
    183: "Western juniper",
    184: "Juniper woodland",
    185: "Pinyon juniper woodland",
    201: "Douglas-fir",
    202: "Port-Orford-cedar",
    221: "Ponderosa pine",
    222: "Incense cedar",
    223: "Jeffrey pine / Coulter pine / bigcone Douglas-fir",
    224: "Sugar pine",
    241: "Western white pine",
    261: "White fir",
    262: "Red fir",
    263: "Noble fir",
    264: "Pacific silver fir",
    265: "Engelmann spruce",
    266: "Engelmann spruce / subalpine fir",
    267: "Grand fir",
    268: "Subalpine fir",
    269: "Blue spruce",
    270: "Mountain hemlock",
    271: "Alaska-yellow-cedar",
    281: "Lodgepole pine",
    301: "Western hemlock",
    304: "Western redcedar",
    305: "Sitka spruce",
    321: "Western larch",
    341: "Redwood",
    342: "Giant sequoia",
    361: "Knobcone pine",
    362: "Southwest white pine",
    363: "Bishop pine",
    364: "Monterey pine",
    365: "Foxtail pine / bristlecone pine",
    366: "Limber pine",
    367: "Whitebark pine",
    368: "Misc. western softwoods",
    371: "California mixed conifer",
    381: "Scotch pine",
    382: "Australian pine",
    383: "Other exotic softwoods",
    384: "Norway Spruce",
    385: "Introduced larch",
    401: "Eastern white pine / N. red oak / white ash",
    402: "Eastern redcedar / hardwood",
    403: "Longleaf pine / oak",
    404: "Shortleaf pine / oak",
    405: "Virginia pine / southern red oak",
    406: "Loblolly pine / hardwood",
    407: "Slash pine / hardwood",
    409: "Other pine / hardwood",
    501: "Post oak / blackjack oak",
    502: "Chestnut oak",
    503: "White oak / red oak / hickory",
    504: "White oak",
    505: "Northern red oak",
    506: "Yellow-poplar / white oak / N. red oak",
    507: "Sassafras / persimmon",
    508: "Sweetgum / yellow-poplar",
    509: "Bur oak",
    510: "Scarlet oak",
    511: "Yellow-poplar",
    512: "Black walnut",
    513: "Black locust",
    514: "Southern scrub oak",
    515: "Chestnut oak / black oak / scarlet oak",
    519: "Red maple / oak",
    520: "Mixed upland hardwoods",
    601: "Swamp chestnut oak / cherrybark oak",
    602: "Sweetgum / Nuttall oak / willow oak",
    605: "Overcup oak / water hickory",
    606: "Atlantic white-cedar",
    607: "Baldcypress / water tupelo",
    608: "Sweetbay / swamp tupelo / red maple",
    701: "Black ash / American elm / red maple",
    702: "River birch / sycamore",
    703: "Cottonwood",
    704: "Willow",
    705: "Sycamore / pecan / American elm",
    706: "Sugarberry / hackberry / elm / green ash",
    707: "Silver maple / American elm",
    708: "Red maple / lowland",
    709: "Cottonwood / willow",
    722: "Oregon ash",
    801: "Sugar maple / beech / yellow birch",
    802: "Black cherry",
    803: "Cherry / ash / yellow-poplar",
    805: "Hard maple / basswood",
    807: "Elm / ash / locust",
    809: "Red maple / upland",
    901: "Aspen",
    902: "Paper birch",
    904: "Balsam poplar",
    911: "Red alder",
    912: "Bigleaf maple",
    921: "Gray pine",
    922: "California black oak",
    923: "Oregon white oak",
    924: "Blue oak",
    925: "Deciduous oak woodland",
    926: "Evergreen oak woodland",
    931: "Coast live oak",
    932: "Canyon live oak / interior live oak",
    941: "Tanoak",
    942: "Califonia laurel",
    943: "Giant chinkapin",
    951: "Pacific madrone",
    952: "Mesquite Woodland",
    953: "Cercocarpus woodland",
    954: "Intermountain maple woodland",
    955: "Misc. western hardwood woodlands",
    981: "Sabal palm",
    982: "Mangrove",
    989: "Other tropical",
    991: "Paulownia",
    992: "Melaluca",
    993: "Eucalyptus",
    995: "Other exotic hardwoods",
}

# Fixed values.
ECOZONE_NAMES = {1: "Cool", 2: "Intermediate", 3: "Hot"}

# Oak types compared between slopes.
OAK_TYPES = (501, 502, 503, 504, 505, 506, 510, 515)

_KINDS = {
    "forest_group": (FOREST_GROUPS, "Code "),
    "forest_type": (FOREST_TYPES, "Code "),
    "ecozone": (ECOZONE_NAMES, "Unknown ("),
}


def label_table(spark: SparkSession, kind: str) -> DataFrame:
    """The fixed (code, label) dimension of one kind; at most 142 rows."""
    names, _ = _KINDS[kind]
    return spark.createDataFrame(list(names.items()), "code int, label string")


def with_label(df: DataFrame, kind: str, code: str, label: str = "label") -> DataFrame:
    """Left join of the label; codes without one get a name made of the code."""
    names, prefix = _KINDS[kind]
    dim = F.broadcast(
        label_table(df.sparkSession, kind).select(
            F.col("code").alias(f"__{code}"), F.col("label").alias("__label")
        )
    )
    made_up = F.concat(F.lit(prefix), F.col(code).cast("string"), F.lit(")" if "(" in prefix else ""))
    return (
        df.join(dim, F.col(code) == F.col(f"__{code}"), "left")
        .withColumn(label, F.coalesce("__label", made_up))
        .drop(f"__{code}", "__label")
    )


def is_known(kind: str, code: Column) -> Column:
    return code.isin(*_KINDS[kind][0])
