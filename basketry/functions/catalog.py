"""Item catalogue rules (P9, P10, P11) as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The salon catalogue, in catalogue order (ids Item0001.. follow it).
SERVICES = [
    "Haircut (Women's)", "Haircut (Men's)", "Haircut (Children's)",
    "Hair Coloring (Full)", "Hair Coloring (Roots)", "Highlights", "Balayage",
    "Hair Treatment (Deep Conditioning)", "Hair Treatment (Keratin)",
    "Hair Styling (Updo)", "Hair Styling (Blowout)",
    "Perm", "Relaxer",
    "Hair Extensions (Installation)", "Hair Extensions (Removal)",
    "Makeup Application", "Facial",
    "Waxing (Eyebrows)", "Waxing (Legs)", "Waxing (Bikini)",
]
PRODUCTS = [
    "Shampoo (Volume)", "Shampoo (Moisturizing)", "Shampoo (Color-Safe)",
    "Shampoo (Clarifying)", "Shampoo (Dry)",
    "Conditioner (Volume)", "Conditioner (Moisturizing)", "Conditioner (Color-Safe)",
    "Conditioner (Leave-In)", "Conditioner (Deep)",
    "Hair Mask", "Hair Serum", "Hair Spray", "Styling Gel", "Styling Mousse",
    "Styling Cream", "Styling Wax",
    "Dry Shampoo", "Heat Protectant Spray", "Texturizing Spray",
    "Curl Enhancer", "Frizz Control Serum",
    "Makeup Remover", "Face Wash", "Moisturizer", "Sunscreen", "Toner",
    "Exfoliating Scrub", "Face Mask (Clay)", "Face Mask (Sheet)",
    "Eye Cream", "Lip Balm",
    "Body Wash", "Body Lotion", "Body Scrub", "Hand Cream", "Cuticle Oil",
    "Nail Polish (Red)", "Nail Polish (Nude)", "Nail Polish (Glitter)",
    "Top Coat", "Base Coat", "Nail Polish Remover",
    "Foundation", "Concealer", "Mascara", "Eyeliner", "Eyeshadow", "Lipstick",
]

# Subcategory rules, checked in this order; the first rule with
# any matching substring wins, otherwise "Other".
SUBCATEGORY_RULES = [
    ("Haircut", ["Haircut"]),
    ("Coloring", ["Coloring", "Highlights", "Balayage"]),
    ("Treatment", ["Treatment"]),
    ("Styling", ["Styling", "Perm", "Relaxer", "Extensions"]),
    ("Waxing", ["Waxing"]),
    ("Makeup", ["Makeup"]),
    ("Facial", ["Facial"]),
    ("Shampoo", ["Shampoo"]),
    ("Conditioner", ["Conditioner"]),
    ("Treatment Products", ["Mask", "Serum"]),
    ("Styling Products", ["Styling", "Spray", "Dry Shampoo", "Heat Protectant", "Texturizing"]),
    ("Skincare", ["Makeup", "Face Wash", "Moisturizer", "Sunscreen", "Toner"]),
]
DEFAULT_SUBCATEGORY = "Other"

# Rule list for the star-schema part names ("<adjective> <noun>"), checked in
# order like SUBCATEGORY_RULES; the first rule overlaps the later ones on purpose.
PART_RULES = [
    ("Thermal", ["hot", "cold"]),
    ("Hardware", ["bolt", "ring", "gear"]),
    ("Stock", ["rod", "plate"]),
    ("Gadgets", ["widget", "gizmo"]),
]

# Unit price ranges (low, high) by (category, subcategory);
# anything else draws from the default range.
PRICE_RANGES = [
    ("Service", "Haircut", 20, 80),
    ("Service", "Coloring", 60, 200),
    ("Service", "Treatment", 30, 100),
    ("Service", "Styling", 40, 150),
    ("Service", "Waxing", 10, 60),
    ("Service", "Makeup", 50, 120),
    ("Service", "Facial", 70, 150),
    ("Product", "Shampoo", 10, 40),
    ("Product", "Conditioner", 10, 40),
    ("Product", "Treatment Products", 20, 60),
    ("Product", "Styling Products", 15, 45),
    ("Product", "Skincare", 15, 70),
]
DEFAULT_PRICE_RANGE = (10, 50)

# Employees Emp01..Emp10 and the 23 zip codes of the generator.
N_EMPLOYEES = 10
ZIP_CODES = [
    "90001", "90002", "90003", "90004", "90005",
    "90012", "90013", "90014", "90015", "90017",
    "90024", "90025", "90034", "90035", "90036",
    "90046", "90048", "90049", "90064", "90066",
    "90210", "90211", "90212",
]


def classify(name: Column | str, rules: Sequence[tuple[str, Sequence[str]]] = SUBCATEGORY_RULES,
             default: str = DEFAULT_SUBCATEGORY) -> Column:
    """P10: ordered substring rules, first match wins (one CASE WHEN chain)."""
    col = F.col(name) if isinstance(name, str) else name
    expr = None
    for label, needles in rules:
        cond = None
        for needle in needles:
            c = col.contains(needle)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def category(name: Column | str, services: Sequence[str] = SERVICES) -> Column:
    """Service when the name is on the service list, else Product."""
    col = F.col(name) if isinstance(name, str) else name
    return F.when(col.isin(*services), F.lit("Service")).otherwise(F.lit("Product"))


def price_bounds(cat: Column | str, sub: Column | str) -> tuple[Column, Column]:
    """(low, high) of the unit price range for a (category, subcategory)."""
    c = F.col(cat) if isinstance(cat, str) else cat
    s = F.col(sub) if isinstance(sub, str) else sub
    lo = hi = None
    for cat_v, sub_v, low, high in PRICE_RANGES:
        cond = (c == cat_v) & (s == sub_v)
        lo = F.when(cond, F.lit(low)) if lo is None else lo.when(cond, F.lit(low))
        hi = F.when(cond, F.lit(high)) if hi is None else hi.when(cond, F.lit(high))
    return (lo.otherwise(F.lit(DEFAULT_PRICE_RANGE[0])),
            hi.otherwise(F.lit(DEFAULT_PRICE_RANGE[1])))


def draw_price(cat: Column | str, sub: Column | str, u: Column) -> Column:
    """Uniform price in the range of P11 from a uniform draw ``u`` in [0, 1), 2 dp."""
    lo, hi = price_bounds(cat, sub)
    return F.round(lo + u * (hi - lo), 2).cast("decimal(18,2)")
