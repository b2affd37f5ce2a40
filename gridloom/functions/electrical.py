"""Column builders of the electrical model.

All functions take and return Spark columns, so they stay inside Catalyst plans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model: shares of simultaneous use by class of consumer, kW of a
# household, W of a square metre, standard transformer sizes in kVA, and the
# voltage of the network.
SIMULTANEITY = {"Residential": 0.07, "Commercial": 0.5, "Public": 0.6}
RESIDENTIAL_TYPES = ("SFH", "MFH", "TH", "AB")
HOUSEHOLD_KW = 30.0
WATT_PER_M2 = {"Commercial": 79.0, "Public": 29.0}
SYNTHESISED_CAPACITIES = (100, 160, 250, 400)
MAPPED_CAPACITIES = (100, 160, 250, 400, 630)
LARGE_CONSUMER_KW = 100.0
VOLTS = 400.0
LOWER_VOLTAGE_BAND = 0.95
VOLTAGE_DROP = 0.045
BRANCH_LIMIT_KA = 0.313
#: Volts that a house connection may lose: up to 100 kW, and above.
HOUSE_DROP_VOLTS = (2.0, 4.0)

#: Cables for streets: name, ohm per km, reactance per km, kA, mm2.
STREET_CABLES = (
    ("NAYY 4x185 SE", 0.164, 0.08, 0.313, 185),
    ("NAYY 4x150 SE", 0.208, 0.08, 0.27, 150),
    ("NAYY 4x120 SE", 0.225, 0.08, 0.242, 120),
    ("NAYY 4x95 SE", 0.32, 0.082, 0.215, 95),
    ("NAYY 4x50 SE", 0.642, 0.083, 0.142, 50),
    ("NYY 4x16 SE", 1.15, 0.09, 0.103, 16),
    ("NYY 4x35 SE", 0.524, 0.085, 0.159, 35),
    ("NYY 4x95 SE", 0.193, 0.082, 0.28, 95),
    ("NYY 4x70 SE", 0.268, 0.082, 0.232, 70),
)

#: Cables for house connections.
HOUSE_CABLES = tuple(c for c in STREET_CABLES if c[0] in ("NAYY 4x120 SE", "NAYY 4x95 SE", "NAYY 4x50 SE", "NYY 4x16 SE", "NYY 4x35 SE", "NYY 4x70 SE"))


def consumer_class(kind: Column) -> Column:
    """Residential for the residential building types, else the type itself."""
    return F.when(kind.isin(*RESIDENTIAL_TYPES), "Residential").otherwise(kind)


def simultaneity(of_class: Column) -> Column:
    """The share of simultaneous use of a class; null for an unknown class."""
    out = F.lit(None).cast("double")
    for name, share in SIMULTANEITY.items():
        out = F.when(of_class == name, F.lit(share)).otherwise(out)
    return out


def simultaneous_load(power: Column, count: Column, share: Column) -> Column:
    """Peak of ``count`` consumers with ``power`` in total: P * (g + (1 - g) * n ** -3/4); 0 without consumers."""
    n = F.when(count > 0, count.cast("double"))
    return F.coalesce(power * (share + (F.lit(1.0) - share) * F.pow(n, F.lit(-0.75))), F.lit(0.0))


def households(kind: Column, area: Column, floors: Column) -> Column:
    """Households of a building by type, footprint and floors."""
    return (
        F.when(kind.isin("TH", "Commercial", "Public", "Industrial"), F.lit(1))
        .when(kind == "SFH", F.when(area < 160, 1).otherwise(2))
        .when(kind.isin("MFH", "AB"), (F.floor(area / 50) * floors).cast("int"))
        .otherwise(0)
    )


def peak_load_kw(kind: Column, area: Column, units: Column) -> Column:
    """Installed peak of a building."""
    per_m2 = F.when(kind == "Commercial", F.lit(WATT_PER_M2["Commercial"])).when(kind == "Public", F.lit(WATT_PER_M2["Public"]))
    return F.when(kind.isin(*RESIDENTIAL_TYPES), units * F.lit(HOUSEHOLD_KW)).otherwise(F.coalesce(area * per_m2 / 1000, F.lit(0.0)))


def without_large_consumers(kind: Column, peak: Column) -> Column:
    """Commercial and public consumers above 100 kW have their own supply and count as 0."""
    return F.when(kind.isin("Commercial", "Public") & (peak > LARGE_CONSUMER_KW), F.lit(0.0)).otherwise(peak)


def next_capacity(load: Column, capacities: tuple[int, ...] = SYNTHESISED_CAPACITIES) -> Column:
    """The smallest capacity strictly above a load; null if there is none."""
    return F.array_min(F.filter(F.array(*map(F.lit, capacities)), lambda c: c > load))


def cluster_size_kva(load: Column, capacities: tuple[int, ...] = SYNTHESISED_CAPACITIES) -> Column:
    """Single transformer above the load, or twin transformers where these are the smaller choice with 15 % reserve."""
    doubles = F.array(*[F.lit(2 * c) for c in capacities[2:4]])
    single, double = next_capacity(load, capacities), F.array_min(F.filter(doubles, lambda c: c > load * 1.15))
    return F.when(double > single, single).otherwise(double)


def corrected_size_kva(size: Column, estimated: Column) -> Column:
    """Keep standard and twin sizes, else whole multiples of 630 kVA; an estimate goes to the next larger size."""
    standard = sorted({*MAPPED_CAPACITIES, *(2 * c for c in MAPPED_CAPACITIES[2:])})
    return F.when(estimated, F.when(size.isin(*standard), size).otherwise(F.ceil(size / 630) * 630)).otherwise(next_capacity(size, MAPPED_CAPACITIES))


def branch_current_ka(load_kw: Column) -> Column:
    """Current of a load at the lower end of the voltage band."""
    return load_kw / F.lit(VOLTS * LOWER_VOLTAGE_BAND * 3**0.5)


def impedance(r: Column, x: Column) -> Column:
    """The magnitude of a complex impedance."""
    return F.hypot(r, x)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2.0 * 6371) * F.asin(F.sqrt(a))
