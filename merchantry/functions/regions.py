"""UK postcode areas and their regions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from merchantry.functions.scalars import lookup

# Postcode areas of each region.
REGION_AREAS = {
    "London": ("E", "EC", "N", "NW", "SE", "SW", "W", "WC", "BR", "CR", "DA", "EN", "HA", "IG", "KT", "RM", "SM", "TW", "UB", "WD"),
    "South East": ("BN", "CT", "GU", "ME", "OX", "PO", "RG", "RH", "SL", "SO", "TN"),
    "South West": ("BA", "BS", "DT", "EX", "GL", "PL", "SN", "TA", "TQ", "TR"),
    "East of England": ("AL", "CB", "CM", "CO", "IP", "LU", "NR", "PE", "SG", "SS"),
    "East Midlands": ("CV", "DE", "LE", "LN", "NG", "NN"),
    "West Midlands": ("B", "DY", "ST", "WR", "WS", "WV"),
    "Yorkshire": ("BD", "DN", "HD", "HG", "HU", "HX", "LS", "S", "WF", "YO"),
    "North West": ("BB", "BL", "CA", "CH", "CW", "FY", "L", "LA", "M", "OL", "PR", "SK", "WA", "WN"),
    "North East": ("DH", "DL", "NE", "SR", "TS"),
    "Scotland": ("AB", "DD", "DG", "EH", "FK", "G", "HS", "IV", "KA", "KW", "KY", "ML", "PA", "PH", "TD", "ZE"),
    "Wales": ("CF", "LD", "LL", "NP", "SA", "SY"),
    "Northern Ireland": ("BT",),
}
ELSEWHERE = "International"


def uk_region(area: Column) -> Column:
    """Region of a postcode area: one constant map lookup per row."""
    region_of = {a: region for region, areas in REGION_AREAS.items() for a in areas}
    return lookup(area, region_of, F.lit(ELSEWHERE))
