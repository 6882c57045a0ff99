"""Fixed values of the grading rules."""

from __future__ import annotations

#: Metres of a lattice step; dyadic, so that lattice numbers times it are exact.
STEP_M = 9 / 256
PIXEL_M = 18 / 256
ABS_TOL_M = 0.001
OVERLAP_SHARE = 1e-6
CLOSED_SEAM_SHARE = 0.04
CONTAINMENT_SHARE = 0.99
BEDROOM_CAP = 0.60
STANDARDS_COMPACTNESS = 0.589
Z95 = 1.959963984540054
DRAWS, DRAW_SEED = 20_000, 20260916
REPLICATES, REPLICATE_SEED = 10_000, 20260928
SPLITS, SPLIT_SEED = 20, 20260929
BUILDING_CELL_M, BUILDING_THRESHOLDS = 0.5, (0.5, 0.4)
FIT_LEVELS = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30)
ROOM_BINS = ((1, 4), (5, 6), (7, 8), (9, 10), (11, 14), (15, 19), (20, 10_000))
RECTANGULAR_SHARE = 0.95
EXPOSURE = {"exterior": -1, "corridor": -2, "demising": -3, "hallway": -4}
SOURCE_PIXEL_M = {"houseganpp": 18 / 64, "housegan": 18 / 32, "gsdiff": 18 / 256, "rplan": 18 / 256, "msd": 0.38, "synthetic": 0.0}

# Category to tag.
TAGS = {
    "livingroom": "LivingRoom", "masterroom": "PrimaryBedroom", "kitchen": "Kitchen", "bathroom": "Bathroom", "diningroom": "DiningRoom",
    "childroom": "Bedroom", "secondroom": "Bedroom", "guestroom": "GuestRoom", "balcony": "Balcony", "entrance": "Foyer", "storage": "Closet",
    "walkin_closet": "Closet", "bedroom": "Bedroom", "dining": "DiningRoom", "corridor": "Hallway", "storeroom": "Closet",
    "living_room": "LivingRoom", "dining room": "DiningRoom", "studyroom": "Unset", "stairs": "Unset",
}
BEDROOMS = ("Bedroom", "PrimaryBedroom")

# Plan-level floors at a refusal of 5 per cent.
COMPACTNESS_FLOOR = {"rplan": 0.365, "msd-unit": 0.3237, "msd-floor": 0.2406}
PROPORTION_FLOOR = {
    "rplan": {"Balcony": 0.1424, "Bathroom": 0.3413, "Bedroom": 0.4747, "Closet": 0.194, "DiningRoom": 0.3098, "Foyer": 0.3376, "GuestRoom": 0.4655, "Kitchen": 0.2748, "LivingRoom": 0.3486, "PrimaryBedroom": 0.4553},
    "msd-unit": {"Balcony": 0.1193, "Bathroom": 0.3516, "Bedroom": 0.4419, "Closet": 0.2236, "DiningRoom": 0.3896, "Hallway": 0.1949, "Kitchen": 0.3043, "LivingRoom": 0.3218},
    "msd-floor": {"Balcony": 0.0954, "Bathroom": 0.2973, "Bedroom": 0.3978, "Closet": 0.162, "DiningRoom": 0.3651, "Hallway": 0.124, "Kitchen": 0.2669, "LivingRoom": 0.2959},
}

# The published-standards requirements, (tag, area, width); 0.0 disables.
STANDARDS = (
    ("LivingRoom", 6.5, 2.134), ("PrimaryBedroom", 11.5, 2.75), ("Bedroom", 11.5, 2.55), ("GuestRoom", 7.5, 2.15), ("DiningRoom", 6.5, 2.134),
    ("Balcony", 5.0, 1.5), ("Bathroom", 0.0, 0.762), ("Foyer", 0.0, 0.914), ("Hallway", 0.0, 0.914), ("Kitchen", 0.0, 0.0), ("Closet", 0.0, 0.0),
)

# Groups in report order, with corpus and role.
GROUPS = (("rplan", "rplan", "truth"), ("msd units", "msd", "truth"), ("houseganpp", "rplan", "baseline"), ("housegan", "rplan", "baseline"), ("housediffusion", "rplan", "baseline"))

RUNGS = ("roomOutline", "roomCompactness", "roomProportions", "roomAppendices", "suiteContainer", "finalAdjacency")
