"""Codes, labels and sizes that must equal the published ones for matching results."""

# severity pair -> event category; a pair not listed has no category
SAFE_SEVERITIES = ("Balanced-Sample Baseline", "Additional Baseline")
EVENT_CATEGORIES = {
    ("Crash", "Not Applicable"): "Crash",
    ("Near-Crash", "Not Applicable"): "NearCrash",
    ("Near-Crash", "Near-Crash"): "NearCrash-NearCrash",
    ("Non-Subject Conflict", "Near-Crash"): "SecondaryNearCrash",
    ("Near-Crash", "Crash-Relevant"): "NearCrash-CrashRelevant",
    ("Near-Crash", "Crash"): "NearCrash-Crash",
    ("Crash", "Near-Crash"): "Crash-NearCrash",
    ("Crash", "Crash"): "Crash-Crash",
    ("Crash-Relevant", "Near-Crash"): "CrashRelevant-NearCrash",
    ("Non-Subject Conflict", "Crash"): "SecondaryCrash",
    ("Near-Crash", "Non-Subject Conflict"): "NearCrash-OtherConflict",
    ("Crash", "Non-Subject Conflict"): "Crash-OtherConflict",
    ("Crash-Relevant", "Crash"): "CrashRelevant-Crash",
    ("Crash", "Crash-Relevant"): "Crash-CrashRelevant",
}

# event nature -> kind of conflict
CONFLICT_PARTNERS = {
    "(null)": "none",
    "Conflict with a following vehicle": "following",
    "Conflict with a lead vehicle": "leading",
    "Conflict with animal": "animal",
    "Conflict with merging vehicle": "merging",
    "Conflict with obstacle/object in roadway": "obstacle",
    "Conflict with oncoming traffic": "oncoming",
    "Conflict with parked vehicle": "parked",
    "Conflict with pedalcyclist": "cyclist",
    "Conflict with pedestrian": "pedestrian",
    "Conflict with vehicle in adjacent lane": "adjacent_lane",
    "Conflict with vehicle moving across another vehicle path (through intersection)": "intersection_crossing",
    "Conflict with vehicle moving across another vehicle path (through intersection) ": "intersection_crossing",
    "Conflict with vehicle turning across another vehicle path (opposite direction)": "turning_across_opposite",
    "Conflict with vehicle turning across another vehicle path (same direction)": "turning_across_parallel",
    "Conflict with vehicle turning into another vehicle path (opposite direction)": "turning_into_opposite",
    "Conflict with vehicle turning into another vehicle path (same direction)": "turning_into_parallel",
    "Other": "unknown",
    "Single vehicle conflict": "single",
    "Unknown conflict": "unknown",
    "nan": "none",
}

# kinds a radar facing forward cannot show, and kinds without a vehicle
UNSEEN_PARTNERS = ("following", "obstacle", "single")
NON_VEHICLES = ("animal", "pedestrian", "cyclist", "obstacle", "single")

# vehicle type -> (width, length) in m; None where the type tells nothing
VEHICLE_SIZES = {
    "CAR": (1.75, 4.5),
    "PICKUP_TRUCK": (2.0, 6.0),
    "SUV_CROSSOVER": (1.8, 4.6),
    "VAN_MINIVAN": (1.9, 5.2),
    "(null)": (None, None),
    "Ambulance": (2.4, 6.5),
    "Animal": (0.0, 0.0),
    "Automobile": (1.75, 4.5),
    "Cyclist": (0.5, 1.5),
    "Fire truck/car": (3.0, 12.0),
    "Light Vehicle pulling trailer": (2.3, 7.0),
    "Motor Coach bus": (2.55, 12.0),
    "Motorcycle or moped": (0.8, 2.0),
    "Not applicable": (None, None),
    "Object": (0.0, 0.0),
    "Other large construction equipment": (0.0, 0.0),
    "Other non-motorist": (0.5, 0.5),
    "Other vehicle type": (1.75, 4.5),
    "Pedestrian": (0.5, 0.5),
    "Pickup truck": (2.0, 6.0),
    "Police": (1.9, 5.0),
    "School bus ": (2.5, 12.0),
    "Single-unit straight truck + trailer": (2.5, 15.0),
    "Single-unit straight truck, other": (2.4, 7.3),
    "Single-unit straight truck: Box": (2.4, 7.3),
    "Single-unit straight truck: Dump": (2.4, 7.3),
    "Single-unit straight truck: Flatbed": (2.4, 7.3),
    "Single-unit straight truck: Garbage/Recycling": (2.4, 7.3),
    "Single-unit straight truck: Multistop/Step van": (2.4, 7.3),
    "Single-unit straight truck: Tow truck": (2.6, 9.1),
    "Sport Utility Vehicle": (1.85, 4.9),
    "Tractor only": (1.95, 4.5),
    "Tractor-trailer: Car carrier": (2.6, 19.0),
    "Tractor-trailer: Dump trailer": (2.6, 12.0),
    "Tractor-trailer: Enclosed box": (2.6, 15.0),
    "Tractor-trailer: Flatbed": (2.6, 15.0),
    "Tractor-trailer: Livestock": (2.6, 14.0),
    "Tractor-trailer: Multiple box": (2.6, 16.2),
    "Tractor-trailer: Tank": (2.6, 14.0),
    "Transit bus": (2.55, 11.95),
    "Unknown vehicle type": (1.75, 4.5),
    "Van (minivan or standard van)": (1.9, 5.2),
}

# object type code of the scenario store -> (length, width)
SCENARIO_SIZES = {0: (4.5, 1.75), 1: (0.5, 0.5), 2: (2.0, 0.8), 3: (1.5, 0.5), 4: (11.95, 2.55), 10: (4.5, 1.75)}
DEFAULT_SIZE = (4.5, 1.75)

# report groups
CATEGORY_GROUPS = {
    "SafeBaseline": "Safe interactions",
    "NearCrash": "Near-crashes",
    "Crash": "Crashes",
    "NearCrash-NearCrash": "Near-crashes",
    "SecondaryNearCrash": "Near-crashes",
    "NearCrash-CrashRelevant": "Near-crashes",
    "NearCrash-Crash": "Crashes",
    "Crash-Crash": "Crashes",
    "Crash-NearCrash": "Crashes",
    "CrashRelevant-NearCrash": "Near-crashes",
    "SecondaryCrash": "Crashes",
    "NearCrash-OtherConflict": "Near-crashes",
    "Crash-OtherConflict": "Crashes",
    "CrashRelevant-Crash": "Crashes",
    "Crash-CrashRelevant": "Crashes",
}
CONFLICT_GROUPS = {
    "leading": "Leading",
    "following": "Following",
    "adjacent_lane": "Adjacent lane",
    "merging": "Merging",
    "turning_into_opposite": "Crossing/turning",
    "turning_into_parallel": "Crossing/turning",
    "turning_across_opposite": "Crossing/turning",
    "turning_across_parallel": "Crossing/turning",
    "intersection_crossing": "Crossing/turning",
    "pedestrian": "Pedestrian/cyclist",
    "cyclist": "Pedestrian/cyclist",
    "animal": "Animal",
    "oncoming": "Oncoming",
    "obstacle": "Shapeless obstacle",
    "single": "Single",
    "parked": "Parked",
    "unknown": "Unknown",
    "none": "None",
    "nan": "None",
}
VOTED_GROUPS = {
    "merging": "Merging", "pedestrian": "Pedestrian", "cyclist": "Cyclist", "oncoming": "Oncoming",
    "parked": "Parked", "animal": "Animal", "unknown": "Unknown",
    "turning_into_parallel": "Turning&Crossing", "turning_across_opposite": "Turning&Crossing",
    "turning_across_parallel": "Turning&Crossing", "turning_into_opposite": "Turning&Crossing",
    "intersection_crossing": "Turning&Crossing",
}
WEATHER_ORDER = ("No Adverse Conditions", "Raining", "Mist/Light Rain", "Snowing", "Rain and Fog",
                 "Snow/Sleet and Fog", "Fog", "Sleeting")
SURFACE_ORDER = ("Dry", "Wet", "Snowy", "Icy", "Gravel/Dirt Road", "Unknown")
LIGHT_ORDER = ("Daylight", "Darkness, lighted", "Darkness, not lighted", "Dawn", "Dusk")
TRAFFIC_ORDER = (
    "Level-of-service A1: Free flow, no lead traffic",
    "Level-of-service A2: Free flow, leading traffic present",
    "Level-of-service B: Flow with some restrictions",
    "Level-of-service C: Stable flow, maneuverability and speed are more restricted",
    "Level-of-service D: Unstable flow - temporary restrictions substantially slow driver",
    "Level-of-service E: Flow is unstable, vehicles are unable to pass, temporary stoppages, etc.",
    "Level-of-service F: Forced traffic flow condition with low speeds and traffic volumes that are below capacity",
    "Unknown",
)

# accident statistics: report row -> source rows
WEATHER_GROUPS = {
    "Not adverse": ("No Adverse Atmospheric Conditions/Clear/Cloudy", "Cloudy"),
    "Unknown": ("Other", "Unknown/Not Reported"),
    "Rainy": ("Rain (Mist)", "Sleet, Hail (Freezing Rain or Drizzle)", "Freezing Rain or Drizzle"),
    "Foggy": ("Fog, Smog, Smoke",),
    "Snowy": ("Snow", "Blowing Snow"),
    "Windy": ("Blowing Sand, Soil, Dirt", "Severe Crosswinds"),
}
LIGHT_GROUPS = {
    "Dawn/dusk": ("Dawn", "Dusk"),
    "Unknown": ("Other", "Not Reported"),
    "Dark": ("Dark - Not Lighted", "Dark - Lighted", "Dark - Unknown Lighting"),
    "Daylight": ("Daylight",),
}

# report rows that add up other report rows, and the order of the report
WEATHER_TOTALS = {
    "Adverse": ("Rainy", "Foggy", "Snowy", "Windy"),
    "All": ("Not adverse", "Rainy", "Foggy", "Snowy", "Windy"),
}
WEATHER_ROWS = ("All", "Not adverse", "Adverse", "Rainy", "Foggy", "Snowy", "Windy", "Unknown")
LIGHT_TOTALS = {"All": ("Dark", "Daylight", "Dawn/dusk", "Unknown")}
LIGHT_ROWS = ("All", "Dark", "Dark - Not Lighted", "Dark - Lighted", "Dark - Unknown Lighting", "Daylight", "Dawn/dusk", "Unknown")

# scene sets: share of the scenes taken of each set when three are mixed; 1 and more takes all
THREE_SET_RATES = {"SafeBaseline": 2.0, "ArgoverseHV": 0.1, "highD": 1.0}

# filter search: values tried per parameter, and the ranges that scale the errors
EGO_SEARCH = {
    "uncertainty_init": (16.0, 32.0, 64.0, 128.0),
    "uncertainty_speed": (2.0, 4.0, 8.0, 16.0, 32.0),
    "uncertainty_omega": (0.01, 0.05, 0.1, 0.25),
    "uncertainty_acc": (2.0, 4.0, 8.0, 16.0, 32.0),
    "max_jerk": (2.0, 4.0, 8.0, 16.0),
    "max_yaw_rate_pi": (1 / 15, 1 / 10, 1 / 5, 1 / 2),
    "max_acc": (6.5, 9.8),
    "max_yaw_acc_pi": (1 / 5, 1 / 2, 1.0, 2.0),
}
SUR_SEARCH = {
    "uncertainty_init": (16.0, 32.0, 64.0, 128.0),
    "uncertainty_pos": (2.0, 4.0, 8.0, 16.0, 32.0),
    "uncertainty_speed": (2.0, 4.0, 8.0, 16.0, 32.0),
    "max_acc": (6.5, 9.8),
    "max_yaw_rate_pi": (1 / 5, 1 / 2, 1.0, 2.0),
}
EGO_DEFAULTS = {"uncertainty_init": 20.0, "uncertainty_speed": 8.0, "uncertainty_omega": 0.05, "uncertainty_acc": 4.0,
                "max_jerk": 15.0, "max_yaw_rate": 0.5, "max_acc": 9.8, "max_yaw_acc": 3.141592653589793}
SUR_DEFAULTS = {"uncertainty_init": 15.0, "uncertainty_pos": 2.0, "uncertainty_speed": 8.0, "max_acc": 9.8, "max_yaw_rate": 0.5}
DRONE_PARAMS = {"uncertainty_init": 100.2683, "uncertainty_pos": 0.01, "uncertainty_speed": 0.01,
                "max_acc": 11.1333, "max_yaw_rate": 2.5, "noise_speed": 52.4380}
ERROR_SCALES = {"speed": 10.0, "yaw_rate": 3.141592653589793 / 6, "acc": 6.0, "displacement": 5.0}
