"""Names that sources use for our names, and what output features look like."""

# Names of features, coordinates and dimensions in common sources.
FEATURE_NAMES = {"elevation": "topography", "orog": "topography", "hgt": "topography"}
COORD_NAMES = {
    "lat": "latitude",
    "lon": "longitude",
    "xlat": "latitude",
    "xlong": "longitude",
    "plev": "level",
    "isobaricinhpa": "level",
    "pressure_level": "level",
    "xtime": "time",
    "time_index": "time",
    "valid_time": "time",
}
ERA_NAMES = {
    "u10": "u_10m",
    "v10": "v_10m",
    "u100": "u_100m",
    "v100": "v_100m",
    "t": "temperature",
    "t2m": "temperature_2m",
    "sp": "pressure_0m",
    "r": "relativehumidity",
    "relative_humidity": "relativehumidity",
    "q": "specifichumidity",
    "d": "divergence",
}

# Columns of reanalysis files that no operator reads.
NOT_READ = ("expver", "number")

# Fixed values: (scale factor, units, stored type, least, most) of output features by base name.
OUTPUT = {
    "u": (100.0, "m s-1", "uint16", -120, 120),
    "v": (100.0, "m s-1", "uint16", -120, 120),
    "windspeed": (100.0, "m s-1", "uint16", 0, 120),
    "winddirection": (100.0, "degree", "uint16", 0, 360),
    "clearsky_ratio": (10000.0, "ratio", "uint16", 0, 1),
    "dhi": (1.0, "W/m2", "uint16", 0, 1350),
    "dni": (1.0, "W/m2", "uint16", 0, 1350),
    "ghi": (1.0, "W/m2", "uint16", 0, 1350),
    "rsds": (1.0, "W/m2", "uint16", 0, 1350),
    "temperature": (100.0, "C", "int16", -200, 100),
    "temperature_min": (100.0, "C", "int16", -200, 100),
    "temperature_max": (100.0, "C", "int16", -200, 100),
    "relativehumidity": (100.0, "percent", "uint16", 0, 100),
    "relativehumidity_min": (100.0, "percent", "uint16", 0, 100),
    "relativehumidity_max": (100.0, "percent", "uint16", 0, 100),
    "pressure": (0.1, "Pa", "uint16", 0, 150000),
    "pr": (1.0, "kg m-2 s-1", "float32", 0, None),
    "srl": (1.0, "m", "float32", 0, None),
}
