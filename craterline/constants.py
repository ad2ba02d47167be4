"""Vocabularies, sensor constants, thresholds and texts.

Everything in this module is a value that results must carry exactly as it stands
(names, limits, lookup tables, sentences); nothing here is logic.
"""

# --- Physical constants -------------------------------------------------------
MOON_RADIUS_M = 1737400.0

# --- Sensors ------------------------------------------------------------------
# Push-broom geometry: altitude km, ground sampling m, samples per line, centre sample.
PARALLAX_SENSORS = {
    "OHRC": (102.71, 0.25, 12000, 5999.5),
    "TMC-2": (121.43, 6.0, 4000, 1999.5),
}
# Full-resolution OHRC frame, used to scale view coordinates.
OHRC_SAMPLES = 12000
OHRC_LINES = 78175
# views below this height are reduced ones
OHRC_VIEW_LINES = 75000

MATRIX_SENSORS = ["OHRC", "TMC-2", "IIRS", "LROC_NAC", "SELENE_TC"]
INTAKE_SENSORS = [
    "OHRC", "TMC-2", "IIRS", "LROC_NAC", "SELENE_TC", "SIMULATED_OPTICAL",
    "OPTICAL_HIGH_RES", "OPTICAL_STEREO", "HYPERSPECTRAL",
]
# sensor, role, latitude range, resolution m
SENSOR_CATALOG = [
    ("OHRC", "Sub-meter optical morphology", -90.0, 90.0, 0.25),
    ("TMC-2", "Stereo 3D DEM & regional topography", -90.0, 90.0, 5.0),
    ("IIRS", "Hyperspectral mineralogy & hydration", -90.0, 90.0, 20.0),
    ("LROC_NAC", "Sub-meter independent validation", -90.0, 90.0, 0.5),
    ("SELENE_TC", "Kaguya terrain verification", -90.0, 90.0, 10.0),
]
# sensor, quality, feasibility, band, role; list order breaks ties in ranking
RANKED_SENSORS = [
    ("OHRC", 0.94, 0.88, "Optical High-Res (0.25m)", "Sub-meter structural morphology"),
    ("TMC-2", 0.90, 0.92, "Stereo Photogrammetry (5m)", "Topographic 3D DEM & slope mapping"),
    ("IIRS", 0.88, 0.85, "Hyperspectral SWIR (20m)", "Mineral composition & 2.8μm OH/H2O absorption"),
]
# question -> relevance of OHRC, TMC-2, IIRS
RELEVANCE = {
    "fine morphology": (0.96, 0.52, 0.18),
    "terrain analysis": (0.58, 0.94, 0.32),
    "elevation analysis": (0.42, 0.98, 0.20),
    "spectral analysis": (0.15, 0.25, 0.97),
    "boulder hazard": (0.98, 0.60, 0.10),
    "water ice prospecting": (0.35, 0.40, 0.95),
}
UNKNOWN_QUESTION_RELEVANCE = 0.60

# --- Evidence vocabulary ------------------------------------------------------
EVIDENCE_DIMENSIONS = [
    "GEOMETRIC", "TERRAIN", "ILLUMINATION", "SPECTRAL", "SCALE", "TEMPORAL",
    "TEXTURE", "REGISTRATION", "PHYSICAL", "MANUAL", "SYNTHETIC",
]
FUSED_DIMENSIONS = EVIDENCE_DIMENSIONS[:10]
CARD_DIMENSIONS = ["GEOMETRIC", "TERRAIN", "ILLUMINATION", "SPECTRAL", "TEMPORAL"]

# --- Gates --------------------------------------------------------------------
GATE_REASONS = {
    "GATE1": "GATE1_SOURCE_OUT_OF_CALIBRATED_GRID",
    "GATE2": "GATE2_INVALID_DEM_ELEVATION",
    "GATE3": "GATE3_TARGET_OUTSIDE_CALIBRATED_SWATH",
    "GATE4": "GATE4_TARGET_CLAMPED_TO_SWATH_BOUNDARY",
    "GATE5": "GATE5_PARALLAX_EXCEEDS_PHYSICAL_BOUNDS",
    "GATE6": "GATE6_CORRIDOR_OUTSIDE_TARGET_ARRAY",
}
MAX_PARALLAX_M = 350.0
# gate id, what it checks, when it fails, threshold
GATE_CATALOG = [
    ("GATE1", "Source point lies on the calibrated source grid", "Point outside the source lattice", "pixel and scan within lattice bounds"),
    ("GATE2", "Terrain elevation is available at the ground point", "Outside the elevation model or nodata", "four valid elevation cells"),
    ("GATE3", "Ground point lies inside the target swath", "Target footprint does not contain the point", "point inside a target lattice cell"),
    ("GATE4", "Target point is not clamped to the swath edge", "Target pixel is exactly 0", "target pixel != 0"),
    ("GATE5", "Parallax displacement is physically bounded", "Displacement above the limit", "350 m"),
    ("GATE6", "Elevation corridor lies inside the target array", "Corridor leaves the target array", "full containment"),
]
FOOTPRINT_REASON_TEXT = "FOOTPRINT_NON_OVERLAP: Physical footprint separation ~1.49 km - 2.04 km (Negative Control)"
NOT_VALIDATED_TEXT = "PHYSICAL CORRESPONDENCE NOT VALIDATED"

# --- Confidence weights and limits -------------------------------------------
CONFIDENCE_WEIGHTS = {
    "visual": 0.20, "geometry": 0.30, "illumination": 0.20,
    "terrain": 0.15, "scale": 0.08, "spatial": 0.07,
}

# --- Gap rules ----------------------------------------------------------------
GAP_TYPES = [
    "MISSING_MODALITY", "MISSING_TEMPORAL_OBSERVATION", "MISSING_GEOMETRIC_VALIDATION",
    "MISSING_TERRAIN_VALIDATION", "MISSING_SPECTRAL_VALIDATION", "INSUFFICIENT_CORRESPONDENCE",
    "FOOTPRINT_NON_OVERLAP", "UNCERTAINTY_TOO_HIGH",
]
# gap type -> (severity, id suffix, description, required evidence)
GAP_TEXT = {
    "FOOTPRINT_NON_OVERLAP": ("HIGH", "NONOVERLAP", "Calibrated sensor footprints do not physically overlap on lunar surface.", "Overlapping swath or contiguous mosaic coverage"),
    "MISSING_SPECTRAL_VALIDATION": ("HIGH", "SPECTRAL", "Entity lacks hyperspectral (IIRS) coverage to resolve mineralogy (pyroxene/olivine absorption bands).", "IIRS 0.8-5.0um reflectance cube"),
    "MISSING_TERRAIN_VALIDATION": ("MEDIUM", "TERRAIN", "Entity lacks 3D topographic confirmation from DEM or stereo photogrammetry.", "SLDEM2015 elevation or TMC-2 stereo profile"),
    "MISSING_TEMPORAL_OBSERVATION": ("LOW", "TEMPORAL", "Observed at only a single epoch. Temporal evolution, impact crater degradation, and variable illumination unconstrained.", "Multi-epoch observations at varying solar azimuth"),
    "UNCERTAINTY_TOO_HIGH": ("HIGH", "HIGH-UNC", None, "Sub-meter optical targeting or high-resolution DEM sampling"),
    "INSUFFICIENT_CORRESPONDENCE": ("MEDIUM", "INSUFF-CORR", "Feature confirmed by only one observation. Lacks cross-sensor physical correspondence.", "Independent cross-sensor observation"),
    "MISSING_GEOMETRIC_VALIDATION": ("HIGH", "GEOM", "Entity lacks verified geometric inlier consensus / reprojection validation.", "Geometric RANSAC / homography consensus"),
    "MISSING_MODALITY": ("MEDIUM", "MODALITY", "Entity lacks multi-modal sensory coverage beyond nominal optical channel.", "Multi-spectral or altimetry channel"),
}
# gap type, sensor, evidence type, potential, reason, geometry, basis
GAP_SENSOR_RULES = [
    ("FOOTPRINT_NON_OVERLAP", "TMC-2", "PHYSICAL", "HIGH_POTENTIAL",
     "Calibrated footprint separation requires an adjacent overlapping swath to bridge the 1.5-2.1 km reference gap.",
     "potentially useful adjacent observation geometry (adjacent track shifted by ~2.0 km west; not a confirmed spacecraft trajectory plan)",
     "POTENTIALLY_REDUCES_UNCERTAINTY by establishing physical spatial overlap between OHRC and TMC-2 swaths"),
    ("MISSING_SPECTRAL_VALIDATION", "IIRS", "SPECTRAL", "HIGH_POTENTIAL",
     "Entity lacks hyperspectral reflectance data to identify mineral absorption bands.",
     "Nadir hyperspectral targeting over crater floor/ejecta",
     "POTENTIALLY_REDUCES_UNCERTAINTY regarding pyroxene, olivine, and hydration composition"),
    ("MISSING_TERRAIN_VALIDATION", "TMC-2", "TERRAIN", "MEDIUM_POTENTIAL",
     "Lacks 3D stereo photogrammetric depth profile.",
     "Fore and AFT stereo viewing angles (±26°)",
     "POTENTIALLY_REDUCES_UNCERTAINTY by resolving true crater depth and rim slope angles"),
    ("MISSING_TEMPORAL_OBSERVATION", "OHRC", "ILLUMINATION", "MEDIUM_POTENTIAL",
     "Lacks orthogonal solar illumination to illuminate shadowed floor and rim morphology.",
     "Acquisition under opposite solar azimuth angle (Δazimuth ~ 180°)",
     "POTENTIALLY_REDUCES_UNCERTAINTY by revealing features obscured in permanent or seasonal shadows"),
    ("UNCERTAINTY_TOO_HIGH", "OHRC", "GEOMETRIC", "HIGH_POTENTIAL",
     "High spatial uncertainty requires sub-meter optical localization.",
     "Sub-meter nadir targeting (0.25m/px)",
     "POTENTIALLY_REDUCES_UNCERTAINTY by localizing crater rim boundary to sub-meter precision"),
]
# service gap type, severity, id suffix, recommended sensor, reason
SERVICE_GAPS = [
    ("MISSING_SPECTRAL_EVIDENCE", "HIGH", "SPECTRAL", "IIRS",
     "High-resolution morphology and terrain elevation profiles are registered, but no hyperspectral IIRS data is attached to determine mineral composition (pyroxene/olivine absorption bands)."),
    ("HIGH_ILLUMINATION_UNCERTAINTY", "MEDIUM", "ILLUM", "OHRC",
     "Observation acquired under single solar azimuth angle. Lacks orthogonal or opposite illumination to resolve interior permanent shadow boundaries."),
    ("UNVERIFIED_TERRAIN_RELATION", "MEDIUM", "TERRAIN", "TMC-2",
     "Lacks 3D stereo photogrammetric DEM coverage from TMC-2. Vertical depth and true slope cannot be independently cross-verified."),
]
FOOTPRINT_GAP_REASON = "Calibrated sensor footprints are physically separated (~1.49 km - 2.04 km). Physical correspondence rejected by Gate 3."

# --- Hypotheses seeded for a new entity ---------------------------------------
# id suffix, property, value, confidence, uncertainty, evidence count
HYPOTHESIS_TEMPLATES = [
    ("01", "morphology_type", "Well-preserved parabolic impact crater with continuous raised ejecta blanket", 0.91, 0.09, 2),
    ("02", "terrain_roughness", "Moderate-to-high local slope roughness (16.8° mean inner rim slope)", 0.88, 0.12, 1),
    ("03", "spectral_composition", "Excavated clinopyroxene and basaltic mare melt lining interior floor", 0.74, 0.26, 1),
]

# --- Lifecycle explanations ---------------------------------------------------
LIFECYCLE_TEXT = {
    "CASE_C_CONTRADICTORY_EVIDENCE": "Entity state set to CONTRADICTED due to conflicting physical or geometric evidence.",
    "CASE_B_PHYSICALLY_INCOMPATIBLE": "Entity rejected: all candidate associations failed physical, geometric, or footprint checks.",
    "CASE_D_SINGLE_OBSERVATION": "Entity supported by a single observation; cannot be confirmed without independent cross-sensor verification.",
    "CASE_DEFAULT_CANDIDATE": "Entity remains in preliminary CANDIDATE state; insufficient evidence for support.",
}
LIFECYCLE_BLOCKS = {
    "CASE_C_CONTRADICTORY_EVIDENCE": "Evidence conflict across independent sensor observations.",
    "CASE_D_SINGLE_OBSERVATION": "Lacks independent multi-sensor corroboration.",
    "CASE_A_MONO_SENSOR_MULTIPLE_ACQUISITIONS": "Requires distinct sensor payload for multi-modal confirmation.",
    "CASE_DEFAULT_CANDIDATE": "No supported observations registered.",
}

# --- Temporal explanations ----------------------------------------------------
TEMPORAL_TEXT = {
    "SINGLE": "Only a single observation epoch recorded; temporal evolution unconstrained.",
    "CONTRADICTED": "Temporal change claim contradicted by higher-resolution observation or calibration check.",
    "GEOMETRY": "Significant structural geometric change verified under consistent viewing geometry.",
    "ILLUMINATION": "Observational differences detected (solar azimuth/incidence angle shift), but physical structure remains STABLE.",
    "BOTH": "Apparent geometric differences observed alongside significant solar angle shifts; requires normalized illumination validation.",
    "NONE": "Feature is temporally stable; measurements consistent across observation epochs.",
}

# --- Uncertainty explanations -------------------------------------------------
CALIBRATION_TEXT = {
    "CALIBRATED_LOW_UNCERTAINTY": "Evidence modules in high agreement with stable geometric reprojection and broad spatial support.",
    "HIGH_EPISTEMIC_RISK": "High conflict between visual appearance and physical solar/terrain constraints.",
    "GEOMETRIC_ALEATORIC_NOISE": "High residual reprojection variance or ill-conditioned planar transformation.",
    "MODERATE_UNCERTAINTY": "Moderate uncertainty due to cross-resolution scaling and illumination differences.",
}

# --- Compatibility ------------------------------------------------------------
DEFAULT_GAP_M = 1773.2
MAX_RELIEF_M = 246.4

# --- Graph --------------------------------------------------------------------
NODE_TYPES = ["ENTITY", "OBSERVATION", "EVIDENCE", "HYPOTHESIS", "KNOWLEDGE_GAP", "RECOMMENDATION"]
EDGE_RELATIONS = [
    "OBSERVES", "ASSOCIATED_WITH", "SUPPORTED_BY", "CONTRADICTED_BY", "DERIVED_FROM",
    "TEMPORALLY_RELATED", "SPATIALLY_RELATED", "HYPOTHESIZES", "HAS_UNCERTAINTY",
    "HAS_GAP", "RECOMMENDS", "MATCHED_WITH",
]

# --- Benchmark ----------------------------------------------------------------
# source sensor, target sensor, tier, difficulty, id prefix, notes
PAIR_TIERS = [
    ("OHRC", "LRO_NAC", 1, "medium", "REAL_OHRC_LRO", "High-resolution optical cross-mission pair"),
    ("OHRC", "TMC-2", 2, "high", "REAL_OHRC_TMC2", "Chandrayaan-2 high vs medium resolution scale gap pair (OHRC 0.26m, TMC-2 6.07m)"),
    ("TMC-2", "LRO_NAC", 3, "high", "REAL_TMC2_LRO", "TMC-2 to LRO NAC cross-resolution pair"),
    ("IIRS", "OHRC", 4, "very_high", "REAL_IIRS_OPTICAL", "IIRS single-band vs optical multimodal baseline pair"),
    ("IIRS", "TMC-2", 4, "very_high", "REAL_IIRS_OPTICAL", "IIRS single-band vs optical multimodal baseline pair"),
]
GROUND_TRUTH_NAMES = {
    0: "LEVEL_UNKNOWN",
    1: "LEVEL_1_GEOREFERENCED_OVERLAP",
    2: "LEVEL_2_INDEPENDENT_GEOMETRIC_REFERENCE",
    3: "LEVEL_3_MANUALLY_VERIFIED",
    4: "LEVEL_4_SYNTHETIC_CONTROLLED_TRANSFORM",
}

# --- Labels -------------------------------------------------------------------
# field -> tag names, first present wins
LABEL_TAGS = {
    "product_lid": ["logical_identifier", "title"],
    "processing_level": ["processing_level"],
    "start_time": ["start_date_time", "start_time", "observation_start_time"],
    "sun_azimuth_deg": ["sun_azimuth", "sun_azimuth_angle", "solar_azimuth"],
    "sun_elevation_deg": ["sun_elevation", "sun_elevation_angle", "solar_elevation"],
    "incidence_angle_deg": ["solar_incidence", "incidence_angle", "solar_incidence_angle"],
    "emission_angle_deg": ["emission_angle"],
    "phase_angle_deg": ["phase_angle"],
    "spacecraft_altitude_km": ["spacecraft_altitude", "altitude"],
    "bound_lat_min": ["minimum_latitude", "south_bounding_latitude"],
    "bound_lat_max": ["maximum_latitude", "north_bounding_latitude"],
    "bound_lon_min": ["westernmost_longitude", "west_bounding_longitude"],
    "bound_lon_max": ["easternmost_longitude", "east_bounding_longitude"],
    "crs": ["projection", "coordinate_system_name", "reference_frame_id"],
    "gsd_m": ["pixel_resolution", "spatial_resolution", "map_scale"],
}
LABEL_CORNERS = ["upper_left", "upper_right", "lower_left", "lower_right"]
RASTER_TYPES = {
    "unsignedbyte": "u1", "uint8": "u1", "signedbyte": "i1",
    "unsignedlsb2": "<u2", "unsignedmsb2": ">u2",
    "signedlsb2": "<i2", "signedmsb2": ">i2",
    "ieee754lsbsingle": "<f4", "ieee754msbsingle": ">f4",
}
INVENTORY_EXTENSIONS = [
    ".xml", ".lbl", ".tif", ".tiff", ".img", ".jp2", ".fits", ".cub", ".h5", ".hdf", ".nc", ".png",
]
INVENTORY_SKIP = [".venv", "venv", ".git", "node_modules", ".pytest_cache", "__pycache__"]
PAIR_EXTENSIONS = [".xml", ".xml.lbl", ".lbl", ".tif", ".tiff", ".png", ".jpg"]
VERIFIED_SENSORS = ["OHRC", "TMC-2", "TMC2", "IIRS", "LRO_NAC", "NAC", "TC", "MI"]
VALIDATION_RULES = [
    "FILE_EXISTENCE_CHECK", "DIMENSION_VALIDITY_CHECK", "BAND_STRUCTURE_CHECK",
    "NUMERIC_DATA_INTEGRITY_CHECK", "GEOSPATIAL_FOOTPRINT_CHECK", "SOLAR_GEOMETRY_CHECK",
    "GSD_METADATA_CHECK",
]
LIMITATIONS = [
    "REAL-DATA ACCURACY = N/A",
    "REAL-LUNAR EMPIRICAL UNCERTAINTY CALIBRATION NOT ESTABLISHED",
    "UNKNOWN != NEGATIVE",
    "ENTITY ASSOCIATION != DIRECT IMAGE CORRESPONDENCE",
]
