"""Names, thresholds, weights, texts and the seeded vectors."""

from __future__ import annotations

import numpy as np

# --- fixed values -----------------------------------------------------------
HAZARDS = ("flood", "heatwave", "drought", "landslide", "cyclone")
RISKS = ("Low", "Medium", "High")
HORIZON_DISCOUNT = {6: 1.0, 24: 0.92, 72: 0.82}
HIGH_AT = 65.0
MEDIUM_AT = 35.0
MODEL_VERSION = "1.0.0"

SENSOR_FIELDS = (
    "rainfall_mm",
    "temperature_c",
    "river_level_m",
    "soil_moisture_pct",
    "wind_speed_kmh",
    "wind_direction_deg",
)

# inclusive bounds; None = open
PLAUSIBLE = {
    "temperature_c": (-90.0, 60.0),
    "rainfall_mm": (0.0, None),
    "river_level_m": (0.0, None),
    "soil_moisture_pct": (0.0, 100.0),
    "wind_speed_kmh": (0.0, None),
    "wind_direction_deg": (0.0, 360.0),
}

FEATURES = {
    "flood": ("rainfall_mm", "river_level_m", "soil_moisture_pct", "elevation", "drainage_capacity"),
    "heatwave": ("temperature_c", "wind_speed_kmh", "humidity", "historical_heatwave_flag"),
    "drought": (
        "rainfall_deficit_mm",
        "soil_moisture_trend",
        "temperature_anomaly_c",
        "rolling_window_days",
    ),
    "landslide": ("rainfall_intensity_mm", "soil_moisture_pct", "elevation_gradient", "terrain_slope"),
    "cyclone": ("wind_speed_kmh", "wind_direction_deg", "sea_surface_temp_c", "cloud_density"),
}

ENSEMBLE_WEIGHTS = {
    "flood": (0.6, 0.4),
    "heatwave": (0.5, 0.5),
    "drought": (0.7, 0.3),
    "landslide": (0.6, 0.4),
    "cyclone": (0.4, 0.6),
}
SPATIAL_HAZARDS = ("flood", "landslide", "cyclone")
CLOUD_HAZARDS = ("flood", "drought", "landslide", "cyclone")

FACTOR_WEIGHTS = {
    "flood": {
        "rainfall_mm": 0.35,
        "river_level_m": 0.25,
        "soil_moisture_pct": 0.20,
        "elevation": 0.10,
        "drainage_capacity": 0.10,
    },
    "heatwave": {
        "temperature_c": 0.50,
        "humidity": 0.25,
        "wind_speed_kmh": 0.15,
        "historical_heatwave_flag": 0.10,
    },
    "drought": {
        "rainfall_deficit_mm": 0.40,
        "soil_moisture_trend": 0.30,
        "temperature_anomaly_c": 0.20,
        "rolling_window_days": 0.10,
    },
    "landslide": {
        "rainfall_intensity_mm": 0.35,
        "soil_moisture_pct": 0.25,
        "elevation_gradient": 0.25,
        "terrain_slope": 0.15,
    },
    "cyclone": {
        "wind_speed_kmh": 0.40,
        "cloud_density": 0.25,
        "sea_surface_temp_c": 0.20,
        "wind_direction_deg": 0.15,
    },
}

FACTOR_NAMES = {
    "rainfall_mm": "heavy rainfall",
    "river_level_m": "rising river levels",
    "soil_moisture_pct": "high soil moisture",
    "elevation": "low elevation terrain",
    "drainage_capacity": "limited drainage capacity",
    "temperature_c": "high temperature",
    "wind_speed_kmh": "strong winds",
    "humidity": "high humidity",
    "rainfall_deficit_mm": "rainfall deficit",
    "soil_moisture_trend": "declining soil moisture",
    "temperature_anomaly_c": "temperature anomaly",
    "rainfall_intensity_mm": "intense rainfall",
    "elevation_gradient": "steep elevation gradient",
    "terrain_slope": "steep terrain slope",
    "wind_direction_deg": "wind direction",
    "sea_surface_temp_c": "warm sea surface temperature",
    "cloud_density": "dense cloud cover",
    "flood_inundation_pct": "satellite-detected flooding",
    "vegetation_index": "low vegetation index",
}

RISK_COLOUR = {"High": "Red", "Medium": "Yellow", "Low": "Green"}
SLA_SECONDS = {"High": 300, "other": 900}
IMAGE_SLA_SECONDS = 300
DEGRADED_MINUTES = 30
UNAVAILABLE_MINUTES = 60
SATELLITE_SILENCE_HOURS = 2
FEED_LEVELS = ((DEGRADED_MINUTES * 60, "degraded"), (UNAVAILABLE_MINUTES * 60, "unavailable"))
PROVIDER_LEVELS = ((SATELLITE_SILENCE_HOURS * 3600, "unavailable"),)
LATENESS_SECONDS = 7200
BUFFER_SIZE = 24
SMOOTHING = 0.3
REPORT_THRESHOLD = 3
REPORT_WINDOW_SECONDS = 3600
DEBOUNCE = "10 minutes"
EARTH_RADIUS_KM = 6371.0
EVACUATION_KMH = 40.0
ROUTE_HAZARDS = ("flood_inundation", "landslide_high")
SMS_MAX_RETRIES = 3

# language -> (high message, medium message, high action, medium action, time sentence)
ALERT_TEXTS = {
    "en": (
        "[HIGH RISK] {disaster_type} alert for your region. Risk level: {risk_level}.",
        "[MEDIUM RISK] {disaster_type} alert for your region. Risk level: {risk_level}.",
        "Evacuate immediately and follow official guidance.",
        "Stay alert, monitor official channels, and prepare an emergency kit.",
        "Estimated time to impact: {time_to_impact_h}h.",
    ),
    "es": (
        "[RIESGO ALTO] Alerta de {disaster_type} para su región. Nivel de riesgo: {risk_level}.",
        "[RIESGO MEDIO] Alerta de {disaster_type} para su región. Nivel de riesgo: {risk_level}.",
        "Evacúe inmediatamente y siga las instrucciones oficiales.",
        "Manténgase alerta, monitoree los canales oficiales y prepare un kit de emergencia.",
        "Tiempo estimado hasta el impacto: {time_to_impact_h}h.",
    ),
    "fr": (
        "[RISQUE ÉLEVÉ] Alerte {disaster_type} pour votre région. Niveau de risque : {risk_level}.",
        "[RISQUE MOYEN] Alerte {disaster_type} pour votre région. Niveau de risque : {risk_level}.",
        "Évacuez immédiatement et suivez les consignes officielles.",
        "Restez vigilant, surveillez les canaux officiels et préparez un kit d'urgence.",
        "Temps estimé avant l'impact : {time_to_impact_h}h.",
    ),
    "hi": (
        "[उच्च जोखिम] आपके क्षेत्र के लिए {disaster_type} चेतावनी। जोखिम स्तर: {risk_level}।",
        "[मध्यम जोखिम] आपके क्षेत्र के लिए {disaster_type} चेतावनी। जोखिम स्तर: {risk_level}।",
        "तुरंत निकासी करें और आधिकारिक निर्देशों का पालन करें।",
        "सतर्क रहें, आधिकारिक चैनलों की निगरानी करें और आपातकालीन किट तैयार रखें।",
        "प्रभाव तक अनुमानित समय: {time_to_impact_h} घंटे।",
    ),
    "ar": (
        "[خطر مرتفع] تحذير من {disaster_type} لمنطقتك. مستوى الخطر: {risk_level}.",
        "[خطر متوسط] تحذير من {disaster_type} لمنطقتك. مستوى الخطر: {risk_level}.",
        "أخلِ المنطقة فوراً واتبع التعليمات الرسمية.",
        "ابقَ يقظاً وراقب القنوات الرسمية وجهّز حقيبة الطوارئ.",
        "الوقت المقدر حتى التأثير: {time_to_impact_h} ساعة.",
    ),
}

ANSWER_NO_PLACE = (
    "I couldn't determine your location from the query. Please specify a region "
    "(e.g., 'What is the flood risk in [region-name]?')"
)
ANSWER_NO_DATA = "I don't have current prediction data for that region."
ANSWER_LOW = (
    "Current risk levels are Low. Travel appears safe, but always check official advisories."
)
ANSWER_NO_ACTION = (
    "No immediate action required. Stay informed via official channels and prepare an emergency kit."
)
PRECAUTIONS = {
    "flood": "Flood precautions: Move to higher ground, avoid flood-prone areas, prepare emergency "
    "supplies, follow evacuation orders.",
    "heatwave": "Heatwave precautions: Stay indoors during peak hours, drink plenty of water, check on "
    "vulnerable neighbours.",
    "drought": "Drought precautions: Conserve water, avoid open burning, monitor water supply levels.",
    "landslide": "Landslide precautions: Avoid steep slopes, monitor for unusual sounds, be ready to "
    "evacuate.",
    "cyclone": "Cyclone precautions: Secure loose objects, stay indoors, follow evacuation orders if "
    "issued.",
}
SAFETY_WORDS = ("safe", "travel", "go to")
PRECAUTION_WORDS = ("precaution", "prepare", "what should", "what to do")

VECTOR_DIM = 16


def _normal(seed: int, shape) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(shape)


# seeds 42 (6x16), 7, 77 and 99; the last three are held in single precision
PROJECTION = [[float(x) for x in row] for row in _normal(42, (len(SENSOR_FIELDS), VECTOR_DIM))]
QUERY_VECTOR = [float(x) for x in _normal(7, VECTOR_DIM).astype(np.float32)]
GRAPH_VECTOR = [float(x) for x in _normal(77, VECTOR_DIM).astype(np.float32)]
SCORE_VECTOR = [float(x) for x in _normal(99, VECTOR_DIM).astype(np.float32)]
# ---------------------------------------------------------------------------
