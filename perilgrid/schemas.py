"""Wire and table schemas."""

from __future__ import annotations

SENSOR_JSON = (
    "sensor_id string, region_id string, timestamp string, rainfall_mm double, temperature_c double, "
    "river_level_m double, soil_moisture_pct double, wind_speed_kmh double, wind_direction_deg double, "
    "is_anomalous boolean, stream_status string"
)
WEATHER_JSON = (
    "region_id string, fetched_at string, precipitation_prob_pct double, temperature_forecast_c double, "
    "wind_forecast_kmh double, forecast_horizon_h int, source string"
)
SATELLITE_JSON = (
    "image_id string, region_id string, provider string, captured_at string, received_at string, "
    "resolution_m double, feed_status string"
)
GOV_JSON = (
    "record_id string, region_id string, data_type string, payload string, fetched_at string, source string"
)
PREDICTION = (
    "prediction_id string, region_id string, disaster_type string, forecast_horizon_h int, risk_level string, "
    "probability_pct double, time_to_impact_h double, severity_index double, generated_at timestamp, "
    "model_version string, input_data_snapshot_id string"
)
CNN_FEATURES = (
    "image_id string, region_id string, extracted_at timestamp, flood_inundation_pct double, cloud_density double, "
    "vegetation_index double"
)
ACTUAL_OUTCOME = (
    "outcome_id string, prediction_id string, region_id string, disaster_type string, actual_occurred boolean, "
    "actual_severity double, recorded_at timestamp"
)
HISTORICAL_EVENT = (
    "event_id string, region_id string, disaster_type string, start_date date, end_date date, severity double, source string"
)
EXPLANATION = (
    "explanation_id string, prediction_id string, generated_at timestamp, contributing_factors "
    "array<struct<feature_name:string,contribution_pct:double,direction:string>>, plain_language_summary string"
)
USER = (
    "user_id string, phone_number string, push_token string, language_code string, region_ids array<string>, "
    "is_infrastructure_operator boolean, infrastructure_ids array<string>, notification_channels array<string>"
)
ALERT = (
    "alert_id string, prediction_id string, region_id string, disaster_type string, risk_level string, "
    "time_to_impact_h double, recommended_action string, evacuation_route_id string, language_code string, "
    "channel string, dispatched_at timestamp, delivery_status string, retry_count int"
)
INFRASTRUCTURE_ASSET = (
    "asset_id string, region_id string, asset_type string, name string, lat double, lon double, "
    "operator_user_ids array<string>, capacity_m3 double"
)
CROWD_REPORT = (
    "report_id string, user_id string, region_id string, disaster_type string, image_url string, description string, "
    "reported_at timestamp, lat double, lon double, validation_status string"
)
ROAD_NODE = "node_id string, lat double, lon double, label string"
ROAD_EDGE = "edge_id string, from_node string, to_node string, distance_km double, road_id string, is_blocked boolean"
REGION_ADJACENCY = "region_id string, neighbour_id string, edge_weight double"
TERRAIN = "region_id string, elevation_m double, terrain_type string, slope_gradient double, elevation_source string"
DRAINAGE = "region_id string, capacity_m3 double, current_status_pct double, is_operational boolean, is_urban boolean"
HAZARD_ZONE = "zone_id string, region_id string, hazard_type string, ring array<struct<lon:double,lat:double>>"
EVACUATION_ROUTE = (
    "route_id string, region_id string, prediction_id string, origin struct<lat:double,lon:double,label:string>, "
    "destination struct<lat:double,lon:double,label:string>, waypoints array<struct<lat:double,lon:double>>, "
    "distance_km double, estimated_duration_min double, avoids array<string>, computed_at timestamp, is_blocked boolean"
)
