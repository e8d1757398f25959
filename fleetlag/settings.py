"""Fixed values. They must equal the published ones for results to agree."""

# Geography and cleaning limits.
LAT_RANGE = (55.0, 56.5)
LON_RANGE = (36.5, 38.5)
SPEED_CAP_KMH = 150.0
SYNTHETIC_FROM = 9_000_000
LOCAL_OFFSET_S = 10_800
EARTH_RADIUS_M = 6_371_000.0
MATCHER_EARTH_RADIUS_M = 6_371_008.8
MAP_EARTH_DIAMETER_KM = 12_742.0

# Timetable structure and the forecast target window.
LAYOVER_GAP_S = 420
LEAD_MIN_S = 600
LEAD_MAX_S = 900
RUN_GAP_S = 900

# Arrival search around a planned stop.
ARRIVAL_RADIUS_M = 80.0
ARRIVAL_BEFORE_S = 420
ARRIVAL_AFTER_S = 900
DEPART_TOLERANCE_M = 5.0

# Feature windows.
HISTORY_S = 9_000
MOVING_KMH = 5.0
MIN_SPEED_MS = 1.0
LOOP_MIN_S = 1_200
EARLY_LOOKAHEAD_S = 120
MAX_OVERDUE_S = 900
ROUTE_LOOKBACK = 6

# Model, metrics and explanation.
LATE_S = 120
INTERVAL_QUANTILES = (0.1, 0.9)
TARGET_TO_ZERO = 0.76
OUTAGE_KINDS = ("silence", "no_position")
OUTAGE_GAP_S = (60.0, 900.0)
OUTAGE_COPIES = 2
FRESH_S = 30.0
REASON_MIN_S = 15.0
MAX_REASONS = 3

# Live stop detector.
DETECTOR = {
    "stop_radius_m": 50.0,
    "stopped_speed_kmh": 5.0,
    "visit_time_tolerance_sec": 300.0,
    "stale_after_sec": 300.0,
}

# Live scoring and dispatcher views.
GREEN_RANGE_S = (-60.0, 120.0)
RED_ABOVE_S = 300.0
STALE_AFTER_S = 120.0
DROP_AFTER_S = 900.0
SCORING_PERIOD_S = 60
TELEMETRY_WINDOW_S = 1_800
SCHEDULE_BACK_S = 86_400
CARD_SPAN_S = 1_800
TRACK_GAP_S = 120
AWAY_FROM_PLAN_KM = 3.0
FIRST_RING_KM = 0.5
CARD_HISTORY_ROWS = 240
ALERT_LIMITS = (1, 1000)

# Feature columns in their published order.
FEATURES = [
    "lead_s", "hour", "since_last_plan_s", "stops_ahead", "plan_dist_ahead_m", "plan_run_s",
    "layover_ahead_s", "new_trip_ahead", "last_trip_frac", "target_seq", "target_trip_frac",
    "trip_stops", "trip_no", "target_lat", "target_lon",
    "cur_dev_s", "layover_slack_s",
    "tel_age_s", "fixes_15m", "ok_share_15m", "speed_mean_5m", "speed_mean_15m", "speed_max_5m",
    "stopped_share_10m", "standing_s", "dist_to_target_m", "route_offset_m", "gps_dist_ahead_m",
    "gps_stops_ahead", "eta_dev_s",
    "gps_dev_last_s", "gps_dev_age_s", "gps_dev_mean3_s", "gps_dev_trend_s", "gps_overdue_s",
    "gps_dev_now_s", "gps_minus_cur_s", "gps_found_share", "dwell_last_s", "dwell_mean3_s",
    "prev_loop_dev_s", "prev_loop_age_s", "prev_loop_gain_s",
]

# Which features speak for which reason, in reason order.
REASONS = {
    "carried_delay": [
        "cur_dev_s", "gps_dev_last_s", "gps_dev_mean3_s", "gps_dev_trend_s", "gps_overdue_s",
        "gps_dev_now_s", "gps_minus_cur_s", "gps_dev_age_s",
    ],
    "layover": ["layover_ahead_s", "new_trip_ahead", "layover_slack_s"],
    "slow_traffic": [
        "speed_mean_5m", "speed_mean_15m", "speed_max_5m", "stopped_share_10m", "eta_dev_s",
        "dist_to_target_m", "gps_dist_ahead_m", "gps_stops_ahead",
    ],
    "long_dwell": ["standing_s", "dwell_last_s", "dwell_mean3_s"],
    "chronic_segment": ["prev_loop_dev_s", "prev_loop_gain_s", "prev_loop_age_s"],
    "timetable": [
        "lead_s", "hour", "since_last_plan_s", "stops_ahead", "plan_dist_ahead_m", "plan_run_s",
        "last_trip_frac", "target_seq", "target_trip_frac", "trip_stops", "trip_no",
        "target_lat", "target_lon",
    ],
    "signal": ["tel_age_s", "fixes_15m", "ok_share_15m", "gps_found_share", "route_offset_m"],
}

# Model reason -> code stored with a prediction.
REASON_CODES = {
    "carried_delay": "accumulated_delay",
    "slow_traffic": "slow_approach",
    "long_dwell": "long_dwell",
    "chronic_segment": "low_speed_segment",
    "signal": "stale_telemetry",
    "layover": "unknown",
    "timetable": "unknown",
}
