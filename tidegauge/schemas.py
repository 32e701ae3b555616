"""Table schemas as DDL strings. Missing values are NULL, never NaN."""

OBS = "entity_id STRING, series_id STRING, obs_date DATE, value DOUBLE"
OBS_PAYLOAD = "entity_id STRING, series_id STRING, observations ARRAY<STRUCT<date: STRING, value: STRING>>"
OBS_VINTAGE = (
    "entity_id STRING, series_id STRING, obs_date DATE, "
    "realtime_start DATE, realtime_end DATE, value DOUBLE"
)
VINTAGE_COVERAGE = "series_id STRING, asof DATE, status STRING"
PANEL = "entity_id STRING, series_id STRING, period_end DATE, value DOUBLE"
FEATURES = "entity_id STRING, feature STRING, period_end DATE, value DOUBLE"
LABELS = "entity_id STRING, period_end DATE, horizon INT, y DOUBLE"
SERIES_CATALOG = (
    "series_id STRING, category STRING, source_id STRING, description STRING, native_freq STRING, "
    "lag_months INT, countercyclical BOOLEAN, block STRING, scale DOUBLE, feature_pool BOOLEAN"
)
COMPOSITE_SPEC = (
    "component STRING, sources ARRAY<STRING>, transform STRING, sign INT, composite STRING, description STRING"
)
ORIGINS = "origin DATE, label STRING, category STRING, scope STRING"
REGIME_EVENTS = "event STRING, start_month DATE, end_month DATE, in_scope BOOLEAN"
SCORES = "run_id STRING, entity_id STRING, period_end DATE, horizon INT, model STRING, prob DOUBLE"
CANDIDATES = "candidate_id STRING, description STRING, max_features INT, n_cv_splits INT, config MAP<STRING, STRING>"
