"""Schemas of the monitoring tables, as Spark DDL."""

_STATISTIC = "struct<value:double,is_infinite:boolean,log_value:double>"
TRACKER = (
    "struct<tracker_id:string,betting_function:string,betting_parameters:struct<epsilon:double,epsilons:array<double>,n_grid:int,min_epsilon:double,jump:double>,"
    f"alarm_statistic:string,statistic_value:double,statistic_is_infinite:boolean,log_statistic_value:double,statistics:map<string,{_STATISTIC}>,e_value:double,"
    "e_value_is_infinite:boolean,log_e_value:double,threshold:double,threshold_horizon:int,threshold_window_position:int,threshold_window_reset:boolean,"
    "alarm_fired:boolean,alarm_active:boolean,alarm_count:int,tested_count:int>"
)
MESSAGE = "topic string, payload string, qos int, retain boolean, received_at timestamp, seq long"
TELEMETRY = "charger_id string, timestamp timestamp, type string, value double, data_source string, created timestamp"
CHARGERS = (
    "charger_id string, manufacturer_name string, charger_name string, firmware_version string, last_seen string, state string, online boolean, created timestamp, "
    "mqtt_connected boolean, mqtt_last_message timestamp, mqtt_subscription_status string, mqtt_error_count int, mqtt_last_error string"
)
ANOMALIES = "charger_id string, timestamp timestamp, telemetry_type string, anomaly_type string, anomaly_value double, value_type string, sensor_set array<string>"
ANOMALY_IDENTITY = "anomaly_id string, charger_id string, timestamp timestamp, telemetry_type string, created timestamp"
EVIDENCE = (
    "service_id string, timestamp timestamp, sequence_number int, charger_id string, sensor_set array<string>, input_timestamps map<string,timestamp>, strategy string, model_type string, "
    "p_value double, anomaly_score double, e_value double, e_value_is_infinite boolean, log_e_value double, restarted_martingale double, restarted_martingale_is_infinite boolean, "
    f"log_restarted_martingale double, tracker_results array<{TRACKER}>, threshold double, alarm boolean, created timestamp"
)
OPERATIONAL_STATUS = (
    "struct<stage:string,detail:string,progress:struct<current:int,target:int>,message_count:long,processed_message_count:long,last_alignment_status:string,error:string,updated_at:timestamp,is_stale:boolean>"
)
SERVICES = (
    "id string, container_id string, container_name string, stateful_set_name string, mqtt_topic array<string>, created_at timestamp_ntz, status boolean, "
    f"operational_stage string, operational_status {OPERATIONAL_STATUS}, operational_updated_at timestamp"
)
FAVORITES = "favorite_id int, charger_id string, user_id int"
SERVICE_METRICS = (
    "timestamp timestamp, total_messages_processed int, total_anomalies_detected int, anomaly_rate double, avg_processing_time_ms double, throughput_per_second double, "
    "memory_usage_mb double, error_count int, error_rate double, service_status string, active_alerts array<string>"
)

#: Key columns by table, for first-wins inserts.
KEYS = {
    "telemetry": ["charger_id", "timestamp", "type"],
    "chargers": ["charger_id"],
    "anomalies": ["charger_id", "timestamp", "telemetry_type"],
    "anomaly_identity": ["charger_id", "timestamp", "telemetry_type"],
    "monitoring_evidence": ["service_id", "timestamp", "sequence_number"],
}
MULTIVARIATE = "__multivariate__"
