"""Row types of the data model, as DDL."""

RAW = ("key STRING, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP, headers ARRAY<STRUCT<key: STRING, value: BINARY>>")
METADATA = ("topic STRING, partition INT, offset BIGINT, correlation_id STRING, headers ARRAY<STRUCT<key: STRING, value: BINARY>>, ingested_at TIMESTAMP")
PAYMENT = ("accountId STRING, sequenceNumber BIGINT, amount DECIMAL(18,2), currency STRING, type STRING, timestamp TIMESTAMP")
#: What the stateful processor takes: a parsed event with the outcome its handler gives it.
EVENT = ("topic STRING, partition INT, offset BIGINT, source_entity STRING, sequence_number BIGINT, payload STRING, timestamp TIMESTAMP")
#: What it returns: one row an event, and side rows.
OUTPUT = (
    "topic STRING, partition INT, offset BIGINT, source_entity STRING, sequence_number BIGINT, payload STRING, disposition STRING, release_reason STRING, "
    "stage STRING, classification STRING, error_class STRING, error_message STRING, retry_count INT, idempotency_key STRING, detail STRING, emitted_at TIMESTAMP"
)
BREAKER = ("state STRING, entered_at BIGINT, last_transition BIGINT, consecutive_failures INT, probe_total INT, probe_ok INT")

# The closed sets of names.
CIRCUIT_STATES = ("CLOSED", "OPEN", "HALF_OPEN")
CLASSIFICATIONS = ("DESERIALIZATION", "VALIDATION", "TRANSIENT", "PERMANENT")
RESULTS = ("SUCCESS", "TRANSIENT_FAILURE", "PERMANENT_FAILURE")
ROUTINGS = ("ROUTED", "BUFFERED", "BUFFER_FULL")
STAGES = ("DESERIALIZE", "CIRCUIT_BREAKER_CHECK", "REORDER", "DEDUPLICATION", "BUSINESS_LOGIC")
