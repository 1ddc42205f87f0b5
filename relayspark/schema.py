"""The one record type (MESSAGE), routed rows, and the raw row shape per broker."""

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("payload", T.BinaryType(), True),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType(), True), False),
        T.StructField("topic", T.StringType(), False),
        T.StructField("key", T.StringType(), True),
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("offset", T.LongType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
    ]
)
MESSAGE_COLUMNS = [f.name for f in MESSAGE.fields]

# Columns added by routing. ``source_size`` is the size before processing (null
# when the message could not be measured, which makes it a source error);
# ``dest_topic`` is fixed before processing; ``error`` is the source-side error
# text; ``delivery_error`` is a destination-side failure (null destination,
# processor returned nothing).
ROUTED_EXTRA = T.StructType(
    [
        T.StructField("source_size", T.LongType(), True),
        T.StructField("dest_topic", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
        T.StructField("delivery_error", T.StringType(), True),
    ]
)
ROUTED = T.StructType(MESSAGE.fields + ROUTED_EXTRA.fields)
ROUTED_COLUMNS = [f.name for f in ROUTED.fields]

# Raw rows as each broker hands them over.
KAFKA_RAW = T.StructType(
    [
        T.StructField("key", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), True),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType(
                    [T.StructField("key", T.StringType(), True), T.StructField("value", T.BinaryType(), True)]
                )
            ),
            True,
        ),
        T.StructField("topic", T.StringType(), True),
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("offset", T.LongType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
    ]
)
PULSAR_RAW = T.StructType(
    [
        T.StructField("data", T.BinaryType(), True),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType(), True), True),
        T.StructField("topic_name", T.StringType(), True),
        T.StructField("partition_key", T.StringType(), True),
        T.StructField("publish_timestamp", T.LongType(), True),
    ]
)
EVENTHUBS_RAW = T.StructType(
    [
        T.StructField("body", T.BinaryType(), True),
        T.StructField(
            "properties",
            T.ArrayType(
                T.StructType(
                    [T.StructField("key", T.BinaryType(), True), T.StructField("value", T.BinaryType(), True)]
                )
            ),
            True,
        ),
        T.StructField("partition_id", T.StringType(), True),
        T.StructField("offset", T.StringType(), True),
        T.StructField("enqueued_time", T.TimestampType(), True),
    ]
)
PUBSUB_RAW = T.StructType(
    [
        T.StructField("data", T.BinaryType(), True),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType(), True), True),
        T.StructField("publish_time", T.TimestampType(), True),
        T.StructField("ack_id", T.StringType(), True),
        T.StructField("subscription", T.StringType(), True),
    ]
)

# Delivered rows as the checks see them (a topic table).
DELIVERED = T.StructType(
    [
        T.StructField("topic", T.StringType(), True),
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("offset", T.LongType(), True),
        T.StructField("key", T.StringType(), True),
        T.StructField("value", T.StringType(), True),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType(), True), True),
    ]
)
