"""Sources (S-*) and ingest normalisation (N-*)."""

from relayspark.sources.normalise import from_kafka, from_pulsar, from_eventhubs, from_pubsub
from relayspark.sources.bindings import read_topics, kafka_reader_options, eventhubs_reader_options
from relayspark.sources.synthetic import synthetic_topics, synthetic_stream, given_messages, given_stream
from relayspark.sources.replay import read_topic_table_source, replay_from

__all__ = [
    "from_kafka",
    "from_pulsar",
    "from_eventhubs",
    "from_pubsub",
    "read_topics",
    "kafka_reader_options",
    "eventhubs_reader_options",
    "synthetic_topics",
    "synthetic_stream",
    "given_messages",
    "given_stream",
    "replay_from",
    "read_topic_table_source",
]
