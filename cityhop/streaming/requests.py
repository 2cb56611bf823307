"""Answer a stream of requests with the batch plans.

The service answers requests as they arrive; with Structured Streaming each
micro-batch of requests is one batch query (``foreachBatch``), so the same
plans (and the same skew handling) serve one request or thousands.  The
network, the city table and the index of its stops are static inputs built once at start-up.
Nothing here keeps state across batches, so no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cityhop.operators.membership import city_stops
from cityhop.plans.destinations import reachable_cities
from cityhop.plans.journeys import search_trips
from cityhop.session import materialize


def serve(requests_stream: DataFrame, answer, sink_path: str, checkpoint_location: str, trigger: dict | None = None):
    """Start a query writing ``answer(batch_df)`` for every micro-batch to Parquet.

    ``checkpoint_location`` must be a shared folder (it holds the stream's
    progress, so a restarted driver resumes where it stopped).
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        # a retried micro-batch overwrites its own folder, so its answers are not written twice
        answer(batch).write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")

    w = requests_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def serve_destinations(requests_stream: DataFrame, net, cities: DataFrame, sink_path: str, checkpoint_location: str, trigger=None):
    """Stream of (query_id, lat, lon, start_date, end_date[, transports]) -> O11 answers."""
    members = materialize(city_stops(net, cities))
    return serve(requests_stream, lambda b: reachable_cities(net, cities, b, members=members), sink_path, checkpoint_location, trigger)


def serve_trips(requests_stream: DataFrame, net, cities: DataFrame, sink_path: str, checkpoint_location: str, trigger=None):
    """Stream of trip requests -> O12 answers."""
    members = materialize(city_stops(net, cities))
    return serve(requests_stream, lambda b: search_trips(net, cities, b, members=members), sink_path, checkpoint_location, trigger)
