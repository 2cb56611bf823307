"""cityhop: public-transport reachability on Spark DataFrames.

Every operator takes DataFrames (a :class:`~cityhop.model.Network` of GTFS
tables for all feeds, plus a DataFrame of requests keyed by ``query_id``) and
returns a DataFrame.  A single lookup and a full city-to-city matrix are the
same plan with a different number of request rows.
"""

from cityhop.model import Network

__all__ = ["Network"]
