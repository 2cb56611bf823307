"""Relational operators over a Network (spatial, service, reach, trips, stops, clustering, cities, quality)."""
