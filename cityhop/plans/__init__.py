"""End-to-end request plans (destinations, journeys) composed from operators."""
