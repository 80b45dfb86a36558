"""Column functions: calendar and solar features, normalisation, map projections."""
