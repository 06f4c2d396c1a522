"""streaming of helixmill."""
