"""sources of helixmill."""
