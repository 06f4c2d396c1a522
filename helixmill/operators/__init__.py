"""operators of helixmill."""
