"""functions of helixmill."""
