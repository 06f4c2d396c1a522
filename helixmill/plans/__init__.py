"""plans of helixmill."""
