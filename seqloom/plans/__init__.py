"""Plan-time objects: index states and sequence pools."""
