"""Analytics over geolocated object search, expressed as Spark plans."""
