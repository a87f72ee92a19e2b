"""PySpark engine for building, reconciling and searching a catalog of device drivers."""
