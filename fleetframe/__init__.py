"""Vehicle-rental analytics as PySpark DataFrame operators."""

from fleetframe.sources.tables import RentalTables

__all__ = ["RentalTables"]
