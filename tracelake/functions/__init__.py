"""functions of the bus-log and signal engine."""
