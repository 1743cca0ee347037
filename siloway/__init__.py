"""siloway: vehicle-visit analytics over industrial sites, written as PySpark DataFrame operators."""
