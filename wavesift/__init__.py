"""wavesift: scanning-diffraction analytics and reconstruction on PySpark."""

__version__ = "0.1.0"
