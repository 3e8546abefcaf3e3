"""millrace: a PySpark-native engine for configuration identity checks and corpus preparation."""

from importlib.metadata import PackageNotFoundError, version

try:
    __version__ = version("millrace")
except PackageNotFoundError:  # used from a checkout
    __version__ = "0.0.0"
