"""weftline: a PySpark-native engine for profiling, restructuring and encoding semi-structured data."""

__version__ = "0.1.0"
__all__ = ["compress", "compress_file", "decompress", "decompress_file", "detect_format", "info"]


def __getattr__(name: str):
    """The byte interface is loaded on first use, so that Python workers start without it."""
    if name in __all__:
        from . import api

        return getattr(api, name)
    raise AttributeError(name)
