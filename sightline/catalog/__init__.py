from . import registry

_FAMILIES: tuple[str, ...] = ("reports", "geometry", "frames", "similarity", "labels", "temporal", "resolution", "merging", "bridges", "tables", "streams", "sinks", "processing")


def load() -> tuple[dict, dict]:
    from importlib import import_module

    for family in _FAMILIES:
        import_module(f"{__name__}.{family}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
