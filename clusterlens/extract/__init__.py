from clusterlens.extract import features, metadata, tables  # noqa: F401  (registers extractors)
from clusterlens.extract.registry import EXTRACTORS, extractor, run_extractors

__all__ = ["EXTRACTORS", "extractor", "features", "metadata", "run_extractors", "tables"]
