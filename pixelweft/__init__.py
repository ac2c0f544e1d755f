"""pixelweft: a Spark-native engine for image fingerprints, vector similarity and corpus preparation.

The core (``functions``, ``operators``, ``sources``, ``streaming``, ``plans``) holds the image, hash and
embedding operators. ``llm`` holds operators for training-data pipelines; nothing in the core imports it.
"""

from .schema import FORMAT_VERSION, HashAlgorithm, MultiHashConfig, PreprocessConfig

__version__ = "0.1.0"
__all__ = ["FORMAT_VERSION", "HashAlgorithm", "MultiHashConfig", "PreprocessConfig", "__version__"]
