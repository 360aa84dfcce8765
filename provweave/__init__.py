"""A Spark-native engine for corpora of W3C PROV-JSON provenance graphs."""

from .config import IGNORED_ATTR_KEYS, NODE_SECTIONS, REL_SCHEMA, VOLATILE_ATTR_KEYS, ProvConfig
from .plans.codec import Compressed, ProvCodec, compress, compress_directory, compress_document, decompress_directory, decompress_document, equal, verify_directory
from .plans.sql import register
from .sources.provjson import count_documents, is_document_name, list_documents, read_corpus

__version__ = "0.2.0"

__all__ = [
    "IGNORED_ATTR_KEYS", "NODE_SECTIONS", "REL_SCHEMA", "VOLATILE_ATTR_KEYS", "Compressed", "ProvCodec", "ProvConfig", "compress", "compress_directory", "compress_document",
    "count_documents", "decompress_directory", "decompress_document", "equal", "is_document_name", "list_documents", "read_corpus", "register", "verify_directory",
]
