"""Column functions on log text: masking, tokens, keys and token types."""

from .dialect import java_pattern, java_replacement
from .text import MASKS, bucket_key, canonical_key, evaluation_key, mask, semantic_type, strip_text, template_key, tokens

__all__ = ["MASKS", "bucket_key", "canonical_key", "evaluation_key", "java_pattern", "java_replacement", "mask", "semantic_type", "strip_text", "template_key", "tokens"]
